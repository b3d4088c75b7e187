"""Finished sentences of what is being typed.

Rows are (key, ts, seq, piece): what a session typed at a moment, a letter or more.  A
sentence is finished by each of . ! ?, or left unfinished by a pause: no piece for longer
than `pause` seconds of event time.  What it holds beside white space and marks must not be
empty.  How text is cut into pieces, in which order they come and which micro-batch has
them makes no difference: pieces wait in the session's state until the watermark has passed
them, and are then taken in order of time.

The state of a session is the text since its last sentence, and the pieces that wait: those
of the watermark's delay and one micro-batch, which the source's maxFilesPerTrigger bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SENTENCES = "key string, number long, sentence string, finished boolean"
MARKS, PAUSE_S = ".!?", 60.0
#: White space that is taken off both ends.
_BLANK = " \t\n\r\f\v"
_UP_TO_MARK = re.compile(f"[^{MARKS}]*[{MARKS}]")


class SentenceAssembly(StatefulProcessor):
    """A text buffer with timers: pieces are taken when the watermark has passed them, the rest leaves when a pause has."""

    def __init__(self, pause: float = PAUSE_S):
        self.pause_ms = int(pause * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, piece string")
        self.buffer = handle.getValueState("buffer", "text string, last_ms long, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            part = part[part["piece"].notna() & part["ts"].notna()]
            ms = part["ts"].astype("datetime64[ms]").astype("int64")
            new = list(zip(ms.tolist(), part["seq"].tolist(), part["piece"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                self.handle.registerTimer(min(n[0] for n in new))
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def _taken(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        text, last, n = self.buffer.get() if self.buffer.exists() else ("", None, 0)
        due = sorted(x for x in held if x[0] <= watermark)
        done: list[tuple[str, bool]] = []
        part: list[str] = [text]
        for ms, _, piece in due:
            if last is not None and ms - last > self.pause_ms:
                part = [self._cut("".join(part), done, True)]
            part.append(piece)
            last = ms
        text = self._cut("".join(part), done, last is not None and last + self.pause_ms < watermark)
        if due:
            later = [x for x in held if x[0] > watermark]
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self.handle.registerTimer(min(x[0] for x in later))
        if text:
            self.handle.registerTimer(last + self.pause_ms + 1)
        self.buffer.update((text, last, n + len(done)))
        if done:
            yield pd.DataFrame({"key": key[0], "number": range(n + 1, n + 1 + len(done)), "sentence": [s for s, _ in done], "finished": [f for _, f in done]})

    @staticmethod
    def _cut(text: str, done: list[tuple[str, bool]], paused: bool) -> str:
        """Adds what is done and returns what is not."""
        end = 0
        for m in _UP_TO_MARK.finditer(text):
            end = m.end()
            if (said := m.group().strip(_BLANK)).strip(MARKS):
                done.append((said, True))
        rest = text[end:]
        if paused:
            if said := rest.strip(_BLANK):
                done.append((said, False))
            return ""
        return rest

    def close(self) -> None:
        pass


def typed_sentences(stream: DataFrame, delay: str = "10 seconds", pause: float = PAUSE_S) -> DataFrame:
    """key, number (from 1 in each session), sentence, finished, from a stream (key, ts, seq, piece); needs the RocksDB state store.

    Rows at the watermark or before it when they come are dropped as late; null pieces and times are skipped.
    """
    return stream.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(SentenceAssembly(pause), SENTENCES, "append", "EventTime")


def typed_sentences_batch(pieces: DataFrame, until: Column | None = None, pause: float = PAUSE_S) -> DataFrame:
    """The same of a finished table; until: the moment up to which pieces count, and by which a pause must have passed for the rest to leave; all of it if none is given."""
    rows = pieces.filter("piece IS NOT NULL AND ts IS NOT NULL")
    end = F.lit(None).cast("timestamp") if until is None else until
    rows = rows.withColumn("_until", end).filter("_until IS NULL OR ts <= _until")
    order = W.partitionBy("key").orderBy("ts", "seq", "piece")
    gap = (F.col("ts").cast("double") - F.lag("ts").over(order).cast("double")) > pause
    runs = rows.withColumn("_run", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "piece"))), lambda x: x["piece"]), "")
    last_run = F.max("_run").over(W.partitionBy("key"))
    told = runs.groupBy("key", "_run").agg(text.alias("_text"), F.max("ts").alias("_last"), F.max("_until").alias("_until"))
    told = told.withColumn("_left", (F.col("_run") < last_run) | F.col("_until").isNull() | (F.col("_last").cast("double") + pause < F.col("_until").cast("double")))
    blank, marks = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", f"[{MARKS}]$"
    each = told.select("key", "_run", "_left", F.posexplode(F.regexp_extract_all("_text", F.lit(f"[^{MARKS}]*[{MARKS}]|[^{MARKS}]+"), F.lit(0))).alias("_i", "_s"))
    found = each.select("key", "_run", "_i", "_left", F.regexp_replace("_s", blank, "").alias("sentence")).withColumn("finished", F.col("sentence").rlike(marks))
    kept = found.filter(F.col("_left") | F.col("finished")).filter(F.regexp_replace("sentence", f"[{MARKS}]+$", "") != "")
    number = F.row_number().over(W.partitionBy("key").orderBy("_run", "_i")).cast("long")
    return kept.select("key", number.alias("number"), "sentence", "finished")


def as_typed(turns: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text", letters: int = 200, turn_s: int = 3600) -> DataFrame:
    """Pieces (key, ts, seq, piece) of whole turns, as if typed: so many letters a second, each turn so many seconds after the one before, turn 0 an hour after the epoch (a stream takes rows at the epoch itself, where watermarks begin, for late).  Null keys, turns and texts are left out."""
    rows = turns.filter(F.col(key).isNotNull() & F.col(turn).isNotNull() & F.col(text).isNotNull())
    pieces = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{letters}}}"), F.lit(0))).alias("_i", "piece")
    at = rows.select(F.col(key).cast("string").alias("key"), F.col(turn).cast("long").alias("_turn"), pieces)
    return at.select("key", F.timestamp_seconds((F.col("_turn") + 1) * turn_s + F.col("_i")).alias("ts"), F.col("_i").cast("long").alias("seq"), "piece")
