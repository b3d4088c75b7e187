"""Sentences as a stream: what a session has cached, what it checked last, and its log.

Rows are (key, ts, text), one finished sentence each.  A session skips blank text
and text equal to the last it checked; words of a checked sentence that the session
has not seen yet are misses and are remembered, others are hits.

With (key, ts, seq, text, word, correction) a session also learns: a sentence is answered
with the corrections known before it, then the row's correction of its word is
remembered, the latest replacing those before.

A session's rows of one micro-batch are sorted in its task: bound a micro-batch by the
source's maxFilesPerTrigger.  Each read or write of keyed state is a call to the JVM, so a
micro-batch reads and writes each of a session's words once, however often it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillwork.sources import versioned

OUTPUT = "key string, n_rows long, n_skipped long, n_hits long, n_misses long"
ANSWERS = "key string, ts timestamp, seq long, corrected string, hits int"
LOG = "key string, entries array<struct<ts: timestamp, seq: long, text: string, corrected: string>>"
#: Log entries that a session keeps.
KEPT = 100
_Totals, _Answer, _Entry, _Log = Row("key", "n_rows", "n_skipped", "n_hits", "n_misses"), Row("key", "ts", "seq", "corrected", "hits"), Row("ts", "seq", "text", "corrected"), Row("key", "entries")


def _nulls_last(*values: Any) -> tuple:
    return tuple((v is None, 0 if v is None else v) for v in values)


class _Words:
    """A map state (word to one value) during a micro-batch: a word is read when it is first asked for, and written at the end if it was put."""

    def __init__(self, state: Any):
        self.state, self.held, self.new = state, {}, set()
        # Of a session without words nothing has to be asked.
        self.read: Callable[[tuple], tuple | None] = state.getValue if state.exists() else lambda _: None

    def get(self, word: str) -> Any:
        if word not in self.held:
            found = self.read((word,))
            self.held[word] = None if found is None else found[0]
        return self.held[word]

    def put(self, word: str, value: Any) -> None:
        self.held[word] = value
        self.new.add(word)

    def write(self) -> None:
        for word in sorted(self.new):
            self.state.updateValue((word,), (self.held[word],))


class SessionCache(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "word string", "n long")
        self.last = handle.getValueState("last", "text string")
        self.totals = handle.getValueState("totals", "n_rows long, n_skipped long, n_hits long, n_misses long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, skipped, hits, misses = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        last = self.last.get()[0] if self.last.exists() else None
        seen = _Words(self.seen)
        # A micro-batch's rows of a key come unordered.
        for _, text in sorted(((r["ts"], r["text"]) for r in rows), key=lambda r: _nulls_last(*r)):
            n += 1
            if text is None or not text.strip() or text == last:
                skipped += 1
                continue
            last = text
            for word in text.lower().split():
                before = seen.get(word)
                if before is None:
                    misses += 1
                else:
                    hits += 1
                seen.put(word, (before or 0) + 1)
        seen.write()
        self.totals.update((n, skipped, hits, misses))
        if last is not None:
            self.last.update((last,))
        yield _Totals(key[0], n, skipped, hits, misses)

    def close(self) -> None:
        pass


class SessionCorrections(StatefulProcessor):
    """Answers each sentence, or with log=True keeps the session's log, its last KEPT answers, and gives it after each micro-batch."""

    def __init__(self, log: bool = False):
        self.gives_log = log

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cache = handle.getMapState("cache", "word string", "correction string")
        if self.gives_log:
            self.log = handle.getListState("log", "ts timestamp, seq long, text string, corrected string")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.cache.updateValue((initialState["word"],), (initialState["correction"],))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told: list[tuple] = []
        cache = _Words(self.cache)
        for ts, seq, text, learns, correction in sorted(((r["ts"], r["seq"], r["text"], r["word"], r["correction"]) for r in rows), key=lambda r: _nulls_last(*r[:2])):
            words = (text or "").split()
            new = [cache.get(w.lower()) for w in words]
            hits = sum(c is not None for c in new)
            corrected = " ".join(w if c is None else c for w, c in zip(words, new, strict=True)) if hits else text
            told.append((ts, seq, text, corrected, hits))
            if learns is not None and correction is not None:
                cache.put(learns.lower(), correction)
        cache.write()
        if not self.gives_log:
            yield from (_Answer(key[0], ts, seq, corrected, hits) for ts, seq, _, corrected, hits in told)
            return
        fresh = [t[:4] for t in told[-KEPT:]]
        held = [tuple(x) for x in self.log.get()] if len(fresh) < KEPT and self.log.exists() else []
        entries = (held + fresh)[-KEPT:]
        self.log.put(entries)
        yield _Log(key[0], [_Entry(*e) for e in entries])

    def close(self) -> None:
        pass


def session_totals(stream: DataFrame) -> DataFrame:
    """Running totals of each session; needs the RocksDB state store."""
    return stream.groupBy("key").transformWithState(SessionCache(), OUTPUT, "update", "none")


def session_answers(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """key, ts, seq, corrected, hits of each row; needs the RocksDB state store.

    known (key, word, correction): what sessions know before their first row, as `learned` gives it of
    another query; words that differ in case are one, of which any counts.
    """
    first = known.select("key", F.lower("word").alias("word"), "correction").groupBy("key") if known is not None else None
    return stream.groupBy("key").transformWithState(SessionCorrections(), ANSWERS, "append", "none", first)


def session_logs(stream: DataFrame) -> DataFrame:
    """key, entries: a session's log after each micro-batch that it has rows in; needs the RocksDB state store."""
    return stream.groupBy("key").transformWithState(SessionCorrections(log=True), LOG, "update", "none")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(result: DataFrame, where: str, mode: str) -> DataFrame:
    """Run until what is there is read; then all that was ever emitted, with the micro-batch (column n) that did.

    State and progress are under `where`: run again, it goes on with what came since.  A
    micro-batch that is repeated after a failure replaces its own folder.
    """
    spark = result.sparkSession
    with rocksdb(spark):
        writer = result.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/out/{n:06d}")).start().awaitTermination()
    found = spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{where}/out")
    return found.withColumn("n", F.regexp_extract(F.col("_metadata.file_path"), r"/out/(\d+)/", 1))


def latest_by_key(emitted: DataFrame) -> DataFrame:
    """Of updates, the last of each key."""
    rest = [c for c in emitted.columns if c not in ("key", "n")]
    return emitted.groupBy("key").agg(F.max_by(F.struct(*rest), "n").alias("s")).select("key", "s.*")


def session_totals_batch(rows: DataFrame) -> DataFrame:
    """The same totals of a finished table."""
    order = W.partitionBy("key").orderBy("ts", "text")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    # The last text checked is the last that was not blank: skipped ones equal it.
    before = F.last(F.when(~blank, F.col("text")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    told = rows.withColumn("_skip", blank | F.coalesce(F.col("text") == before, F.lit(False)))
    words = told.select("key", "_skip", F.when(F.col("_skip"), F.array().cast("array<string>")).otherwise(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("_w"))
    sums = words.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_skip").cast("long")).alias("n_skipped"), F.sum(F.size("_w")).alias("_all"))
    first = words.select("key", F.explode("_w").alias("w")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_misses"))
    return sums.join(first, "key", "left").select("key", "n_rows", "n_skipped", (F.col("_all") - F.coalesce("n_misses", F.lit(0))).alias("n_hits"), F.coalesce("n_misses", F.lit(0)).alias("n_misses"))


def session_answers_batch(rows: DataFrame) -> DataFrame:
    """The same answers of a finished table: each word meets the last correction of it before its row."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    asked = rows.select("key", "ts", "seq", F.posexplode(words).alias("i", "token")).select("key", "ts", "seq", "i", "token", F.lower("token").alias("word"), F.lit(None).cast("string").alias("correction"))
    writes = rows.filter("word IS NOT NULL AND correction IS NOT NULL").select("key", "ts", "seq", F.lit(None).cast("int").alias("i"), F.lit(None).cast("string").alias("token"), F.lower("word").alias("word"), "correction")
    before = W.partitionBy("key", "word").orderBy("ts", "seq", F.col("i").isNull()).rowsBetween(W.unboundedPreceding, 0)
    told = asked.unionByName(writes).withColumn("known", F.last("correction", ignorenulls=True).over(before)).filter("i IS NOT NULL")
    per = told.groupBy("key", "ts", "seq").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("known", "token").alias("t")))).alias("_t"), F.count("known").cast("int").alias("hits"))
    found = rows.select("key", "ts", "seq", "text").join(per, ["key", "ts", "seq"], "left")
    hits = F.coalesce("hits", F.lit(0))
    return found.select("key", "ts", "seq", F.when(hits > 0, F.array_join(F.transform("_t", lambda x: x["t"]), " ")).otherwise(F.col("text")).alias("corrected"), hits.alias("hits"))


def append_log(log: DataFrame, path: str, checkpoint: str):
    """A query that appends finished log entries to a versioned table as they come, each micro-batch once, also when it is repeated after a failure; the caller starts or stops others of it."""

    def add(batch: DataFrame, n: int) -> None:
        versioned.append(batch, path, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), n)

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learned(spark: SparkSession, where: str) -> DataFrame:
    """key, word, correction: what the sessions of a query run by run_available have learned, from its keyed state."""
    held = spark.read.format("statestore").option("stateVarName", "cache").load(f"{where}/state")
    return held.select("key.key", F.col("user_map_key.word").alias("word"), F.col("user_map_value.correction").alias("correction"))
