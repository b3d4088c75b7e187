"""Streams equal the finished table, and go on from where they stopped."""

import random
import re
import shutil
from collections import defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillwork.plans import catalogue
from quillwork.sources import versioned
from quillwork.streaming import session, typing


def key(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_stream_equals_batch(spark, sf_dir):
    columns = ("key", "n_rows", "n_skipped", "n_hits", "n_misses")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    batch = key(catalogue.session_totals(spark, sf_dir), *columns)
    assert key(catalogue.stream_cache(spark, sf_dir), *columns) == batch and len(batch) == 15
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


ROWS = [
    ("a", 1, 1, "teh cat", "teh", "the"),
    ("a", 2, 2, "Teh dog teh", "teh", "ten"),
    ("a", 3, 3, "teh end", None, None),
    ("b", 1, 4, "teh", "cat", "dog"),
    ("b", 2, 5, None, "teh", None),
    ("b", 3, 6, "  ", "x", "y"),
    ("b", 4, 7, "cat  X", "CAT", "cow"),
    ("b", 4, 8, "cat", None, None),
    ("a", 9, 9, "cat teh", "teh", "tee"),
]
WANTED = {1: ("teh cat", 0), 2: ("the dog the", 2), 3: ("ten end", 1), 4: ("teh", 0), 5: (None, 0), 6: ("  ", 0), 7: ("dog y", 2), 8: ("cow", 1), 9: ("cat ten", 1)}


def sentences(spark):
    df = spark.createDataFrame(ROWS, "key string, at int, seq long, text string, word string, correction string")
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_corrections_are_learned_and_the_latest_wins(spark):
    got = {r["seq"]: (r["corrected"], r["hits"]) for r in session.session_answers_batch(sentences(spark)).collect()}
    assert got == WANTED


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped after the first file, it knows what it learned when the second comes; and the log holds both."""
    rows = sentences(spark)
    early, late = (rows.filter(c).coalesce(1) for c in ("seq <= 4", "seq > 4"))
    early.write.parquet(f"{tmp_path}/early")
    late.write.parquet(f"{tmp_path}/late")
    source = tmp_path / "in"
    source.mkdir()

    def answers():
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{source}")
        return session.run_available(session.session_answers(stream), f"file://{tmp_path}/answers", "append")

    def logs():
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{source}")
        return session.latest_by_key(session.run_available(session.session_logs(stream), f"file://{tmp_path}/logs", "update"))

    for part, known in (("early", range(1, 5)), ("late", range(1, 10))):
        for f in (tmp_path / part).glob("*.parquet"):
            shutil.copy(f, source / f"{part}-{f.name}")
        assert sorted((r["seq"], (r["corrected"], r["hits"])) for r in answers().collect()) == [(i, WANTED[i]) for i in known]
        found = {r["key"]: [e["seq"] for e in r["entries"]] for r in logs().collect()}
        assert found == {k: [s for x, _, s, *_ in ROWS if x == k and s in known] for k in "ab"}


def test_totals_go_on(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "x z"), ("b", 1, "x")], "key string, ts int, text string")
    for i in (1, 2):
        rows.filter(f"ts = {i}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in/*")
        out = session.latest_by_key(session.run_available(session.session_totals(stream), f"file://{tmp_path}/run", "update"))
        assert key(out, "key", "n_rows", "n_hits", "n_misses") == ([("a", 1, 0, 2), ("b", 1, 0, 1)] if i == 1 else [("a", 2, 1, 3), ("b", 1, 0, 1)])


def test_appended_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "input string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # what was appended is not appended again
        session.append_log(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/log", f"file://{tmp_path}/state").awaitTermination()
    assert key(versioned.read(spark, f"file://{tmp_path}/log"), "input", "n") == [("a", 1), ("b", 2)]


def plain_sentences(pieces, until, pause=60):
    """What is typed, session by session: pieces (key, second, seq, text)."""
    by, out = defaultdict(list), []
    for k, s, q, t in pieces:
        if t is not None and s <= until:
            by[k].append((s, q, t))
    for k, typed in by.items():
        found, text, last = [], "", None
        for s, _, t in [*sorted(typed), (None, 0, "")]:
            if last is not None and (s is None and last + pause < until or s is not None and s - last > pause):
                found.append(text + "\0")
                text = ""
            text, last = text + t, s
        found.append(text)
        said = []
        for run in found:
            for m in re.finditer(r"[^.!?]*[.!?]|[^.!?]+", run.rstrip("\0")):
                x = m.group().strip(" \t\n\r\f\v")
                if (x[-1:] in ".!?" or run.endswith("\0")) and x.strip(".!?"):
                    said.append((x, x[-1:] in ".!?"))
        out += [(k, i, x, f) for i, (x, f) in enumerate(said, 1)]
    return sorted(out)


def typed_rows(seed):
    rng = random.Random(seed)
    out = []
    for k in "abc":
        at = 0
        for q in range(40):
            at += rng.choice([0, 1, 1, 2, 5, 70])
            out.append((k, at, q, rng.choice(["Hello", " wörld", ".", "!", "?!", " ", "a. b", "\n", "...", " x", None])))
    return [*out, ("a", out[0][1] + 100_000, 0, "the end")]


def pieces_of(spark, rows):
    df = spark.createDataFrame(rows, "key string, at long, seq long, piece string")
    return df.select("key", F.timestamp_seconds("at").alias("ts"), "seq", "piece")


def test_sentences_of_keystrokes(spark, tmp_path):
    """In any order within a micro-batch, stopped and run on, the stream gives what is typed; and so does the finished table."""
    rows = sorted((r for r in typed_rows(1)), key=lambda r: r[1])
    until = rows[-1][1] - 10
    rng = random.Random(2)
    cut = [rows[:30], rows[30:70], rows[70:]]
    source = tmp_path / "in"
    source.mkdir()
    seen = []
    for i, part in enumerate(cut):
        rng.shuffle(part)
        pieces_of(spark, part).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        for f in (tmp_path / str(i)).glob("*.parquet"):
            shutil.copy(f, source / f"{i}-{f.name}")
        seen += part
        stream = spark.readStream.schema("key string, ts timestamp, seq long, piece string").parquet(f"file://{source}")
        found = session.run_available(typing.typed_sentences(stream), f"file://{tmp_path}/run", "append")
        got = sorted(tuple(r) for r in found.select("key", "number", "sentence", "finished").collect())
        assert got == plain_sentences(seen, max(r[1] for r in seen) - 10)
    batch = typing.typed_sentences_batch(pieces_of(spark, rows), F.timestamp_seconds(F.lit(until)))
    assert sorted(tuple(r) for r in batch.collect()) == got
    everything = typing.typed_sentences_batch(pieces_of(spark, rows))
    assert sorted(tuple(r) for r in everything.collect()) == plain_sentences(rows, 10**9)


def test_state_is_handed_over(spark, tmp_path):
    """What one query has learned, another begins with; the two give what one long run gives."""
    rows = sentences(spark)
    parts = [rows.filter(c).coalesce(1) for c in ("seq <= 4", "seq > 4")]
    got = {}
    for i, part in enumerate(parts):
        part.write.parquet(f"{tmp_path}/in{i}")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in{i}")
        known = session.learned(spark, f"file://{tmp_path}/run0") if i else None
        if i:
            assert sorted(tuple(r) for r in known.collect()) == [("a", "teh", "ten"), ("b", "cat", "dog")]
            known.write.parquet(f"{tmp_path}/kept")
            known = spark.read.parquet(f"{tmp_path}/kept")
        found = session.run_available(session.session_answers(stream, known), f"file://{tmp_path}/run{i}", "append")
        got |= {r["seq"]: (r["corrected"], r["hits"]) for r in found.collect()}
    assert got == WANTED


class CountedState:
    """A state variable of one key in memory that counts its calls."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def exists(self):
        self.calls += 1
        return bool(self.held) or self.value is not None

    def containsKey(self, k):
        self.calls += 1
        return k in self.held

    def getValue(self, k):
        self.calls += 1
        return self.held.get(k)

    def updateValue(self, k, v):
        self.calls += 1
        self.held[k] = v

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_state_is_called_once_a_word_and_micro_batch():
    """However many rows a session has."""
    answers, totals = session.SessionCorrections(), session.SessionCache()
    answers.cache = CountedState()
    totals.seen, totals.totals, totals.last = CountedState(), CountedState(), CountedState()
    for batch in (0, 1):
        rows = [Row(key="a", ts=batch * 1000 + i, seq=i, text=f"teh cat {i % 2}", word="teh", correction=f"the{i}") for i in range(1000)]
        told = list(answers.handleInputRows(("a",), iter(rows[::-1]), None))
        assert [r["corrected"] for r in told[:2]] == [["teh", "the999"][batch] + " cat 0", "the0 cat 1"] and len(told) == 1000
        assert list(totals.handleInputRows(("a",), iter(rows[::-1]), None)) == [Row(key="a", n_rows=1000 * (batch + 1), n_skipped=0, n_hits=3000 * (batch + 1) - 4, n_misses=4)]
    assert answers.cache.calls < 20 and totals.seen.calls < 20
