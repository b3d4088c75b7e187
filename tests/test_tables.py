"""Tables that change as a whole, sources read in ranges, files with headers of their own."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from quillwork.sources import ingest, readers, shared, sinks, versioned
from quillwork.sources.headed import HeadedList
from quillwork.streaming import session


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "word string, correction int")


def test_append_and_replace(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versioned.read(spark, path) is None
    assert versioned.append(table(spark, "a"), path) and versioned.append(table(spark, "b"), path)
    assert rows(versioned.read(spark, path)) == [("a", 0), ("b", 0)]
    old = versioned.read(spark, path)
    versioned.replace(table(spark, "c"), path)
    assert rows(versioned.read(spark, path)) == [("c", 0)] and rows(old) == [("a", 0), ("b", 0)]
    for v in "def":
        versioned.replace(table(spark, v), path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == versioned.KEPT_VERSIONS
    with pytest.raises(Exception, match="rows of"):
        versioned.append(spark.range(1), path)
    versioned.replace(table(spark), path)
    assert versioned.read(spark, path).count() == 0


def test_a_batch_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versioned.append(table(spark, "a"), path, "s", 0)
    assert not versioned.append(table(spark, "a"), path, "s", 0)
    assert versioned.append(table(spark, "a"), path, "other", 0) and versioned.append(table(spark, "b"), path, "s", 1)
    versioned.compact(spark, path)
    assert not versioned.append(table(spark, "b"), path, "s", 1)
    assert [r[0] for r in rows(versioned.read(spark, path))] == ["a", "a", "b"]


def test_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """Killed while rows are written, between rows and version, and within the version file: the old cache is read each time."""
    path = f"file://{tmp_path}/cache"
    sinks.write_cache(spark.createDataFrame([("teh", "the")], "word string, correction string"), path)
    bad = spark.range(4).select(F.col("id").cast("string").alias("word"), F.when(F.col("id") < 3, F.lit("x")).otherwise(F.raise_error(F.lit("died"))).alias("correction"))
    with pytest.raises(Exception, match="died"):
        sinks.write_cache(bad, path)
    assert rows(versioned.read(spark, path)) == [("teh", "the")]

    def dies(*_):
        raise KeyboardInterrupt

    new = spark.createDataFrame([("frend", "friend")], "word string, correction string")
    with monkeypatch.context() as m:
        m.setattr(versioned, "_publish", dies)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_cache(new, path)
    assert rows(versioned.read(spark, path)) == [("teh", "the")]
    last, _ = versioned.version(spark, path)
    (tmp_path / "cache" / versioned.VERSIONS / str(last + 1)).write_text('{"folders": ["rows-')
    assert rows(versioned.read(spark, path)) == [("teh", "the")]
    sinks.write_cache(new, path)
    assert rows(versioned.read(spark, path)) == [("frend", "friend")]
    # What the dead left is gone, and the table before is still there for readers under way.
    assert len([p for p in (tmp_path / "cache").iterdir() if p.name.startswith("rows-")]) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """One that finds its number taken comes after the other."""
    path, real, taken = f"file://{tmp_path}/t", versioned._publish, []

    def slow(spark, path, number, said):
        if not taken:
            taken.append(number)
            monkeypatch.setattr(versioned, "_publish", real)
            assert versioned.append(table(spark, "first"), path)
        return real(spark, path, number, said)

    monkeypatch.setattr(versioned, "_publish", slow)
    assert versioned.append(table(spark, "second"), path)
    assert [r[0] for r in rows(versioned.read(spark, path))] == ["first", "second"]


def test_log_of_a_repeated_batch(spark, tmp_path):
    """The stream dies after its rows were added and before its checkpoint says so: run again, they are there once."""
    source = spark.createDataFrame([("a", 1), ("b", 2)], "input string, n int")
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")
    path, state = f"file://{tmp_path}/log", tmp_path / "state"
    session.append_log(stream(), path, f"file://{state}").awaitTermination()
    commits = list((state / "commits").glob("*0*"))
    assert commits
    for c in commits:
        c.unlink()
    session.append_log(stream(), path, f"file://{state}").awaitTermination()
    assert rows(versioned.read(spark, path)) == [("a", 1), ("b", 2)]
    spark.createDataFrame([("c", 3)], "input string, n int").write.mode("append").parquet(f"{tmp_path}/in")
    session.append_log(stream(), path, f"file://{state}").awaitTermination()
    assert rows(versioned.read(spark, path)) == [("a", 1), ("b", 2), ("c", 3)]


def plain_list(raw, encoding="latin-1"):
    head, out = None, []
    for line in raw.decode(encoding).replace("\r\n", "\n").split("\n"):
        line = line.strip()
        if line.startswith("$"):
            head = line[1:].replace("_", " ")
        elif line and head is not None and line.replace("_", " ").lower() != head.lower():
            out.append((head, line.replace("_", " ")))
    return sorted(out)


def some_list(seed, n=120):
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        kind = rng.random()
        word = "".join(rng.choice("abcé_") for _ in range(rng.randint(0, 12)))
        lines.append(("$" if kind < 0.15 else "  $" if kind < 0.2 else "" if kind < 0.3 else " \t" if kind < 0.35 else "") + word)
    return rng.choice(["\n", "\r\n"]).join(lines).encode("latin-1") + rng.choice([b"", b"\n"])


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1000, 1 << 20])
def test_headed_list_at_any_split(spark, tmp_path, split):
    """Heads across borders, groups longer than a range, members without a head: both ways of carrying heads give the plain reading."""
    n = 25 if split < 7 else 120
    raw = [some_list(s, n) for s in range(2)] + [b"", b"lone\nlines", b"$head\n" + b"member\n" * 40, b"$a"]
    for i, r in enumerate(raw):
        (tmp_path / f"{i}.dat").write_bytes(r)
    (tmp_path / "z.dat.gz").write_bytes(gzip.compress(raw[0]))
    (tmp_path / "_skipped").write_bytes(b"$x\ny\n")
    wanted = sorted(x for r in [*raw, raw[0]] for x in plain_list(r))
    carried = readers.read_headed_list(spark, f"file://{tmp_path}", keep_counts=True, split_bytes=split)
    spark.dataSource.register(HeadedList)
    looked = readers.members_of(spark.read.format("headed_list").option("split_bytes", split).load(str(tmp_path)), keep_counts=True)
    for found in (carried, looked):
        got = found.select("correct", "misspelling")
        assert sorted((c, m) for c, m in rows(got)) == wanted
    if split == 64:
        assert looked.rdd.getNumPartitions() > 10
        order = [r["misspelling"] for r in carried.filter(F.col("path").endswith("0.dat")).orderBy("pos").collect()]
        head, plain = None, []
        for line in raw[0].decode("latin-1").splitlines():
            line = line.strip()
            head = line if line.startswith("$") else head
            if line and not line.startswith("$") and head and line.replace("_", " ").lower() != head[1:].replace("_", " ").lower():
                plain.append(line.replace("_", " "))
        assert order == plain


def test_headed_list_missing(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        readers.read_headed_list(spark, f"file://{tmp_path}/nowhere").collect()


def test_csv_headers_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wrong,right\nteh,the\nfrend,friend\n")
    (tmp_path / "b.csv").write_text("correct,misspelling\nmonth,onth\nthan,thon\n")
    (tmp_path / "c.csv").write_text('id,label,note,input\n1,"and, so","x,y",nd\n\n2,ton,,tion\n3,lone\n')
    (tmp_path / "d.csv").write_text("nothing,known\na,b\n")
    (tmp_path / "e.csv").write_text("﻿wrong, right\nwrong,right\n")
    (tmp_path / "f.csv").write_text("")
    got = rows(readers.read_pair_csv(spark, f"file://{tmp_path}"))
    assert got == sorted([("teh", "the"), ("frend", "friend"), ("onth", "month"), ("thon", "than"), ("nd", "and, so"), ("tion", "ton"), ("wrong", "right")])
    assert rows(readers.read_pair_csv(spark, f"file://{tmp_path}/f.csv")) == []


def test_ingest_counts_in_one_pass(spark, tmp_path, caplog):
    (tmp_path / "a.jsonl").write_text('{"input": "teh", "output": "the"}\n{bad\n\n{"input": "x"}\n[1\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"input": "y", "other": 1}\n')
    found = ingest.ingest_jsonl(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/none.jsonl", f"{tmp_path}/b.jsonl.gz"], "input string, output string", f"{tmp_path}/out")
    assert (found.n_rows, found.n_bad, found.missing) == (3, 2, [f"{tmp_path}/none.jsonl"])
    assert sorted((r["input"], r["output"], r["_file"].rsplit("/", 1)[1]) for r in found.rows.collect()) == [("teh", "the", "a.jsonl"), ("x", None, "a.jsonl"), ("y", None, "b.jsonl.gz")]
    assert sorted(r["line"] for r in found.bad.collect()) == ["[1", "{bad"]
    assert "none.jsonl is missing" in caplog.text and "2 of 5 lines are malformed" in caplog.text
    for paths in ([f"{tmp_path}/none.jsonl"], [f"{tmp_path}/b.jsonl.gz"]):
        few = ingest.ingest_jsonl(spark, paths, "input string, output string")
        assert few.n_bad == 0 and few.bad.count() == 0 and few.rows.count() == few.n_rows == len(paths) - len(few.missing)


def test_progress_of_streams(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(7)], "n int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = ingest.ProgressLog()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").observe("counts", F.count(F.lit(1)).alias("n"))
        query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows_read(str(query.id)) == 14 and seen.ended == {str(query.id): None}
    assert [e["observed"]["counts"]["n"] for e in seen.entries if e["rows"]] == [7, 7]


def test_clear_shared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "_made", set())
    a, b = shared.shared_table(table(spark, "x"), "one"), shared.shared_folder(spark, "two")
    assert rows(a) == [("x", 0)] and len(shared._made) == 2
    folders = [f.removeprefix("file://") for f in shared._made]
    assert any(os.path.isdir(f) for f in folders) and b in shared._made
    shared.clear_shared(spark)
    assert not shared._made and not any(os.path.exists(f) for f in folders)
