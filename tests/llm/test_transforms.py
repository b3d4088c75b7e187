"""Fill-in-middle against a plain reading of its definition, and its SQL."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.llm import fill_in_middle as M
from quillwork.llm import queries

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "  \t ", "a", "a b", " a  b ", "a\x85b c", "ä 😀 x\n\n日本 語 ", "<P> a b", "a <M", "<S", "x <S> y", "\x00 \x1f a", "M> <", "< P> <S <M", "a b c d e f g h"]


@given(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85 aß<PSM>😀", max_size=30))
def test_borders(text):
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = M.token_borders(points).tolist()
    assert [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == TOKEN.findall(text)


def plainly(key, text, rate=50, share=80):
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    t = TOKEN.findall(text or "")
    n = len(t)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text or ""
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if h4 % 100 < share:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "share"), [(50, 80), (100, 50), (0, 80), (100, 0)])
def test_against_definition(spark, rate, share):
    long = "wörd \n" * 300_000
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS * 3)] + [(None, "a b c d", "x"), (None, None, "x"), (7, "twice b c", "x"), (7, "twice b c", "x"), (1000, long, "x"), (1003, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    found = M.fill_in_middle(docs, rate=rate, spm_share=share).withColumn("before", M.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found.collect()), key=str)
    assert got == sorted(((k, *plainly(k, t, rate, share)) for k, t, _ in rows), key=str)
    before = sorted((str(r["doc_id"]), r["before"]) for r in found.collect())
    assert before == sorted((str(k), t or "") for k, t, _ in rows)


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).select(*names).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(f"SELECT {', '.join(names)} FROM ({queries.OP13_SQL})").fetchall())
