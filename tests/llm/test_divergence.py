"""The audit of sources against a plain count, and its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from quillwork.llm import queries
from quillwork.llm import source_divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = "alpha Beta ÄPFEL gamma's " * 40_000
ROWS = [
    (1, "the cat sat on the mat", "en", "a"),
    (2, "The DOG sat; on THE log", "en", "a"),
    (3, "a cat and a dog, the end", "en", "b"),
    (4, "Ärger ÄRGER ärger the_end x2y", "en", "b"),
    (5, "the the the é", "en", "c"),
    (5, "the the the é", "en", "c"),
    (6, None, "en", "d"),
    (7, "1234 -- _", "en", "e"),
    (8, "der hund und die katze", "de", "a"),
    (9, "der hund und der baum", "de", "b"),
    (10, "der hund", "de", None),
    (None, "der hund und", None, None),
    (11, "der hund und", None, "a"),
    (12, "der baum", "", "a"),
    (13, "der baum und", "", "z"),
    (14, "lone words here", "fr", "only"),
    (15, "lone words here", "fr", "only"),
    (16, "lone words", "fr", "only"),
    (17, "none kept", "xx", "p"),
    (18, "at all", "xx", "q"),
    (19, LONG, "en", "a"),
    (20, "alpha beta", "en", "b"),
    (21, "alpha äpfel Äpfel", "en", "f"),
]


def plainly(rows, min_docs, top):
    tf, df, groups = Counter(), Counter(), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall((text or "").translate(LOWER))
        tf.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        v, n = len(kept), {s: sum(tf[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (tf[lang, s, t] + 1) // (n[s] + v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(tf[lang, s, t] for s in sources) + 1) // (sum(n.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s, t], p[o, t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s, t], q[t])) for t in kept if tf[lang, s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (2, 2), (1, 3)])
def test_against_plain_counts(spark, min_docs, top):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    found = D.source_divergence(docs, min_docs=min_docs, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plainly(ROWS, min_docs, top)


def test_large_counts_are_exact(spark):
    """Counts that overflow a long when they are scaled."""
    big = 10**13
    df = spark.createDataFrame([(big, 3 * big, 7)], "c long, n long, v long").select(D.share(*(D.F.col(x) for x in "cnv")).alias("p"))
    assert df.first()[0] == 1 + 10**9 * (big + 1) // (3 * big + 7)


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_source_divergence(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and {tuple(r) for r in wanted} == plainly(ROWS, 3, 200)
