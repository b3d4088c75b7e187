"""Offsets, marks and matching blocks: by definition on random texts, and linear on long ones."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import matching, text
from quillwork.functions.similarity import matches_above, matching_ratio
from quillwork.operators import correct, marks


def test_sums_before(spark):
    given = [[3, 1, 4], [], None, [5], [0, 0, 2]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x array<int>").repartition(2)
    got = {r["i"]: r["s"] for r in df.select("i", text.sums_before("x").alias("s")).collect()}
    assert got == {0: [0, 3, 4], 1: [], 2: None, 3: [0], 4: [0, 0, 0]}
    # A slice of a larger column, with nulls before it.
    assert [r["s"] for r in df.filter("i > 2").orderBy("i").select(text.sums_before("x").alias("s")).collect()] == [[0], [0, 0, 0]]


def test_offsets_of_a_long_text(spark):
    words = 160_000
    said = "wörd \n" * words
    df = spark.createDataFrame([("a", said), ("b", None), ("c", "")], "key string, sentence string")
    correct.tokens(df.filter("key <> 'a'")).collect()
    began = time.perf_counter()
    found = correct.tokens(df).agg(F.count("*").alias("n"), F.max("position").alias("last"), F.sum("position").alias("all")).first()
    assert time.perf_counter() - began < 30
    places = [m.start() for m in re.finditer(r"\s+|\S+", said)]
    assert (found["n"], found["last"], found["all"]) == (len(places), places[-1], sum(places))


def plain_marks(said, fixes):
    """Each original on its own: found from left to right, letter by letter whatever its case."""
    same = lambda a, b: a == b or a.lower() == b.lower()
    word = lambda c: re.match(r"\w", c, re.ASCII) is not None
    out = []
    for original, corrected in {(marks.lower_in_place(o), c) for o, c in fixes if o}:
        at, n = 0, len(original)
        while at + n <= len(said):
            if not all(same(x, y) for x, y in zip(said[at : at + n], original, strict=True)):
                at += 1
                continue
            if not (at and word(said[at - 1])) and not (at + n < len(said) and word(said[at + n])):
                shown = said[at : at + n]
                out.append((at, at + n, shown, corrected.upper() if shown == shown.upper() else corrected.lower() if shown == shown.lower() else corrected))
            at += n
    return sorted(out)


TEXTS = ["Teh cat, teh TEH ateh teh.", "İstanbul teh İ", "aa aaa aaaa a a-a", "a-a-a-a b", "x \\E y \\Q", "'tis 'TIS tis", None, "", "don't Don't dont", "new york New  York new york", "ß SS straße"]
FIXES = [("teh", "the"), ("Teh", "tea"), ("aa", "bb"), ("a-a", "c"), ("\\E", "E"), ("'tis", "it is"), ("don't", "do not"), ("New York", "Nyc"), ("i̇", "i"), ("", "x"), (None, "y"), ("cat", None), ("straße", "street")]


@pytest.mark.parametrize("originals", [500_000, 2])
def test_mark_all(spark, originals):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "key int, text string").repartition(2)
    fixes = spark.createDataFrame([*FIXES, FIXES[0]], "original string, corrected string")
    got = marks.mark_all(texts, fixes, originals=originals)
    assert got.columns == ["key", "from", "to", "shown", "correction"]
    usable = [(o, c) for o, c in FIXES if o and c is not None]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *m) for i, t in enumerate(TEXTS) if t for m in plain_marks(t, usable))


def test_mark_occurrences_in_the_text_itself(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "key int, text string")
    usable = [(o, c) for o, c in FIXES if o and c is not None and o not in ("i̇", "Teh")]
    fixes = texts.select("key").crossJoin(spark.createDataFrame(usable, "original string, corrected string"))
    got = marks.mark_occurrences(texts, fixes)
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *m) for i, t in enumerate(TEXTS) if t for m in plain_marks(t, usable))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAb' -", max_size=25), st.lists(st.text(alphabet="ab'-", min_size=1, max_size=4), max_size=6))
def test_marker(said, originals):
    found = marks.Marker(sorted(set(originals)))(said) if originals else []
    got = sorted((a, b, said[a:b]) for a, b, _ in found)
    assert got == sorted((a, b, s) for a, b, s, _ in plain_marks(said, [(o, "x") for o in originals]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_matching_blocks(seed):
    """Equal to the definition, popular letters of long texts included."""
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc ", "abcdefghijklmnopqrstuvwxyz ", "abcdefgh" + "".join(map(chr, range(0x4E00, 0x4F00)))])
    n = rng.choice([5, 30, 199, 200, 260, 400])
    a = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, n))]
    for _ in range(rng.randint(0, 6)):
        if b:
            b[rng.randrange(len(b))] = rng.choice(letters)
            del b[rng.randrange(len(b)) : rng.randrange(len(b)) + rng.randint(0, 1)]
    b = "".join(b)
    wanted = SequenceMatcher(None, a, b).ratio()
    assert matching.ratio(a, b) == wanted and matching.most_ratio(a, b) >= wanted


def test_matching_of_long_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöéx") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    a = [rng.choice(words) for _ in range(20_000)]
    b = [rng.choice(words) if rng.random() < 0.2 else w for w in a]
    began = time.perf_counter()
    for x, y in ((a, b), (a, a), (a, a[::-1]), (["日本語テスト"[rng.randrange(5) :] for _ in range(20_000)], b)):
        assert 0 <= matching.ratio(" ".join(x), " ".join(y)) <= 1
    assert time.perf_counter() - began < 30


def test_threshold(spark):
    rows = [("The cat", "the cat", 0.9), ("abc", "xyz", 0.1), ("abcd", "abce", 0.75), ("abcd", "abce", 0.74), ("", "", 0.5), (None, "a", 0.5), ("a", None, 0.5), ("ab" * 300, "ba" * 300, 0.5)]
    df = spark.createDataFrame(rows, "a string, b string, n double")
    for r in df.select("n", matching_ratio("a", "b").alias("r"), matches_above("a", "b", "n").alias("above")).collect():
        assert r["above"] == (None if r["r"] is None else r["r"] > r["n"])
