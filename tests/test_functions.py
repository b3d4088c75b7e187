"""Scalar functions against values derived by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions import text as T
from quillwork.functions.phonetic import double_metaphone, metaphone_codes
from quillwork.functions.similarity import _lcs, blended_score, edit_similarity, lcs_length, matching_ratio

letters = st.text("abcdé", max_size=9)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(letters, letters)
@settings(max_examples=200, deadline=None)
def test_lcs_is_the_textbook_one(a, b):
    assert _lcs(a, b) == slow_lcs(a, b) <= min(len(a), len(b))


@pytest.mark.parametrize(("a", "b", "edit", "lcs"), [("becuase", "because", 2, 6), ("enuff", "enough", 3, 3), ("", "x", 1, 0), ("same", "same", 0, 4)])
def test_distances(spark, a, b, edit, lcs):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(F.levenshtein("a", "b"), lcs_length("a", "b")).first()
    assert tuple(got) == (edit, lcs)


def test_blended_score(spark):
    rows = spark.createDataFrame([("im", "i'm"), ("becuase", "because")], "a string, b string")
    got = [r[0] for r in rows.select(blended_score(F.col("a"), F.col("b"), lcs_length("a", "b"))).collect()]
    assert got[0] == pytest.approx(2 / 3 * 0.1 + 0.2 + 2 / 3 * 0.3 + 2 / 3 * 0.4)
    assert got[1] == pytest.approx(0.1 + 0.2 + 6 / 7 * 0.3 + 5 / 7 * 0.4)


def test_edit_similarity(spark):
    got = spark.createDataFrame([("a", "a"), ("", "a"), ("teh", "the"), ("", "")], "a string, b string").select(edit_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([1, 0, 1 - 2 / 3, 1])


def test_matching_ratio(spark):
    got = spark.createDataFrame([("Abcd", "bcde"), (None, "a")], "a string, b string").select(matching_ratio("a", "b")).collect()
    assert got[0][0] == pytest.approx(0.75) and got[1][0] is None


@pytest.mark.parametrize(
    ("word", "codes"),
    [("because", ("PKS", "PKS")), ("becuase", ("PKS", "PKS")), ("thought", ("0T", "TT")), ("enough", ("ANK", "ANK")), ("laugh", ("LF", "LF")), ("smith", ("SM0", "XMT")), ("schmidt", ("XMT", "SMT")), ("knight", ("NT", "NT")), ("church", ("XRX", "XRK")), ("caesar", ("SSR", "SSR")), ("phone", ("FN", "FN")), ("", ("", "")), ("'", ("", ""))],
)
def test_metaphone(word, codes):
    assert metaphone_codes(word) == codes


def test_metaphone_ends_on_any_letters(spark):
    rng = random.Random(5)
    for _ in range(3000):
        metaphone_codes("".join(rng.choice("abcdefghijklmnopqrstuvwxyzçñé '") for _ in range(rng.randint(0, 12))))
    assert spark.sql("SELECT 'x' AS w").select(double_metaphone("w")).first()[0] == ["S", "S"]


def test_tokens(spark):
    assert one(spark, T.words("t"), t="Don't über-see 2x they_re OK") == ["don", "t", "see", "ok"]
    assert one(spark, T.split_words("t"), t="  a  b ") == ["a", "b"]
    assert one(spark, T.split_words_keeping_empty("t"), t=" a b") == ["", "a", "b"]
    assert "".join(one(spark, T.tokens_with_separators("t"), t=" a\n b ")) == " a\n b "
    assert one(spark, T.strip("t"), t=" \t x \n") == "x"


def test_cleaning(spark):
    assert one(spark, T.clean("t"), t='"Don\'t!"') == "dont"
    assert one(spark, T.clean("t"), t="Été") == "t" and one(spark, T.clean("t", unicode=True), t="(Été)") == "été"
    assert one(spark, T.clean_keeping_apostrophes("t"), t='"Don\'t!"') == "don't"
    assert one(spark, T.clean_ends("t"), t="(Ab-c')") == "ab-c'"
    assert one(spark, T.letters_only("t", apostrophes=True), t="I'm 2") == "i'm"


@pytest.mark.parametrize(("o", "matched", "kept"), [("TEH", "THE", "THE"), ("Teh", "The", "the"), ("teh", "the", "the"), ("I", "THE", "THE"), ("tEh", "the", "the")])
def test_case(spark, o, matched, kept):
    assert one(spark, T.match_case("o", "c"), o=o, c="the") == matched
    assert one(spark, T.preserve_case("o", "c"), o=o, c="the") == kept


def test_replies(spark):
    assert one(spark, T.strip_reply_prefix("t"), t="Here's the corrected sentence: Hi you.") == "Hi you."
    assert one(spark, T.strip_thinking("t"), t="<think>x</think>\nyes\nno") == "yes"
    assert one(spark, T.strip_thinking("t"), t="yes <think> hm") == "yes"
    assert one(spark, T.first_word("t"), t="\n the best\nx") == "the"
    assert one(spark, T.first_word("t"), t="  ") == ""
    assert one(spark, T.hinted_word("t"), t='HINT: "they\'re" means') == "they're"


def test_changes(spark):
    ask = lambda t: [tuple(x) for x in one(spark, T.parse_changes("t", {"the"}), t=t)]
    assert ask("CHANGES: none") == []
    assert ask("hm\nchanges: teh->the, frend -> friend.") == [("teh", "the"), ("frend", "friend")]
    assert ask("CHANGES: a, b->c->d, x->X, the->teh, ->y") == []
    assert ask("no marker") == []
    fixed = T.apply_changes("t", T.parse_changes(F.lit("CHANGES: teh->the, a.c->x")))
    assert one(spark, fixed, t="Teh abc teh") == "the abc teh"
    assert one(spark, T.keep_punctuation("w", "c"), w='"(teh)', c="the") == 'the"()'
