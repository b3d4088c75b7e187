"""Word-level differences of an original sentence and its correction: one row a word, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.similarity import edit_similarity
from quillwork.functions.text import clean_ends, match_case, split_words_keeping_empty, strip_reply_prefix
from quillwork.sources.constants import VALID_WORDS

DRIFT, LEAST, SAME_PLACE, GUARD = 2, 0.3, 0.1, 3
#: Up to so many letters no other word beats an equal one beside it: one edit in nine or more must cost a tenth at most.
SHORT = 8


def once(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """Kept columns and new ones that are worked out once a row, however often later expressions read them: they go through a generator, which no later projection is merged with."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def sentence_changes(rows: DataFrame, *keys: str, original: str = "original", corrected: str = "corrected", upper: Callable[[Column], Column] = F.upper) -> DataFrame:
    """keys, i (the word's place, from 0), original, corrected: the changed words of each row.

    Each word looks two places to either side for the most similar corrected word,
    the same place counting a tenth more, the first of equals winning; similarity must
    pass 0.3.  Sentences whose word counts differ by more than three have no changes.
    The case of what is shown is matched by `upper`.
    """
    split = once(rows, *keys, _a=split_words_keeping_empty(original), _b=F.transform(split_words_keeping_empty(strip_reply_prefix(corrected)), clean_ends))
    near_enough = split.filter(F.abs(F.size("_a") - F.size("_b")) <= GUARD)

    def beside(word: Column, i: Column) -> Column:
        start = F.greatest(i - DRIFT, F.lit(0))
        return F.struct(word.alias("word"), start.alias("start"), F.slice("_b", start + 1, F.greatest(F.least(F.size("_b"), i + DRIFT + 1) - start, F.lit(0))).alias("near"))

    words = near_enough.select(*keys, F.posexplode(F.transform("_a", beside)).alias("i", "_w"))
    words = once(words, *keys, "i", _clean=clean_ends("_w.word"), _shown=F.regexp_extract("_w.word", "[a-zA-Z',]+", 0), _start=F.col("_w.start"), _near=F.col("_w.near"))
    words = words.filter((F.length("_clean") >= 2) & ~F.col("_clean").isin(VALID_WORDS) & (F.col("_shown") != ""))
    # Most words are as they were: an equal one in the same place wins, and so does one beside it if it is short.
    here = F.coalesce(F.get("_near", F.col("i") - F.col("_start")) == F.col("_clean"), F.lit(False))
    words = words.filter(~here & ~((F.length("_clean") <= SHORT) & F.array_contains("_near", F.col("_clean"))))
    scored = once(words, *keys, "i", "_clean", "_shown", _found=F.transform("_near", lambda w, k: F.struct(edit_similarity(F.col("_clean"), w).alias("s"), F.when(F.col("_start") + k == F.col("i"), F.lit(SAME_PLACE)).otherwise(F.lit(0.0)).alias("bonus"), w.alias("w"))))
    start_at = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("w"))
    take = lambda acc, x: F.when(x["s"] + x["bonus"] > acc["score"], F.struct((x["s"] + x["bonus"]).alias("score"), x["w"].alias("w"))).otherwise(acc)
    best = F.aggregate(F.filter("_found", lambda x: (x["w"] != "") & (x["s"] > LEAST)), start_at, take)["w"]
    found = once(scored, *keys, "i", "_clean", "_shown", _best=best).filter(F.col("_best").isNotNull() & (F.col("_best") != F.col("_clean")))
    return found.select(*keys, "i", F.col("_shown").alias("original"), match_case("_shown", "_best", upper).alias("corrected"))
