"""Pairs of misspelling and correction: mining, filters, precedence, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import words
from quillwork.sources.constants import CODE_TERMS, MEANING_WORDS


def differs(a: Column, b: Column) -> Column:
    return F.lower(a) != F.lower(b)


def is_code_term(word: Column) -> Column:
    return word.isin(CODE_TERMS)


def is_meaning_change(a: Column, b: Column) -> Column:
    """Both known words, or a plural of words longer than four letters."""
    plural = (F.concat(a, F.lit("s")) == b) | (F.concat(b, F.lit("s")) == a)
    return (a.isin(MEANING_WORDS) & b.isin(MEANING_WORDS)) | (plural & (F.length(a) > 4) & (F.length(b) > 4))


def is_typo_pair(a: Column, b: Column) -> Column:
    near = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 3)
    return (a != b) & near & ~is_code_term(a) & ~is_code_term(b) & ~is_meaning_change(a, b)


def word_typos(source: Column | str, target: Column | str) -> Column:
    """Array of (misspelling, correct) from texts of equally many words, word by word."""
    a, b = words(source), words(target)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("misspelling"), y.alias("correct")))
    return F.when(F.size(a) == F.size(b), F.filter(pairs, lambda p: is_typo_pair(p["misspelling"], p["correct"]))).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def mine_commits(commits: DataFrame, lang: str = "eng") -> DataFrame:
    """misspelling, correct, first seen order lost: distinct pairs of typo edits in this language."""
    edits = F.filter("edits", lambda e: e["is_typo"] & (e["src"]["lang"] == lang))
    return commits.select(F.explode(edits).alias("e")).select(F.inline(word_typos("e.src.text", "e.tgt.text"))).distinct()


def with_distance(pairs: DataFrame) -> DataFrame:
    """Adds edit_distance of the lower-cased sides, and len_diff, signed."""
    return pairs.withColumn("edit_distance", F.levenshtein(F.lower("misspelling"), F.lower("correct"))).withColumn("len_diff", F.length("misspelling") - F.length("correct"))


def combine_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union in order of precedence: source, priority, misspelling, correct, duplicates kept."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("source"), F.lit(i).alias("priority"), "misspelling", "correct") for i, (name, df) in enumerate(sources)])


def keep_first(pairs: DataFrame, *order: str) -> DataFrame:
    """One row for each pair, that which comes first: a minimum, which combines on the map side, not a window."""
    rest = [c for c in pairs.columns if c not in ("misspelling", "correct", *order)]
    first = F.min(F.struct(*order, *rest)).alias("_f")
    return pairs.groupBy("misspelling", "correct").agg(first).select("misspelling", "correct", "_f.*")


def source_statistics(pairs: DataFrame, *order: str) -> DataFrame:
    """source, total, unique_new, pct of all unique pairs, most first."""
    new = keep_first(pairs, *order).groupBy("source").agg(F.count(F.lit(1)).alias("unique_new"))
    both = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("total")).join(new, "source", "left").withColumn("unique_new", F.coalesce("unique_new", F.lit(0)))
    total = new.agg(F.sum("unique_new").alias("_all"))
    return both.crossJoin(F.broadcast(total)).select("source", "total", "unique_new", (F.col("unique_new") / F.col("_all") * 100).alias("pct")).orderBy(F.desc("unique_new"), "source")


def combine_corpora(sources: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Corpora of pairs (misspelling, correct) as one, in order of precedence.

    First: misspelling, correct, source, each pair once, of the first source that has it.
    Second: source, total, unique_new, pct, as source_statistics has them.
    """
    union = combine_sources(sources)
    return keep_first(union, "priority").select("misspelling", "correct", "source"), source_statistics(union, "priority")


def distance_histogram(pairs: DataFrame, first: int | None = None) -> DataFrame:
    """edit_distance, n, pct of all, by ascending distance; the first so many distances, or all."""
    counts = pairs.groupBy(F.levenshtein(F.lower("misspelling"), F.lower("correct")).alias("edit_distance")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    rows = counts.crossJoin(F.broadcast(total)).select("edit_distance", "n", (F.col("n") / F.col("_all") * 100).alias("pct")).orderBy("edit_distance")
    return rows if first is None else rows.limit(first)


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """One row: pairs, distinct correct words (lower case)."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(F.lower("correct")).alias("n_correct"))
