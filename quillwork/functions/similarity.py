"""Similarity of words: edit distance, common subsequence, their blend, and the matching-block ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.matching import most_ratio, ratio


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal words, 0 if one is empty."""
    far = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / far)


def _lcs(a: str, b: str) -> int:
    """Bit-parallel: one bit for each position of a, one step for each letter of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; null if one is null."""
    return pd.Series([None if x is None or y is None else _lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def blended_score(a: Column, b: Column, lcs: Column) -> Column:
    """Length 0.1, first letter 0.2 (half for another), common subsequence 0.3, edit distance 0.4, summed in this order."""
    far = F.greatest(F.length(a), F.length(b)).cast("double")
    length = 1 - F.abs(F.length(a) - F.length(b)) / far
    first = F.when(F.substring(a, 1, 1) == F.substring(b, 1, 1), F.lit(1.0)).otherwise(F.lit(0.5))
    edit = 1 - F.levenshtein(a, b) / far
    return length * F.lit(0.1) + first * F.lit(0.2) + (lcs / far) * F.lit(0.3) + edit * F.lit(0.4)


def lcs_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Least and most that the common subsequence can have, given the edit distance.

    What stays in place in an edit is common; and what is common leaves the other letters
    to be taken out and put in, which no edit needs more steps for.
    """
    n, m, d = F.length(a), F.length(b), F.levenshtein(a, b)
    return F.greatest(n, m) - d, F.least(n, m, F.floor((n + m - d) / 2).cast("int"))


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of the lower-cased texts, popular letters of long texts set aside; not symmetric."""
    return pd.Series([None if x is None or y is None else ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def matches_above(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether matching_ratio is above the least; blocks are looked for only where the letters that both have allow it."""

    def above(x: str | None, y: str | None, n: float) -> bool | None:
        if x is None or y is None or pd.isna(n):
            return None
        x, y = x.lower(), y.lower()
        return most_ratio(x, y) > n and ratio(x, y) > n

    return pd.Series([above(*r) for r in zip(a, b, least, strict=True)], dtype="object")
