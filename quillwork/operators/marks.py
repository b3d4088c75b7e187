"""Marks on a text: where corrections apply, and accepting one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import any_case, preserve_case, sums_before

#: Originals that one automaton holds; more are dealt to several, each of which passes over the texts.
ORIGINALS = 500_000


def mark_occurrences(texts: DataFrame, corrections: DataFrame | Column, key: str = "key", text: str = "text") -> DataFrame:
    """key, from, to, shown, correction: each occurrence, whatever its case, of a correction's original between non-word characters.

    corrections: a table key, original, corrected, a few for each text, or one array of
    (original, corrected) for all texts; empty originals are left out.
    Offsets count from 0; occurrences are taken from left to right and do not overlap.
    Cutting the text at the original gives them within the row.
    """
    if isinstance(corrections, Column):
        met = texts.select(key, F.col(text).alias("_t"), F.inline(F.array_distinct(corrections))).filter("original <> ''")
    else:
        met = texts.select(key, F.col(text).alias("_t")).join(corrections.filter("original <> ''").select(key, "original", "corrected").distinct(), key)
    parts = F.split("_t", any_case(F.col("original")))
    # Each part but the last ends where an occurrence starts.
    starts = F.transform(sums_before(F.transform(parts, lambda x: F.length(x) + F.length("original"))), lambda n: n - F.length("original"))
    found = met.select(key, "_t", "original", "corrected", F.explode(F.slice(starts, 2, 1 << 30)).alias("from")).withColumn("to", F.col("from") + F.length("original"))
    is_word = lambda at: F.substring("_t", at, F.lit(1)).rlike(r"\w")
    alone = ~((F.col("from") > 0) & is_word(F.col("from"))) & ~is_word(F.col("to") + 1)
    shown = F.substring("_t", F.col("from") + 1, F.length("original"))
    return found.filter(alone).select(key, "from", "to", shown.alias("shown"), preserve_case(shown, "corrected").alias("correction"))


_WORD = re.compile(r"\w", re.ASCII)


def lower_in_place(text: str) -> str:
    """Lower case, letter by letter, of the same length: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _bordered(word: str) -> bool:
    """Whether it can overlap with itself: a beginning is also an end."""
    return any(word.endswith(word[:n]) for n in range(1, len(word)))


class Marker:
    """One automaton over all originals; a pass over a text finds the occurrences of each."""

    def __init__(self, originals: list[str]):
        from ahocorasick import Automaton

        self.automaton = Automaton()
        for o in originals:
            self.automaton.add_word(o, (o, len(o), _bordered(o)))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Iterator[tuple[int, int, str]]:
        """start, end, original (lower case): occurrences of an original from left to right that do not overlap, those between non-word characters, by their ends."""
        low, free = lower_in_place(text), {}
        for last, (original, n, bordered) in self.automaton.iter(low):
            start, end = last - n + 1, last + 1
            if bordered:
                if start < free.get(original, 0):
                    continue
                free[original] = end
            if not (start and _WORD.match(text, start - 1)) and not _WORD.match(text, end):
                yield start, end, original


def mark_all(texts: DataFrame, corrections: DataFrame, key: str = "key", text: str = "text", originals: int = ORIGINALS) -> DataFrame:
    """key, from, to, shown, correction: each occurrence in each text of the original of any correction (original, corrected), as mark_occurrences has it.

    A text is passed over once for every `originals` distinct originals, lower-cased; each occurrence
    is then joined with the corrections of its original, of which it may have several.
    Null texts have none; null and empty originals are left out; repeated corrections count once.
    """
    known = corrections.filter("original <> '' AND corrected IS NOT NULL").select(_lower(F.col("original")).alias("_o"), "corrected").distinct()
    n = known.select("_o").distinct().count()
    groups = max(1, -(-n // originals))
    schema = f"_k {texts.schema[key].dataType.simpleString()}, from int, to int, shown string, _o string"
    rows = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def pass_over(g: int) -> DataFrame:
        # At most about `originals` short texts: what a task holds in any case.
        words = [r[0] for r in known.filter(F.pmod(F.xxhash64("_o"), F.lit(groups)) == g).select("_o").distinct().collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marker = Marker(words) if words else None
            for b in batches:
                row, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t and marker:
                        for a, e, o in marker(t):
                            row.append(i)
                            found.append((a, e, t[a:e], o))
                start, end, shown, original = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(shown, pa.string()), pa.array(original, pa.string())], ["_k", "from", "to", "shown", "_o"])

        return rows.mapInArrow(run, schema)

    found = pass_over(0)
    for g in range(1, groups):
        found = found.unionByName(pass_over(g))
    return found.join(known, "_o").select(F.col("_k").alias(key), "from", "to", "shown", preserve_case("shown", "corrected").alias("correction"))


@F.pandas_udf(T.StringType())
def _lower(word: pd.Series) -> pd.Series:
    return word.map(lower_in_place, na_action="ignore")


def suggestion_for(word: Column, corrections: Column) -> Column:
    """The corrected form in the first of the corrections for this word, ignoring case; null without one."""
    return F.try_element_at(F.filter(corrections, lambda c: F.lower(c["original"]) == F.lower(word)), F.lit(1))["corrected"]


def accept_correction(text: Column, start: Column, end: Column, corrected: Column) -> Column:
    """The text with the characters from start up to end (from 0) replaced."""
    return F.concat(F.substring(text, F.lit(1), start), corrected, F.substring(text, end + 1, F.lit(1 << 30)))


def remaining_corrections(corrections: Column, accepted: Column) -> Column:
    """The corrections without those of the accepted word, ignoring case."""
    return F.filter(corrections, lambda c: F.lower(c["original"]) != F.lower(accepted))
