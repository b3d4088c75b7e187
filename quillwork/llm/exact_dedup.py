"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

The grouping key is (hash, normalised text).  Spark shuffles on it with map-side
combining, so each partition sends one row per text that it holds: a group with a
third of all rows costs no more than any other, and equality of the key is
equality of bytes.  The classes lose their text before they meet the rows again,
on the hash alone; only texts of hashes that turned out to stand for more than
one text (none, short of a broken hash) are joined with their bytes.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm._common import keep_named, write_scratch


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def dedup_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per different text: _h, _norm, keep_id, group_size."""
    norm = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_norm"))
    pick = F.max if keep == "max" else F.min
    return norm.groupBy(content_hash(F.col("_norm")).alias("_h"), "_norm").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """Every row's decision: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty
    one.  keep='min' keeps the smallest id of a group, 'max' the largest.  Rows that
    repeat an id and its text are one document and share their decision.  Null ids
    never win over others; a group of null ids only has keep_id null and keeps
    nothing.  An empty table gives an empty result.  Columns other than the two
    named are not read, so their names cannot clash.
    """
    full = dedup_classes(docs, id_col, text_col, keep, content_hash)
    classes = write_scratch(full.select("_h", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-classes")
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.col(text_col)).alias("_norm")).withColumn("_h", content_hash(F.col("_norm")))
    shared = classes.groupBy("_h").count().filter("count > 1").select("_h")
    if not shared.isEmpty():
        # Two texts under one hash: these rows are told apart by their bytes.
        shared = write_scratch(shared, "dedup-shared")
        apart = full.join(shared, "_h", "left_semi").withColumn("text_sha256", F.sha2("_norm", 256))
        same = rows.join(shared, "_h", "left_semi").join(apart, ["_h", "_norm"]).drop("_norm")
        lone = classes.join(shared, "_h", "left_anti")
        found = rows.drop("_norm").join(lone, "_h").unionByName(same)
    else:
        # Both sides go straight from a scan to the shuffle, so AQE splits a hot hash.
        found = rows.drop("_norm").hint("merge").join(classes, "_h")
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs with one document of each group of equal texts, all columns as they were.

    The smallest (keep='max': the largest) id stays; a group of null ids only keeps one of
    its rows.  Rows that share an id for different texts are told apart by the text; of
    rows that share both, letter case aside, any one stays.  An empty table stays empty.
    """
    kept = dedup_classes(docs, id_col, text_col, keep).select(F.col("keep_id").alias("_id"), "_norm")
    mark = F.sha2(ascii_lower(F.col(text_col)), 256)
    return keep_named(docs, kept.select("_id"), id_col, kept.select("_id", F.sha2("_norm", 256).alias("_mark")), mark)
