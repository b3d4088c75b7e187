"""Row numbers and exact splits over a whole table, without one task that holds all rows.

Rows are dealt into ranges of the order, numbered within their range, and shifted by
the sizes of the ranges before; only those sizes, one for each partition, meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillwork.sources.shared import shared_table


def with_row_number(df: DataFrame, *order: Column | str, name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 in this order; give an order without ties for numbers that never change."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = shared_table(ranged, "ordered").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # One row for each partition of the shuffle: bounded by spark.sql.shuffle.partitions.
    numbered = placed.join(F.broadcast(before), "_range")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_range", "_at", "_before")


def shuffled_split(df: DataFrame, share: float = 0.9, *columns: str) -> DataFrame:
    """Adds row_number in the order of a content hash (then of the content), and split: train for exactly floor(n * share) rows, else eval."""
    names = columns or tuple(df.columns)
    numbered = with_row_number(df.withColumn("_h", F.md5(F.concat_ws("\u0001", *names))), "_h", *names).drop("_h")
    n = numbered.count()
    return numbered.withColumn("split", F.when(F.col("row_number") <= int(n * share), "train").otherwise("eval"))
