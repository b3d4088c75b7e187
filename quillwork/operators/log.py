"""The log of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = 100


def last_entries(log: DataFrame, *order: str, n: int = KEPT) -> DataFrame:
    """The last n entries: a bounded top-n, which every task cuts down before anything is moved."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def source_counts(log: DataFrame) -> DataFrame:
    """One row: corrections by source, and in total, from entries with an array corrections."""
    rows = log.select(F.explode("corrections.source").alias("source"))
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    return rows.agg(F.count_if(F.col("source").isin("phonetic", "llm", "cache")).alias("total"), n("phonetic"), n("llm"), n("cache"))


def with_elapsed(log: DataFrame, since: Column | str = "timestamp", now: Column | None = None) -> DataFrame:
    """Adds age_seconds, the time from an entry's stamp to now (the query's start), and finished, that moment."""
    at = F.current_timestamp() if now is None else now
    stamp = F.col(since) if isinstance(since, str) else since
    return log.withColumn("finished", at).withColumn("age_seconds", F.col("finished").cast("double") - stamp.cast("timestamp").cast("double"))
