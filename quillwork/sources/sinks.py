"""Sinks: CSV, JSON lines, one-row reports, caches and logs.  Folders of part files, as Spark writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.sources import versioned


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Equal to the reference's lines as JSON, not in bytes: letters beyond ASCII are not escaped."""
    rows.write.mode("overwrite").json(path)


def write_report(summary: DataFrame, path: str) -> None:
    """A small summary (a row for each model and category) as one JSON array."""
    whole = summary.agg(F.to_json(F.collect_list(F.struct(*summary.columns)), {"pretty": "true"}).alias("value"))
    whole.write.mode("overwrite").text(path)


def write_cache(pairs: DataFrame, path: str) -> None:
    """word, correction; replaces the cache before, which stays readable until this one is whole (versioned.read)."""
    versioned.replace(pairs.select("word", "correction"), path)


def clear(spark: SparkSession, path: str) -> None:
    """Delete a cache or a log."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def export_log(log: DataFrame, folder: str, day: str | None = None) -> str:
    """The log as JSON lines in a folder that carries the day (yyyy-MM-dd; today's by the session's clock if none is given); returns its path."""
    day = day or log.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd")).first()[0]
    path = f"{folder}/spelling-log-{day}"
    log.write.mode("overwrite").json(path)
    return path
