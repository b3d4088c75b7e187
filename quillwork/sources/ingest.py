"""Reading many files of JSON lines in one pass that counts, and sets aside what is malformed."""

from __future__ import annotations

import logging
from collections import deque
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from quillwork.sources.readers import existing
from quillwork.sources.shared import shared_folder

log = logging.getLogger(__name__)


@dataclass
class Ingested:
    """rows: those of the schema, with the file each came from (_file).  bad: malformed lines (_file, line).  Counts are of the pass that wrote both."""

    rows: DataFrame
    bad: DataFrame
    n_rows: int
    n_bad: int
    missing: list[str]


def ingest_jsonl(spark: SparkSession, paths: list[str], schema: str, where: str | None = None) -> Ingested:
    """JSON lines of these files and folders, packed or not; blank lines are no rows, missing paths are named and warned of.

    One pass writes the good rows and the malformed lines to folders beside each other, under `where`
    or else in the shared folder, and counts them as it goes.
    """
    there, missing = existing(spark, paths)
    for p in missing:
        log.warning("%s is missing", p)
    fields = T._parse_datatype_string(schema)
    names = [f.name for f in fields.fields]
    where = where or shared_folder(spark, "ingested")
    told = T.StructType([*fields.fields, T.StructField("_line", T.StringType())])
    out = T.StructType([*told.fields, T.StructField("_file", T.StringType())])
    n = bad = 0
    if there:
        read = spark.read.schema(told).json(there, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
        seen, is_bad = Observation(), F.col("_line").isNotNull()
        counted = read.withColumn("_file", F.col("_metadata.file_path")).withColumn("_is_bad", is_bad)
        counted = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(is_bad).alias("bad"))
        counted.write.partitionBy("_is_bad").parquet(where)
        n, bad = seen.get["n"], seen.get["bad"]
        if bad:
            log.warning("%d of %d lines are malformed", bad, n)
    part = lambda flag: spark.read.schema(out).parquet(f"{where}/_is_bad={flag}") if (n - bad if flag == "false" else bad) else spark.createDataFrame([], out)
    return Ingested(part("false").select(*names, "_file"), part("true").select("_file", F.col("_line").alias("line")), n - bad, bad, missing)


class ProgressLog(StreamingQueryListener):
    """Keeps what streams report of each micro-batch, the last `kept` reports: query, batch, rows read, seconds, and the metrics that were observed."""

    def __init__(self, kept: int = 1000):
        self.entries: deque[dict[str, Any]] = deque(maxlen=kept)
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event: Any) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        self.entries.append({"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "observed": {k: v.asDict() for k, v in p.observedMetrics.items()}})
        log.info("stream %s: batch %d, %d rows", p.id, p.batchId, p.numInputRows)

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended[str(event.id)] = event.exception

    def rows_read(self, query: str) -> int:
        return sum(e["rows"] for e in self.entries if e["query"] == query)
