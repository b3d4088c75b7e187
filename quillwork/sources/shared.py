"""Tables that every executor sees: lineage ends in them, and they outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made and not deleted.
_made: set[str] = set()


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillwork-')}"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder there, for a table, a stream's state or a file set."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Written to a new folder there and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete all folders of this process.  Results that still read them (they are lazy) must have been written before."""
    for folder in sorted(_made):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.clear()
