"""What the operators share: tables, scratch tables, learn/held-out folds, batches bounded by bytes, rows that stay."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 1 << 21
#: Scratch tables that this process has written and not deleted.
_written: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillwork-')}"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; only a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def write_scratch(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to a new table in the shared folder and read it: lineage ends here."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Delete the tables behind write_scratch results that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)
            _written.difference_update([p for p in _written if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]])


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this process.  Results that still read them (they are lazy) must have been written before."""
    for path in sorted(_written):
        _delete(spark, path)
    _written.clear()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts (in that column) have at most so many bytes, one row at least."""
    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        end, a = np.cumsum(size, dtype=np.int64), 0
        while a < b.num_rows:
            e = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, e - a)
            a = e


def fold(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder.  A null id counts as True: held out, never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def sampled(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About `bound` rows at most (a binomial draw: some hundreds more at worst), picked by a hash of the keys: the same rows at any partitioning; all rows when there are fewer."""
    n = df.count()
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(bound / n * (1 << 20)))


def keep_named(docs: DataFrame, ids: DataFrame, id_col: str, marks: DataFrame, mark: Column) -> DataFrame:
    """docs with one row for each row of `marks`, all columns as they were.

    ids (_id) are the ids of docs that stay; where no id is shared or null more than once
    they tell rows apart, and nothing but a semi-join on them is done.  Elsewhere a row
    stays if its id and its mark (an expression of docs) stand in marks (_id, _mark), and
    of the rows that are equal in both any one; rows with a null id are told apart by the mark.
    """
    shared = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    own = f"_mark_{uuid.uuid4().hex}"
    if shared.isEmpty():
        found = ids.select(F.col("_id").alias(own)).distinct()
        return docs.join(found, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
    wanted = marks.select(F.col("_id").alias(f"{own}_id"), F.col("_mark").alias(f"{own}_of")).distinct()
    marked = docs.withColumn(own, mark)
    met = marked.join(wanted, F.col(id_col).eqNullSafe(F.col(f"{own}_id")) & F.col(own).eqNullSafe(F.col(f"{own}_of")), "left_semi")
    # A task sends one row of each id and mark: a row that repeats often does not travel often.
    return met.dropDuplicates([id_col, own]).drop(own)
