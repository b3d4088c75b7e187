"""A kept index of words by their sound: a table bucketed by code, which joins without being moved.

    index = SoundIndex.create(dictionary, "sounds", folder)
    index.add(new_words)
    index.candidates(words)

Rows are (code, word, dict_pos).  The side that asks is dealt into the index's buckets; the
index is read as it lies.  Words are added in place, behind the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.phonetic import double_metaphone
from quillwork.functions.text import letters_only
from quillwork.operators.correct import phonetic_index
from quillwork.operators.ordering import with_row_number
from quillwork.sources.shared import shared_table

BUCKETS = 64
SCHEMA = "code STRING, word STRING, dict_pos INT"


@dataclass(frozen=True)
class SoundIndex:
    spark: SparkSession
    name: str

    @classmethod
    def create(cls, dictionary: DataFrame, name: str, folder: str, buckets: int = BUCKETS) -> SoundIndex:
        """From a dictionary (dict_pos, word); the table lies in the folder, which all executors share."""
        spark = dictionary.sparkSession
        rows = phonetic_index(dictionary).select("code", "word", "dict_pos")
        rows.write.format("parquet").option("path", folder).bucketBy(buckets, "code").sortBy("code").mode("errorifexists").saveAsTable(name)
        return cls(spark, name)

    @classmethod
    def open(cls, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> SoundIndex:
        """One that another session has made, with as many buckets."""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (code) SORTED BY (code) INTO {buckets} BUCKETS LOCATION '{folder}'")
        return cls(spark, name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, new: DataFrame) -> None:
        """New words (column word), in lower case, each once, behind those that are there, by the alphabet; known words and those without a sound stay as they are."""
        known = self.table.select("word").distinct()
        fresh = new.select(F.lower("word").alias("word")).filter("word IS NOT NULL").distinct().join(known, "word", "left_anti")
        last = self.table.agg(F.coalesce(F.max("dict_pos"), F.lit(-1))).first()[0]
        numbered = with_row_number(fresh, "word", name="_n").select((F.lit(last) + F.col("_n")).cast("int").alias("dict_pos"), "word")
        # Written before the table that it was read from is written to.
        rows = shared_table(phonetic_index(numbered).select("code", "word", "dict_pos"), "new-sounds")
        rows.write.insertInto(self.name)

    def candidates(self, words: DataFrame) -> DataFrame:
        """word, clean, candidate, code_rank, dict_pos for distinct words (column word): index words that share a code, the first code first, without the word itself."""
        asked = words.withColumn("clean", letters_only("word")).filter("clean <> ''")
        codes = asked.select("word", "clean", F.posexplode(F.array_distinct(double_metaphone("clean"))).alias("code_rank", "code")).filter("code <> ''")
        met = codes.join(self.table.withColumnRenamed("word", "candidate").hint("merge"), "code").filter("candidate <> clean")
        return met.groupBy("word", "clean", "candidate").agg(F.min(F.struct("code_rank", "dict_pos")).alias("_p")).select("word", "clean", "candidate", "_p.*")

    def drop(self) -> None:
        """Forget the table's name; its files stay in the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
