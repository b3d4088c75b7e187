"""The functions that Spark SQL has no like of, for use in SQL."""

from pyspark.sql import SparkSession

from quillwork.functions.phonetic import double_metaphone
from quillwork.functions.similarity import lcs_length, matching_ratio


def register(spark: SparkSession) -> None:
    for name, f in (("double_metaphone", double_metaphone), ("lcs_length", lcs_length), ("matching_ratio", matching_ratio)):
        spark.udf.register(name, f)
