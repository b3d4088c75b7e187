"""From documents to packed sequences: language, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and
returns a DataFrame.  All but the last return the columns of documents.  The two
models are fitted on the tables of sf_dir, whatever docs holds.

All stages take any rows: columns beside doc_id and text may be missing, null or bear
any name and are passed on as they are; an empty table stays empty; null texts count as
empty ones; repeated rows and ids are told apart as each stage says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import exact_dedup, language_id, packing, quality, simhash_dedup
from quillwork.llm._common import read_table, write_scratch
from quillwork.llm.bpe import public_vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin.

    Null and empty texts and those without a letter go.  Rows are judged by their text
    alone: repeated ones go or stay together.
    """
    return language_id.drop_rejected(docs, language_id.fit_dictionaries(read_table(spark, sf_dir, "documents")))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts score as texts without a word, each the same.  Rows are judged by
    their text alone: repeated ones go or stay together.
    """
    return quality.drop_low_quality(docs, quality.fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, A-Z lower-cased: that of the smallest id.

    Null and empty texts are one group.  Null ids lose to others, and one row of a group
    of null ids only stays; of rows that repeat id and text one stays.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, 0.8 or more): that of the smallest id.

    Texts without a word are one group.  Null and repeated ids as in drop_exact_copies.
    """
    return simhash_dedup.drop_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens.

    A null or empty text is the end id alone.  Repeated rows are packed as often as they come.
    """
    return packing.pack(docs, public_vocabulary())


STAGES = [
    ("language ID", keep_known_languages),
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: The models' decisions are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    *kept, (_, last) = STAGES
    return last(spark, reduce(lambda d, stage: write_scratch(stage[1](spark, d, sf_dir), "pipeline-stage"), kept, docs), sf_dir)
