"""Evaluation of correction models: one row for each case, then summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.similarity import matching_ratio
from quillwork.functions.text import count_words, first_word, strip, strip_thinking

#: Similarity that a category of sentences must pass.
LEAST_RATIO = {"pass_through": 0.95, "corrections": 0.90, "edge_cases": 0.90, "dyslexia": 0.90}


def score_sentences(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases: category, case_id, input, expected; outputs: model, category, case_id, output, time.

    Replies are cleaned of thinking first.  Word preservation passes within one word of the
    input's count; other categories by their similarity to what is expected.
    """
    rows = cases.join(outputs, ["category", "case_id"]).withColumn("output", strip_thinking("output"))
    rows = rows.withColumn("similarity", matching_ratio("output", "expected"))
    least = F.coalesce(*[F.when(F.col("category") == c, F.lit(v)) for c, v in LEAST_RATIO.items()], F.lit(0.90))
    kept = F.abs(count_words("input") - count_words("output")) <= 1
    return rows.withColumn("passed", F.when(F.col("category") == "word_preservation", kept).otherwise(F.col("similarity") > least))


def score_words(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases: case_id, input, expected; outputs: model, case_id, output, time.  The reply's first word must be the expected one, ignoring case."""
    rows = cases.join(outputs, "case_id").withColumn("output", first_word("output"))
    return rows.withColumn("correct", F.lower("output") == F.lower("expected"))


def reply_contains(output: Column, expected: Column) -> Column:
    return F.contains(F.lower(output), F.lower(expected))


def same_trimmed(output: Column, expected: Column) -> Column:
    return strip(output) == strip(expected)


def accuracy(rows: DataFrame, by: str = "model") -> DataFrame:
    """correct, total, accuracy (%), average, least and largest time; the most accurate first."""
    right = F.sum(F.col("correct").cast("long"))
    return rows.groupBy(by).agg(right.alias("n_correct"), F.count(F.lit(1)).alias("n_total"), (right / F.count(F.lit(1)) * 100).alias("accuracy"), F.avg("time").alias("avg_time"), F.min("time").alias("min_time"), F.max("time").alias("max_time")).orderBy(F.desc("accuracy"), by)


def eval_accuracy(rows: DataFrame, instruction: str) -> DataFrame:
    """One row: accuracy over the rows of this instruction, and accuracy_compat over all rows loaded."""
    scored = F.col("instruction") == instruction
    right = F.sum(F.when(scored & F.col("correct"), 1).otherwise(0))
    return rows.agg(right.alias("n_correct"), F.count_if(scored).alias("n_scored"), F.count(F.lit(1)).alias("n_loaded"), F.try_divide(right * 100.0, F.count_if(scored)).alias("accuracy"), F.try_divide(right * 100.0, F.count(F.lit(1))).alias("accuracy_compat"))


def suite_summary(rows: DataFrame) -> DataFrame:
    """model, category, passed, failed, pct; category null: over all of the model's, before its categories."""
    n, ok = F.count(F.lit(1)), F.sum(F.col("passed").cast("long"))
    totals = rows.rollup("model", "category").agg(ok.alias("n_passed"), (n - ok).alias("n_failed"), (ok * 100.0 / n).alias("pct"))
    return totals.filter("model IS NOT NULL").orderBy("model", F.col("category").asc_nulls_first())


def best_model(summary: DataFrame) -> DataFrame:
    """The model of the highest accuracy; of equals the first by name."""
    return summary.agg(F.min(F.struct(-F.col("accuracy"), "model"))["model"].alias("model"), F.max("accuracy").alias("accuracy"))


def best_balance(summary: DataFrame) -> DataFrame:
    """The model of the highest accuracy less five points a second, above zero."""
    rated = summary.withColumn("balance", F.col("accuracy") - F.col("avg_time") * 5).filter("balance > 0")
    return rated.agg(F.min(F.struct(-F.col("balance"), "model"))["model"].alias("model"), F.max("balance").alias("balance"))


def verdict(share: Column) -> Column:
    return F.when(share >= 0.8, "good").when(share >= 0.6, "fair").otherwise("poor")


def failures(rows: DataFrame, order: str, limit: int = 10) -> DataFrame:
    """The first failures in this order: a report."""
    return rows.filter(~F.col("passed")).orderBy(order).limit(limit)
