"""Question statistics and dataset profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quizspark.operators.joins import questions_used


def question_statistics(questions: DataFrame, results: DataFrame | None = None, run_id=None) -> DataFrame:
    """One row: questions, categories, and range of the positive values; optionally of one run."""
    rows = questions if results is None else questions_used(questions, results, run_id)
    priced = F.when(F.col("value") > 0, F.col("value"))
    return rows.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_distinct(F.nullif("category", F.lit(""))).alias("unique_categories"),
        F.min(priced).alias("value_min"), F.max(priced).alias("value_max"),
        F.avg(priced).alias("value_average"), F.count(priced).alias("value_count"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage (of all rows) per non-empty value."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("t"))
    return (counted.where(F.length(F.col(column)) > 0)
            .select(column, "n", (F.col("n") * 100.0 / total.select("t").scalar()).alias("percent")))


def top_categories(df: DataFrame, k: int = 10, column: str = "category") -> DataFrame:
    return distribution(df, column).orderBy(F.desc("n"), column).limit(k)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(F.col(column)) > 0).select(column).distinct()


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count and percentage of every column, from one aggregate row turned long."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot(["_n"], columns, "column_name", "null_count")
    return long.select("column_name", "null_count", F.round(
        F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("_n")), F.lit(0.0)), 2)
        .alias("null_percentage"))


def quality_issues(df: DataFrame) -> DataFrame:
    """Rows, short questions (under 20 characters) and distinct categories."""
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.length("question") < 20).alias("short_questions"),
                  F.count_distinct("category").alias("unique_categories"))


def dashboard(questions: DataFrame, performance: DataFrame, results: DataFrame,
              approximate: bool = False) -> DataFrame:
    """One row: questions, tested models, answered questions, best accuracy in percent."""
    models = F.approx_count_distinct("model_name") if approximate else F.count_distinct("model_name")
    perf = performance.agg(models.alias("m"), F.max("accuracy_rate").alias("a"))
    answered = results.agg(F.count(F.lit(1)).alias("n"))
    best = F.coalesce(perf.select("a").scalar(), F.lit(0.0)).cast("double")
    return questions.agg(F.count(F.lit(1)).alias("total_questions")).select(
        "total_questions", perf.select("m").scalar().alias("models_tested"),
        answered.select("n").scalar().alias("questions_answered"),
        (F.floor(best * 10000 + 0.5) / 100.0).alias("best_accuracy"))
