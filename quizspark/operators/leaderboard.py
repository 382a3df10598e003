"""Rankings and run histories.

Every per-group top-k is a ``row_number() <= k`` filter with a constant k, which Spark turns into a
limit per task before the shuffle: a model with a third of all runs sends k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark.operators.joins import completed_performance, latest_and_previous


def trends(performance: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest accuracy per model against the run before: up, down or stable."""
    known = completed_performance(performance, runs).where(F.col("accuracy_rate").isNotNull())
    now, before = F.col("accuracy_rate"), F.col("previous_accuracy_rate")
    return latest_and_previous(known).withColumn(
        "trend", F.when(before.isNull(), "stable").when(now > before, "up").when(now < before, "down")
        .otherwise("stable"))


def _half_up(c: Column, scale: int = 0) -> Column:
    return F.floor(c * (10 ** scale) + 0.5) / F.lit(float(10 ** scale))


def web_leaderboard(performance: DataFrame, runs: DataFrame, limit: int = 5) -> DataFrame:
    """Top models by newest accuracy with efficiency, trend and a score out of 1000."""
    cost = F.coalesce(F.col("total_cost_usd"), F.lit(0.0)).cast("double")
    acc = F.col("accuracy_rate").cast("double")
    latest = trends(performance, runs).select(
        "model_name", acc.alias("acc"), "trend", cost.alias("cost"),
        F.coalesce(F.col("avg_response_time_ms"), F.lit(1000)).cast("double").alias("ms"))
    # One row per model is left; the top few are picked before they are numbered.
    top = latest.orderBy(F.desc("acc"), "model_name").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("acc"), "model_name"))
    efficiency = F.when(F.col("cost") > 0, F.col("acc") / F.col("cost") * 1000).otherwise(F.col("acc") * 100)
    percent = _half_up(F.col("acc") * 100, 2)
    return top.select(
        rank.cast("bigint").alias("rank"), F.col("model_name").alias("name"), percent.alias("accuracy"),
        _half_up(percent * 10).alias("score"), F.lit(1000).alias("max_score"),
        _half_up(F.col("ms") / 1000, 2).alias("avg_time"), _half_up(F.col("cost"), 2).alias("cost"),
        _half_up(efficiency).alias("efficiency"), "trend")


def score_leaderboard(performance: DataFrame, runs: DataFrame, limit: int = 10,
                      unique: bool = False) -> DataFrame:
    """Completed runs by signed score, best first; ``unique`` keeps each model's best entry."""
    rows = completed_performance(performance, runs).where(F.col("signed_score").isNotNull())
    if unique:
        best = Window.partitionBy("model_name").orderBy(F.desc("signed_score"), F.desc("created_at"), "run_id")
        rows = rows.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") == 1).drop("_rn")
    order = [F.desc("signed_score"), F.asc("model_name"), F.asc("run_id")]
    top = rows.orderBy(*order).limit(limit)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "model_name", "run_id",
        "signed_score", F.coalesce("accuracy_rate", F.lit(0.0)).alias("accuracy"),
        F.col("correct_answers").alias("correct"),
        (F.col("total_questions") - F.col("correct_answers")).alias("incorrect"))


def model_ranking(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """Ranked models from per-model metric rows with total_score, accuracy and outcome counts."""
    order = [F.desc("total_score"), F.asc("model_name")]
    top = metrics.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


_SORTS = {
    "rank": [("signed_score", False)], "score": [("signed_score", False)],
    "accuracy": [("accuracy_rate", False)], "speed": [("avg_response_time_ms", True)],
    "cost": [("total_cost_usd", True)], "efficiency": [("efficiency", False)],
}


def resort(board: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Order a leaderboard by rank, score, accuracy, speed, cost or efficiency; NULLs come last."""
    order = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in _SORTS[by]]
    ordered = board.orderBy(*order, "model_name", "run_id")
    return ordered if limit is None else ordered.limit(limit)


def model_history(runs: DataFrame, model: str, limit: int = 20) -> DataFrame:
    """Newest runs that tested a model."""
    from quizspark.operators.filters import runs_with
    return runs_with(runs, model=model).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def top_category_scores(category_scores: DataFrame, k: int = 5) -> DataFrame:
    """Each run and model's k best categories by signed score."""
    w = Window.partitionBy("run_id", "model_name").orderBy(F.desc("score"), "category")
    return category_scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
