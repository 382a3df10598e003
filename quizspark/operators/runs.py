"""Run-level summaries, progress and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quizspark.operators.clean import parse_models_tested


def run_summary(results: DataFrame, questions: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: responses, correct, accuracy over all responses, distinct topics, value range."""
    rows = results.join(questions.select("question_id", "category", "difficulty_level", "value"),
                        "question_id", "left")
    # Counted by category and level first, map-side: distinct counts then run over few rows and expand none.
    small = rows.groupBy("run_id", "category", "difficulty_level").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.coalesce(F.col("is_correct"), F.lit(False))).alias("_right"),
        F.min("value").alias("_low"), F.max("value").alias("_high"))
    summary = small.groupBy("run_id").agg(
        F.sum("_n").alias("total_responses"), F.sum("_right").alias("correct_responses"),
        (F.sum("_right") / F.sum("_n")).alias("overall_accuracy"),
        F.count_distinct(F.nullif("category", F.lit(""))).alias("categories"),
        F.count_distinct(F.nullif("difficulty_level", F.lit(""))).alias("difficulty_levels"),
        F.min("_low").alias("value_min"), F.max("_high").alias("value_max"))
    if runs is None:
        return summary
    return runs.withColumn("models", parse_models_tested(F.col("models_tested"))).join(
        summary, "run_id", "left")


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(done * 100.0, total))


def run_progress(progress: DataFrame) -> DataFrame:
    """Completion, success and answer rates with the time left.

    Expects ``total_questions, completed_questions, successful, failed, elapsed_seconds`` and
    optionally ``avg_response_time_ms`` for the estimate shown for running jobs.
    """
    done, total = F.col("completed_questions"), F.col("total_questions")
    answered = F.col("successful") + F.col("failed")
    out = (progress.withColumn("completion_pct", percent(done, total))
           .withColumn("success_rate", percent(F.col("successful"), answered))
           .withColumn("answer_rate", percent(answered, done))
           .withColumn("remaining_seconds", F.try_divide(F.col("elapsed_seconds"), done) * (total - done)))
    if "avg_response_time_ms" in progress.columns:
        out = out.withColumn("remaining_minutes_by_latency",
                             (total - done) * F.col("avg_response_time_ms") / 1000.0 / 60.0)
    return out


def progress_from_results(results: DataFrame, planned: DataFrame) -> DataFrame:
    """Progress counts of each run from its result rows and the planned number of questions."""
    counts = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("completed_questions"), F.count_if(F.col("is_correct")).alias("successful"),
        F.count_if(~F.col("is_correct")).alias("failed"),
        F.count_if(F.col("is_correct").isNull()).alias("unanswered"),
        (F.sum("latency_ms") / 1000.0).alias("elapsed_seconds"))
    return counts.join(planned, "run_id")


def export_projection(runs: DataFrame) -> DataFrame:
    """Run rows for export: missing cost, tokens and latency as 0, ISO dates."""
    def iso(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
    return runs.select(
        F.col("run_id").alias("id"), "name", "status", iso("created_at"), iso("updated_at"), "sample_size",
        "benchmark_mode", F.coalesce("models_tested", F.lit("[]")).alias("models_tested"),
        F.coalesce(F.col("total_cost_usd").cast("double"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        F.coalesce(F.col("avg_response_time_ms").cast("double"), F.lit(0.0)).alias("avg_response_time_ms"))


def report_documents(metrics: DataFrame) -> DataFrame:
    """One JSON report per run and model."""
    def part(*names: str) -> Column:
        return F.struct(*[F.col(n) for n in names if n in metrics.columns])
    body = F.struct(
        "run_id", "model_name",
        F.struct(part("accuracy", "correct_count", "total_count").alias("accuracy"),
                 part("mean_s", "median_s", "error_count").alias("performance"),
                 part("total_cost", "cost_per_question", "cost_per_correct", "total_tokens").alias("cost"),
                 part("total_score", "positive_scores", "negative_scores", "unanswered_count").alias("score"),
                 F.col("overall_score"), F.col("quality_score"), F.col("efficiency_score")).alias("metrics"))
    return metrics.select("run_id", "model_name", F.to_json(body).alias("report"))
