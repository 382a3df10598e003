"""Usage and cost reports over a usage log: ts, model_id, session_id, input/output tokens, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quizspark import fixed_values as fv


def usage_by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model_id").agg(
        F.sum("cost").alias("total_cost"), F.count(F.lit(1)).alias("total_requests"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


def usage_summary(usage: DataFrame) -> DataFrame:
    """One row of totals, built from the per-model rows so the log is read once.

    The cost by model is a map; ties for most and least expensive go to the smaller model id.
    """
    per_model = usage_by_model(usage)
    total = F.sum("total_cost")
    requests = F.sum("total_requests")
    return per_model.agg(
        F.coalesce(total, F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("total_input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("total_output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(requests, F.lit(0)).alias("total_requests"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model_id", "total_cost"))))
        .alias("cost_by_model"),
        F.min("first_used").alias("period_start"), F.max("last_used").alias("period_end"),
        F.coalesce(F.try_divide(total, requests), F.lit(0.0)).alias("average_cost_per_request"),
        F.min_by("model_id", F.struct(-F.col("total_cost"), "model_id")).alias("most_expensive_model"),
        F.min_by("model_id", F.struct("total_cost", "model_id")).alias("cheapest_model"))


def cost_breakdown(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per-model totals with name and provider from the catalog, dearest first."""
    names = catalog.select("model_id", F.col("name").alias("_name"), F.col("provider").alias("_provider"))
    return (usage_by_model(usage).join(names, "model_id", "left")
            .withColumn("average_cost_per_request", F.col("total_cost") / F.col("total_requests"))
            .withColumn("model_name", F.coalesce("_name", "model_id"))
            .withColumn("provider", F.coalesce("_provider", F.lit("unknown")))
            .drop("_name", "_provider").orderBy(F.desc("total_cost"), "model_id"))


def daily_costs(usage: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Cost, requests and distinct models per day, optionally for the last ``days`` before ``as_of``."""
    if as_of is not None and days is not None:
        kind = usage.schema["ts"].dataType.simpleString()
        end = F.lit(as_of).cast(kind)
        usage = usage.where((F.col("ts") <= end) & (F.col("ts") >= end - F.expr(f"interval {days} days")))
    per_model = usage.groupBy(F.to_date("ts").alias("date"), "model_id").agg(
        F.sum("cost").alias("_cost"), F.count(F.lit(1)).alias("_n"))
    return per_model.groupBy("date").agg(
        F.sum("_cost").alias("total_cost"), F.sum("_n").alias("total_requests"),
        F.sort_array(F.collect_list("model_id")).alias("models_used"),  # one entry per model
        F.count(F.lit(1)).alias("num_models")).orderBy("date")


def usage_counters(usage: DataFrame) -> DataFrame:
    """Requests, tokens, cost and their averages per model."""
    n = F.greatest(F.lit(1), F.col("total_requests"))
    return (usage.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0))).alias("total_tokens"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost_usd"))
        .withColumn("average_cost_per_request", F.col("total_cost_usd") / n)
        .withColumn("average_tokens_per_request", F.col("total_tokens") / n))


def batch_estimate(batches: DataFrame, tier: str = "basic", input_tokens: int = 100,
                   output_tokens: int = 50) -> DataFrame:
    """Cost estimate per row of ``model_id, num_questions, input_price, output_price``."""
    factor = fv.TIER_MULTIPLIERS.get(tier, 1.0)
    n = F.col("num_questions")
    cost = ((n * input_tokens / F.lit(1_000_000.0)) * F.col("input_price")
            + (n * output_tokens / F.lit(1_000_000.0)) * F.col("output_price")) * F.lit(factor)
    return (batches.withColumn("estimated_total_cost", cost)
            .withColumn("cost_per_question", F.when(n > 0, F.col("estimated_total_cost") / n).otherwise(0.0))
            .withColumn("estimated_input_tokens", n * input_tokens)
            .withColumn("estimated_output_tokens", n * output_tokens)
            .withColumn("total_tokens", n * (input_tokens + output_tokens))
            .withColumn("billing_tier", F.lit(tier))
            .withColumn("tier_discount", F.lit((1 - factor) * 100)))
