"""Model catalogs: normalising what a provider API lists, and summaries of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quizspark import fixed_values as fv
from quizspark.functions.labels import per_million

STATIC_SCHEMA = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("context_length", T.IntegerType()),
    T.StructField("input_cost", T.DoubleType()), T.StructField("output_cost", T.DoubleType()),
    T.StructField("supports_streaming", T.BooleanType()),
    T.StructField("capabilities", T.ArrayType(T.StringType()))])


def static_catalog(spark: SparkSession) -> DataFrame:
    """The built-in price list (11 models)."""
    return spark.createDataFrame(fv.STATIC_MODELS, STATIC_SCHEMA)


def normalize_catalog(raw: DataFrame) -> DataFrame:
    """API rows to catalog rows: provider from the id, prices per million, derived capabilities.

    Expects ``model_id, name, context_length, prompt_price, completion_price`` and optionally
    ``listed_input_cost, listed_output_cost`` (already per million) and the ``supports_*`` and
    ``disabled`` flags.
    """
    have = set(raw.columns)

    def flag(name: str, default: bool):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    prompt = F.coalesce(F.col("prompt_price").cast("double"), F.lit(0.0))
    completion = F.coalesce(F.col("completion_price").cast("double"), F.lit(0.0))
    if "listed_input_cost" in have:
        unpriced = (prompt == 0) & (completion == 0)
        prompt, completion = (
            F.when(unpriced, F.coalesce(F.col("listed_input_cost"), F.lit(0.0))).otherwise(prompt),
            F.when(unpriced, F.coalesce(F.col("listed_output_cost"), F.lit(0.0))).otherwise(completion))
    context = F.coalesce(F.col("context_length"), F.lit(0))
    tags = F.array_compact(F.array(
        F.when(flag("supports_streaming", True), "streaming"),
        F.when(flag("supports_function_calling", False), "function_calling"),
        F.when(flag("supports_vision", False), "vision"),
        F.when(context >= fv.LONG_CONTEXT_TOKENS, "long_context"),
        F.lit("chat"), F.lit("reasoning")))
    return raw.where(F.length("model_id") > 0).select(
        "model_id", F.coalesce(F.col("name"), F.col("model_id")).alias("name"),
        F.when(F.col("model_id").contains("/"), F.substring_index("model_id", "/", 1))
        .otherwise("unknown").alias("provider"),
        context.alias("context_length"), per_million(prompt).alias("input_cost"),
        per_million(completion).alias("output_cost"), tags.alias("capabilities"),
        flag("supports_streaming", True).alias("supports_streaming"),
        (~flag("disabled", False)).alias("available"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """One row: counts, price and context ranges, streaming support."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_models"), F.count_distinct("provider").alias("providers"),
        F.min("input_cost").alias("min_input_cost"), F.max("input_cost").alias("max_input_cost"),
        F.min("output_cost").alias("min_output_cost"), F.max("output_cost").alias("max_output_cost"),
        F.min("context_length").alias("min_context"), F.max("context_length").alias("max_context"),
        F.count_if("supports_streaming").alias("streaming_models"))


def cheapest_models(catalog: DataFrame, k: int = 5) -> DataFrame:
    """The k models with the lowest input plus output price."""
    return catalog.orderBy(F.col("input_cost") + F.col("output_cost"), "model_id").limit(k)


def listing(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("provider", "name", "model_id")
