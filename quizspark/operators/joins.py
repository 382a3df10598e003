"""Joins between results, questions, runs and price lists.

Sides are not marked for broadcast: Spark broadcasts what it knows or measures to be small and splits skewed partitions of what
is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark import fixed_values as fv
from quizspark.functions.labels import per_million
from quizspark.plans.storage import written


def results_with_questions(results: DataFrame, questions: DataFrame, how: str = "inner") -> DataFrame:
    """Question attributes on result rows; ``how="left"`` keeps results of unknown questions."""
    return results.join(questions, "question_id", how)


def questions_used(questions: DataFrame, results: DataFrame, run_id=None) -> DataFrame:
    """Questions that occur in a run (or in any run)."""
    used = results if run_id is None else results.where(F.col("run_id") == run_id)
    return questions.join(used.select("question_id"), "question_id", "left_semi")


def completed_performance(performance: DataFrame, runs: DataFrame) -> DataFrame:
    """Performance rows of completed runs with their creation time."""
    done = runs.where(F.col("status") == "completed").select("run_id", "created_at")
    return performance.join(done, "run_id")


def latest_and_previous(performance: DataFrame, value: str = "accuracy_rate") -> DataFrame:
    """Each model's newest row with the value of the row before it (NULL when there is none).

    Only the two newest rows per model leave the map side (``row_number <= 2`` is a group limit),
    so a model with very many runs stays cheap.
    """
    newest = Window.partitionBy("model_name").orderBy(F.desc("created_at"), F.desc("run_id"))
    top = (performance.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 2))
    return (top.withColumn(f"previous_{value}", F.lead(value).over(newest))
            .where(F.col("_rn") == 1).drop("_rn"))


def aligned(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pair rows of two tables by response key, never by position."""
    return left.join(right, key)


def alternative_ids(model_id: Column) -> Column:
    """Ids tried, in order, when no list knows ``model_id``."""
    swapped = [F.replace(model_id, F.lit(a), F.lit(b)) for a, b in fv.ALTERNATIVE_ID_REPLACEMENTS]
    newer = model_id.contains("gpt-5")
    tail = F.element_at(F.split(model_id, "/"), -1)
    listed = F.array(*swapped, F.when(newer, F.lit("openai/gpt-5-preview")),
                     F.when(newer, F.concat(F.lit("openai/"), tail, F.lit("-preview"))))
    return F.filter(listed, lambda x: x.isNotNull() & (x != model_id))


def price_usage(usage: DataFrame, catalog: DataFrame | None, static_prices: DataFrame) -> DataFrame:
    """Attach input and output price per million tokens and the list it came from.

    Order: dynamic catalog, static list, alternative ids in order on the static list, else 0. The distinct ids of the log, with what each may be found as, meet the whole
    lists by equality; the best place wins, and the prices found, one row per id, are written and meet the log. So the log is scanned twice, for its ids and for its rows, and is
    shuffled only if it has too many ids to broadcast. A list's rows without an id are ignored; of rows with the same id the one with the least prices counts. Usage
    without an id has no price.
    """
    lists = static_prices.select(F.lit(1).alias("_list"), "model_id", F.col("input_cost").cast("double").alias("_i"), F.col("output_cost").cast("double").alias("_o"))
    if catalog is not None:
        lists = lists.unionByName(catalog.select(F.lit(0).alias("_list"), "model_id", per_million(F.col("input_cost")).cast("double").alias("_i"),
                                                 per_million(F.col("output_cost")).cast("double").alias("_o")))
    known = lists.where("model_id is not null").groupBy("_list", F.col("model_id").alias("_known")).agg(F.min(F.struct("_i", "_o")).alias("_price"))
    ids = usage.where("model_id is not null").select(F.col("model_id").alias("_id")).distinct()
    tried = ids.select("_id", F.posexplode(F.concat(F.array("_id"), alternative_ids(F.col("_id")))).alias("_at", "_as"))
    # The catalog knows ids as they are; only the static list is searched for alternatives.
    met = tried.join(known, (F.col("_as") == F.col("_known")) & ((F.col("_list") == 1) | (F.col("_at") == 0)))
    best = written(met.groupBy("_id").agg(F.min(F.struct("_at", "_list", "_price")).alias("_hit")), "prices-found")
    hit = F.col("_hit")
    source = (F.when(hit["_list"] == 0, "dynamic").when(hit["_at"] == 0, "static").when(hit["_at"] > 0, "alternative").otherwise("none"))
    return usage.join(best, F.col("model_id") == F.col("_id"), "left").withColumns({
        "input_price": F.coalesce(hit["_price"]["_i"], F.lit(0.0)), "output_price": F.coalesce(hit["_price"]["_o"], F.lit(0.0)),
        "price_source": source}).drop("_id", "_hit")


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column,
               output_price: Column, tier: str = "basic") -> Column:
    """Cost of a request at prices per million tokens, after the billing tier's discount."""
    base = (input_tokens / F.lit(1_000_000.0)) * input_price + (
        output_tokens / F.lit(1_000_000.0)) * output_price
    return base * F.lit(fv.TIER_MULTIPLIERS.get(tier, 1.0))
