"""Metrics of graded results per run and model.

Input rows: run_id, model_name, question_id, category, difficulty_level, value, is_correct (NULL =
unanswered), confidence, latency_ms, cost_usd, tokens_used, tokens_input, tokens_output, and
optionally is_timeout, is_error, response_type, match_type, grading_mode, partial_credit,
grading_time_ms.

Every function aggregates with partial (map-side) aggregates only. Exact percentiles come from
counted values (see ``plans.quantiles``), never from sorting a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark import fixed_values as fv
from quizspark.functions.labels import clamp, score_label, signed_score, value_bucket
from quizspark.plans import quantiles as q
from quizspark.plans.keys import join_by
from quizspark.plans.storage import written

KEYS = ("run_id", "model_name")
BREAKDOWNS = ("category", "difficulty_level", "value_bucket")


def _correct() -> Column:
    """1 or 0 for answered rows, NULL for unanswered ones."""
    return F.col("is_correct").cast("int")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def accuracy(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of correct answers among answered rows; the total includes unanswered rows."""
    return results.groupBy(*keys).agg(
        F.coalesce(F.avg(_correct()), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.sum(_correct()), F.lit(0)).alias("correct_count"),
        F.count("is_correct").alias("answered_count"), F.count(F.lit(1)).alias("total_count"))


def confidence_interval(df: DataFrame, p: str = "accuracy", n: str = "total_count", more_than: int = 30) -> DataFrame:
    """95 % interval around a share, within [0, 1], NULL unless it rests on more than ``more_than`` rows.

    The normal approximation is poor for few rows.
    """
    margin = F.lit(1.96) * F.sqrt(F.col(p) * (1 - F.col(p)) / F.col(n))
    enough = F.col(n) > more_than
    return (df.withColumn("ci_low", F.when(enough, F.greatest(F.lit(0.0), F.col(p) - margin)))
            .withColumn("ci_high", F.when(enough, F.least(F.lit(1.0), F.col(p) + margin))))


def _fine_grain(results: DataFrame, keys: Sequence[str], everything: bool = False) -> DataFrame:
    """Additive measures per key, category, difficulty and value bucket: one pass over the rows.

    Category, difficulty and bucket reports all roll up from this small table; with ``everything`` also the totals of a key.
    """
    marked = results.withColumn("value_bucket", value_bucket(F.col("value")))
    graded = F.coalesce(F.col("is_correct"), F.lit(False))
    measures = [
        F.count(F.lit(1)).alias("n"), F.count("is_correct").alias("answered"),
        F.coalesce(F.sum(_correct()), F.lit(0)).alias("correct"),
        F.sum(signed_score(F.col("is_correct"), F.col("value"))).alias("score"),
        F.sum(F.when(graded, F.col("confidence")).otherwise(0.0)).alias("earned")]
    return marked.groupBy(*keys, *BREAKDOWNS).agg(*measures, *(_more_sums(results) if everything else []))


def _more_sums(results: DataFrame) -> list[Column]:
    """What the totals of a key need besides, in a form that adds up over groups."""
    x, right, took = F.col("confidence").cast("double"), F.coalesce(_correct(), F.lit(0)).cast("double"), F.col("latency_ms").cast("double")
    out = [F.count(took).alias("t_n"), F.sum(took).alias("t_s"), (F.var_pop(took) * F.count(took)).alias("t_m2"), F.min(took).alias("t_min"),
           F.max(took).alias("t_max"), F.count(x).alias("c_n"), F.sum(x).alias("c_s"), (F.var_pop(x) * F.count(x)).alias("c_m2"),
           F.sum(F.when(x.isNotNull(), right)).alias("c_y"), (F.covar_pop(x, right) * F.count(x)).alias("c_co"), *[F.sum(c).alias(c) for c in ("cost_usd", "tokens_used", "tokens_input", "tokens_output")]]
    have = set(results.columns)
    out += [F.count_if(F.col(c)).alias(c) for c in ("is_timeout", "is_error") if c in have]
    if "grading_mode" in have:
        out.append(F.collect_set("grading_mode").alias("grading_mode"))  # a handful of modes
    if "partial_credit" in have:
        out.append(F.max(F.col("partial_credit") > 0).alias("partial_credit"))
    if "grading_time_ms" in have:
        out += [F.sum("grading_time_ms").alias("g_s"), F.count("grading_time_ms").alias("g_n")]
    return out


def _spread(n: Column, total: Column, moment: Column) -> Column:
    """Sample deviation from the second central moment; 0 for fewer than two values, and where what is left is rounding of equal values."""
    rounding = F.abs(total / n) * 1e-14
    return F.when((n > 1) & (moment > n * rounding * rounding), F.sqrt(moment / (n - 1))).otherwise(0.0)


def _central(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The fine-grained table with each group's central moments about the means of its whole key, so that they add up.

    A sum of squares would lose the deviations of values that are large and lie close together. The window shares its exchange with the sums
    by key that follow, and sees one row per fine group.
    """
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))

    def off(total: str, n: str) -> Column:
        """How far the mean of a group lies from that of its key."""
        return F.try_divide(F.col(total), F.col(n)) - F.try_divide(F.sum(total).over(whole), F.sum(n).over(whole))
    moved = fine.withColumns({"_t": off("t_s", "t_n"), "_c": off("c_s", "c_n"), "_y": off("c_y", "c_n")})
    return moved.withColumns({"t_m2": F.col("t_m2") + F.col("t_n") * F.col("_t") * F.col("_t"), "c_m2": F.col("c_m2") + F.col("c_n") * F.col("_c") * F.col("_c"),
                              "c_co": F.col("c_co") + F.col("c_n") * F.col("_c") * F.col("_y")}).drop("_t", "_c", "_y")


def breakdowns(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and signed score by category, difficulty and value bucket, as a long table."""
    return _breakdowns(_fine_grain(results, keys), keys)


def _breakdowns(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    long = fine.select(*keys, "n", "answered", "correct", "score", F.explode(F.array(*[
        F.struct(F.lit(b).alias("dimension"), F.col(b).alias("label")) for b in BREAKDOWNS
    ])).alias("d")).select(*keys, "d.dimension", "d.label", "n", "answered", "correct", "score")
    return long.groupBy(*keys, "dimension", "label").agg(
        F.sum("n").alias("total"), F.sum("answered").alias("answered"), F.sum("correct").alias("correct"),
        _ratio(F.sum("correct"), F.sum("answered")).alias("accuracy"), F.sum("score").alias("score"))


def accuracy_by(results: DataFrame, dimension: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy of the answered rows per value of one dimension; groups without answers are left out."""
    rows = results.withColumn("value_bucket", value_bucket(F.col("value")))
    return accuracy(rows, [*keys, dimension]).where(F.col("answered_count") > 0)


def latency_percentiles(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact median, p95 and p99 in seconds; p95/p99 take the element at index floor(p * n)."""
    n = F.col("n")
    ranks = {"_m1": q.lower_median_rank(n), "_m2": q.upper_median_rank(n),
             "_p95": q.floor_index_rank(0.95, n), "_p99": q.floor_index_rank(0.99, n)}
    stats = q.order_statistics(results, keys, "latency_ms", ranks)
    return stats.select(*keys, ((F.col("_m1") + F.col("_m2")) / 2000.0).alias("median_s"),
                        (F.col("_p95") / 1000.0).alias("p95_s"), (F.col("_p99") / 1000.0).alias("p99_s"))


def latency(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, spread and range of response times in seconds, with timeouts and errors."""
    seconds = F.col("latency_ms") / 1000.0

    def flagged(name: str) -> Column:
        return F.count_if(F.col(name)) if name in results.columns else F.lit(0).cast("bigint")
    return results.groupBy(*keys).agg(
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("mean_s"), F.min(seconds).alias("min_s"),
        F.max(seconds).alias("max_s"),
        F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("std_s"),
        flagged("is_timeout").alias("timeout_count"), flagged("is_error").alias("error_count"))


def _cost_columns(df: DataFrame) -> DataFrame:
    """Per-question and per-correct costs from totals. Without a correct answer the cost per correct
    answer is NULL (it would be infinite) and the efficiency 0."""
    per_correct = F.try_divide(F.col("total_cost"), F.col("correct_count"))
    return (df.withColumn("cost_per_question", _ratio(F.col("total_cost"), F.col("total_count")))
            .withColumn("cost_per_correct", per_correct)
            .withColumn("tokens_per_question", _ratio(F.col("total_tokens"), F.col("total_count")))
            .withColumn("tokens_per_correct",
                        F.try_divide(F.col("total_tokens").cast("double"), F.col("correct_count")))
            .withColumn("cost_efficiency", F.when(
                F.col("cost_per_correct") > 0,
                fv.BASELINE_COST_PER_CORRECT / F.col("cost_per_correct")).otherwise(0.0)))


def _cost_sums() -> list[Column]:
    return [F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("total_cost"),
            F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum("tokens_input"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("tokens_output"), F.lit(0)).alias("output_tokens")]


def cost(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _cost_columns(results.groupBy(*keys).agg(
        *_cost_sums(), F.coalesce(F.sum(_correct()), F.lit(0)).alias("correct_count"),
        F.count(F.lit(1)).alias("total_count")))


def _score_sums() -> list[Column]:
    answered = F.col("is_correct").isNotNull()
    return [F.sum(signed_score(F.col("is_correct"), F.col("value"))).alias("total_score"),
            F.count_if(answered & F.col("is_correct")).alias("positive_scores"),
            F.count_if(answered & ~F.col("is_correct")).alias("negative_scores"),
            F.count_if(~answered).alias("unanswered_count")]


def signed_scores(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return results.groupBy(*keys).agg(*_score_sums())


def score_distribution(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    label = score_label(F.col("is_correct"), F.col("value"))
    return results.groupBy(*keys, label.alias("score_label")).agg(F.count(F.lit(1)).alias("n"))


def confidence_spread(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("performance_variance"))


def type_frequencies(results: DataFrame, columns: Sequence[str] = ("response_type", "match_type"),
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Count and share of every response type and match type, in one pass."""
    combos = results.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("_n"))
    long = combos.select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).alias("label")) for c in columns])).alias("d"))
    counts = long.groupBy(*keys, "d.kind", "d.label").agg(F.sum("_n").alias("n"))
    totals = combos.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    return (join_by(counts, totals, list(keys))
            .select(*keys, "kind", "label", "n", (F.col("n") / F.col("_total")).alias("share")))


def _steadiness(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evenness over categories and difficulty levels, and the number of categories, in one chain.

    1 - stdev/mean of the group means of earned confidence; 0 for one group or a mean of 0.
    """
    dims = ("category", "difficulty_level")
    long = fine.select(*keys, "earned", "n", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dims])).alias("d"))
    means = long.groupBy(*keys, "d.dimension", "d.label").agg((F.sum("earned") / F.sum("n")).alias("m"))

    def evenness(dim: str, name: str) -> Column:
        m = F.when(F.col("dimension") == dim, F.col("m"))
        return F.when((F.count(m) > 1) & (F.avg(m) > 0), 1.0 - F.try_divide(F.stddev_samp(m), F.avg(m))
                      ).otherwise(0.0).alias(name)
    return means.groupBy(*keys).agg(
        evenness("category", "category_consistency"), evenness("difficulty_level", "difficulty_consistency"),
        F.count(F.when(F.col("dimension") == "category", F.col("label"))).alias("category_count"))


def consistency(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Evenness of performance over categories and over difficulty levels."""
    return _steadiness(_fine_grain(results, keys), keys).drop("category_count")


def _guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where it is undefined (constant columns, fewer than two rows)."""
    both = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when(F.count(F.lit(1)) > 1, F.coalesce(F.try_divide(F.covar_samp(x, y), both), F.lit(0.0))
                  ).otherwise(0.0)


def confidence_correlation(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    right = F.coalesce(_correct(), F.lit(0)).cast("double")
    return results.groupBy(*keys).agg(
        _guarded_corr(F.col("confidence").cast("double"), right).alias("confidence_correlation"))


def composite_scores(df: DataFrame) -> DataFrame:
    """Overall, quality and efficiency score from accuracy, correlation, efficiency and mean time."""
    steady = clamp(F.col("confidence_correlation") + 0.5)
    cheap = F.least(F.lit(1.0), F.col("cost_efficiency"))
    fast = F.greatest(F.lit(0.0), 1.0 - F.col("mean_s") / fv.MAX_ACCEPTABLE_SECONDS)
    return (df.withColumn("overall_score", clamp(
                0.4 * F.col("accuracy") + 0.25 * steady + 0.2 * cheap + 0.15 * fast))
            .withColumn("quality_score", F.col("accuracy") * 0.7 + steady * 0.3)
            .withColumn("efficiency_score", cheap * 0.6 + fast * 0.4))


def _totals(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of each key from the fine-grained table."""
    have = set(fine.columns)
    adds = ["n", "answered", "correct", "score", "t_n", "t_s", "t_m2", "c_n", "c_s", "c_m2", "c_y", "c_co", "cost_usd", "tokens_used",
            "tokens_input", "tokens_output", "is_timeout", "is_error", "g_s", "g_n"]
    sums = [F.sum(c).alias(c) for c in adds if c in have] + [F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max")]
    if "grading_mode" in have:
        sums.append(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("grading_mode")))), ",").alias("grading_mode"))
    if "partial_credit" in have:
        sums.append(F.max("partial_credit").alias("partial_credit"))
    t = _central(fine, keys).groupBy(*keys).agg(*sums)

    def optional(name: str, alias: str, default) -> Column:
        return (F.col(name) if name in have else F.lit(default)).alias(alias)
    n, right, answered = F.col("n"), F.col("correct"), F.col("answered")
    share = right.cast("double") / n
    y_spread = _spread(n, right.cast("double"), n * share * (1 - share))  # of zeros and ones
    c_n, c_s = F.col("c_n"), F.col("c_s")
    c_spread = _spread(c_n, c_s, F.col("c_m2"))
    covariance = F.col("c_co") / (c_n - 1)
    return t.select(
        *keys, F.coalesce(F.try_divide(right.cast("double"), answered), F.lit(0.0)).alias("accuracy"), right.alias("correct_count"),
        answered.alias("answered_count"), n.alias("total_count"),
        F.coalesce(F.try_divide(F.col("t_s"), F.col("t_n")) / 1000.0, F.lit(0.0)).alias("mean_s"),
        (F.col("t_min") / 1000.0).alias("min_s"), (F.col("t_max") / 1000.0).alias("max_s"),
        F.coalesce(_spread(F.col("t_n"), F.col("t_s"), F.col("t_m2")) / 1000.0, F.lit(0.0)).alias("std_s"),
        F.coalesce("cost_usd", F.lit(0)).cast("double").alias("total_cost"), F.coalesce("tokens_used", F.lit(0)).alias("total_tokens"),
        F.coalesce("tokens_input", F.lit(0)).alias("input_tokens"), F.coalesce("tokens_output", F.lit(0)).alias("output_tokens"),
        F.col("score").alias("total_score"), right.alias("positive_scores"), (answered - right).alias("negative_scores"),
        (n - answered).alias("unanswered_count"), F.try_divide(c_s, c_n).alias("avg_confidence"),
        F.coalesce(c_spread, F.lit(0.0)).alias("performance_variance"),
        F.when((c_spread > 0) & (y_spread > 0), covariance / (c_spread * y_spread)).otherwise(0.0).alias("confidence_correlation"),
        optional("is_timeout", "timeout_count", 0), optional("is_error", "error_count", 0), optional("grading_mode", "grading_modes", "unknown"),
        optional("partial_credit", "has_partial_credit", False),
        (F.try_divide(F.col("g_s"), F.col("g_n")) if "g_s" in have else F.lit(0.0)).alias("avg_grading_time_ms"))


def _measured(results: DataFrame, keys: Sequence[str], percentiles: bool) -> tuple[DataFrame, DataFrame]:
    """(metrics, the fine-grained table they come from)."""
    if percentiles:
        # Three passes follow, and the rows may be a join: it is made once, and only what the passes read is written.
        needed = {*keys, "is_correct", "confidence", "latency_ms", "category", "difficulty_level", "value", "cost_usd", "tokens_used", "tokens_input", "tokens_output",
                  "is_timeout", "is_error", "grading_mode", "partial_credit", "grading_time_ms"}
        results = written(results.select(*[c for c in results.columns if c in needed]), "metric-rows")
    fine = written(_fine_grain(results, keys, everything=True), "fine-metrics")
    parts = [_totals(fine, keys), _steadiness(fine, keys)]
    if percentiles:
        parts.append(latency_percentiles(results, keys))
    joined = reduce(lambda a, b: join_by(a, b, keys, "left"), parts)
    return composite_scores(_cost_columns(confidence_interval(joined))), fine


def comprehensive_metrics(results: DataFrame, keys: Sequence[str] = KEYS,
                          percentiles: bool = True) -> DataFrame:
    """All metrics of a run and model in one row.

    Two passes over the rows: a fine-grained table of sums, written once, from which totals and consistency roll up, and counted
    response times for the percentiles.
    """
    return _measured(results, list(keys), percentiles)[0]


def performance_summary(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The model_performance row: totals with per-category and per-difficulty maps.

    Maps hold one entry per category or level. Times are in milliseconds, the average confidence is
    the average, and the error rate is errors over rows.
    """
    keys = list(keys)
    wide, fine = _measured(results, keys, percentiles=True)
    long = _breakdowns(fine, keys)

    def as_map(dimension: str, value: str, name: str) -> Column:
        entry = F.when((F.col("dimension") == dimension) & F.col("label").isNotNull()
                       & ((F.col("answered") > 0) if value == "accuracy" else F.lit(True)),
                       F.struct("label", value))
        return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(name)
    maps = long.groupBy(*keys).agg(
        as_map("category", "score", "category_scores"),
        as_map("category", "accuracy", "category_performance"),
        as_map("difficulty_level", "accuracy", "difficulty_performance"))
    ms = [(F.col(f"{s}_s") * 1000.0).alias(f"{s2}_response_time_ms")
          for s, s2 in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))]
    return join_by(wide, maps, keys, "left").select(
        *keys, F.col("total_count").alias("total_questions"), F.col("correct_count").alias("correct_answers"),
        F.col("accuracy").alias("accuracy_rate"), F.col("total_score").alias("signed_score"), *ms,
        F.col("total_cost").alias("total_cost_usd"), F.col("cost_per_question").alias("avg_cost_per_question"),
        F.col("cost_per_correct").alias("cost_per_correct_answer"),
        F.col("input_tokens").alias("total_tokens_input"), F.col("output_tokens").alias("total_tokens_output"),
        "total_tokens", F.col("tokens_per_question").alias("avg_tokens_per_question"),
        "category_scores", "category_performance", "difficulty_performance", "avg_confidence",
        F.col("confidence_correlation").alias("confidence_accuracy_correlation"), "error_count",
        _ratio(F.col("error_count"), F.col("total_count")).alias("error_rate"))


_COMPARED = [("accuracy", "accuracy", True), ("cost", "cost_per_correct", False),
             ("performance", "mean_s", False), ("score", "total_score", True),
             ("overall", "overall_score", True)]


def _compared(metrics: DataFrame, side: str, other: Sequence[str] = ()) -> DataFrame:
    return metrics.select(*other, *[F.col(c).alias(f"{side}_{c}") for _, c, _ in _COMPARED])


def _differences(first: Column, second: Column) -> list[Column]:
    """Differences and winners by each measure; ties go to the second. A NULL cost counts as infinitely dear."""
    out = []
    for name, c, larger in _COMPARED:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        out.append((x - y).alias(f"{name}_diff"))
        top = float("inf")
        x, y = (x, y) if larger else (F.coalesce(x, F.lit(top)), F.coalesce(y, F.lit(top)))
        out.append(F.when((x > y) if larger else (x < y), first).otherwise(second).alias(f"{name}_winner"))
    return out


def compare_models(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """Differences and winners of two models in every run both took part in."""
    a = _compared(metrics.where(F.col("model_name") == first), "a", ["run_id"])
    b = _compared(metrics.where(F.col("model_name") == second), "b", [F.col("run_id").alias("_run")])
    return a.join(b, F.col("run_id").eqNullSafe(F.col("_run"))).select("run_id", *_differences(F.lit(first), F.lit(second)))


def compare_pairs(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare any two rows of metrics: one model in two runs, or two models of different runs.

    ``pairs`` has ``first_run, first_model, second_run, second_model``. Returns them with the measures of both sides (``a_...``, ``b_...``),
    differences and winners, named as "model (run)". A pair with a side that has no metrics is left out.
    """
    out = pairs
    for name, letter in (("first", "a"), ("second", "b")):
        rows = _compared(metrics, letter, [F.col("run_id").alias("_run"), F.col("model_name").alias("_model")])
        out = out.join(rows, F.col(f"{name}_run").eqNullSafe(F.col("_run")) & F.col(f"{name}_model").eqNullSafe(F.col("_model"))).drop("_run", "_model")
    names = [F.concat(F.col(f"{n}_model"), F.lit(" ("), F.col(f"{n}_run").cast("string"), F.lit(")")) for n in ("first", "second")]
    return out.select("*", *_differences(*names))


def aggregate_runs(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best models and ranges over many metric rows; ties go to the smaller (model, run)."""
    who = F.struct("model_name", "run_id")

    def best(col: str, larger: bool) -> Column:
        order = -F.col(col) if larger else F.coalesce(F.col(col), F.lit(float("inf")))
        return F.min_by("model_name", F.struct(order.alias("o"), who.alias("w")))
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("run_count"), best("overall_score", True).alias("best_overall"),
        best("accuracy", True).alias("best_accuracy"),
        best("cost_per_correct", False).alias("most_cost_effective"), best("mean_s", False).alias("fastest"),
        F.min("accuracy").alias("accuracy_min"), F.max("accuracy").alias("accuracy_max"),
        F.min("cost_per_correct").alias("cost_min"), F.max("cost_per_correct").alias("cost_max"),
        F.min("mean_s").alias("time_min"), F.max("mean_s").alias("time_max"))


def metric_spread(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Min, max and spread of accuracy, cost per question and mean time, with the best model each."""
    who = F.struct("model_name", "run_id")
    out = []
    for name, col, larger in (("accuracy", "accuracy", True), ("cost", "cost_per_question", False),
                              ("performance", "mean_s", False)):
        out += [F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max"),
                (F.max(col) - F.min(col)).alias(f"{name}_spread"),
                F.min_by("model_name", F.struct((-F.col(col) if larger else F.col(col)).alias("o"),
                                                who.alias("w"))).alias(f"best_{name}")]
    return metrics.groupBy(*keys).agg(*out)


def pooled_response_stats(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled response time, accuracy and cost over all rows; the median is exact."""
    n = F.col("n")
    keys = list(keys)
    mid = q.order_statistics(results, keys, "latency_ms",
                             {"_a": q.lower_median_rank(n), "_b": q.upper_median_rank(n)})
    mid = mid.select(*keys, ((F.col("_a") + F.col("_b")) / 2.0).alias("median_ms"))
    pooled = results.groupBy(*keys).agg(
        F.avg("latency_ms").alias("mean_ms"), F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("std_ms"),
        F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"),
        F.avg(F.coalesce(_correct(), F.lit(0))).alias("overall_accuracy"),
        F.sum("cost_usd").cast("double").alias("total_cost"),
        F.avg("cost_usd").cast("double").alias("average_cost"))
    if keys:
        return join_by(pooled, mid, keys)
    return pooled.select("*", mid.select("median_ms").scalar().alias("median_ms"))


def category_report(results: DataFrame, run_id=None) -> DataFrame:
    """Correct, total and rate per run and category; unanswered rows count in the total."""
    rows = results if run_id is None else results.where(F.col("run_id") == run_id)
    correct = F.count_if(F.coalesce(F.col("is_correct"), F.lit(False)))
    return (rows.where(F.length("category") > 0).groupBy("run_id", "category").agg(
        correct.alias("correct"), F.count(F.lit(1)).alias("total"),
        (correct / F.count(F.lit(1))).alias("accuracy")))


def grading_statistics(graded: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Counts, rates and mean confidence of graded rows (every row not correct counts as incorrect)."""
    right = F.count_if(F.coalesce(F.col("is_correct"), F.lit(False)))
    n = F.count(F.lit(1))
    return graded.groupBy(*keys).agg(
        n.alias("total_graded"), right.alias("correct_count"), (n - right).alias("incorrect_count"),
        F.avg("confidence").cast("double").alias("avg_confidence"), (right / n).alias("accuracy_rate"),
        ((n - right) / n).alias("error_rate"))


def confidence_distribution(results: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Mean, range, upper median and population deviation of confidence."""
    keys = list(keys)
    mid = q.order_statistics(results, keys, "confidence", {"median": q.upper_median_rank(F.col("n"))})
    return results.groupBy(*keys).agg(
        F.avg("confidence").alias("mean"), F.min("confidence").alias("min"), F.max("confidence").alias("max"),
        F.stddev_pop("confidence").alias("std")).transform(lambda df: join_by(df, mid, keys))


def throughput(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Output tokens per second, and evenness of response times as 1 - stdev/mean."""
    seconds = F.col("latency_ms") / 1000.0
    return results.groupBy(*keys).agg(
        F.avg(F.try_divide(F.col("tokens_output"), seconds)).alias("tokens_per_second"),
        F.coalesce(1.0 - F.try_divide(F.stddev_samp(seconds), F.avg(seconds)), F.lit(0.0))
        .alias("latency_consistency"), F.avg(seconds).alias("mean_s"))


def category_intervals(results: DataFrame) -> DataFrame:
    """Accuracy with its interval and error rate per model and category."""
    acc = confidence_interval(accuracy(results, ["model_name", "category"]))
    return acc.withColumn("error_rate", 1.0 - F.col("accuracy"))


def _two_proportions(xa: Column, na: Column, xb: Column, nb: Column) -> list[Column]:
    pooled = F.try_divide((xa + xb).cast("double"), na + nb)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb)))
    diff = F.try_divide(xa.cast("double"), na) - F.try_divide(xb.cast("double"), nb)
    return [diff.alias("accuracy_diff"), F.coalesce(F.try_divide(diff, error), F.lit(0.0)).alias("z")]


def accuracy_significance(results: DataFrame, first: str, second: str) -> DataFrame:
    """Two-proportion z value of the accuracy difference of two models, per run."""
    counts = F.struct("correct_count", "answered_count")
    acc = accuracy(results).where(F.col("model_name").isin(first, second))
    sides = acc.groupBy("run_id").agg(*[F.max(F.when(F.col("model_name") == m, counts)).alias(n) for m, n in ((first, "_a"), (second, "_b"))])
    a, b = F.col("_a"), F.col("_b")
    return sides.where(a.isNotNull() & b.isNotNull()).select("run_id", *_two_proportions(
        a["correct_count"], a["answered_count"], b["correct_count"], b["answered_count"]))


def pair_significance(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same for any two (run, model) rows; ``pairs`` as in ``compare_pairs``."""
    out = pairs
    for name in ("first", "second"):
        rows = accuracy(results).select(F.col("run_id").alias("_run"), F.col("model_name").alias("_model"),
                                        F.col("correct_count").alias(f"_x_{name}"), F.col("answered_count").alias(f"_n_{name}"))
        out = out.join(rows, F.col(f"{name}_run").eqNullSafe(F.col("_run")) & F.col(f"{name}_model").eqNullSafe(F.col("_model"))).drop("_run", "_model")
    return out.select(*pairs.columns, *_two_proportions(*[F.col(c) for c in ("_x_first", "_n_first", "_x_second", "_n_second")]))


def accuracy_trend(performance: DataFrame) -> DataFrame:
    """Slope of accuracy per day for each model."""
    day = F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(86_400_000_000.0)
    known = performance.where(F.col("accuracy_rate").isNotNull()).withColumn("_day", day)
    return known.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.try_divide(F.covar_pop("accuracy_rate", "_day"), F.var_pop("_day")), F.lit(0.0))
        .alias("slope_per_day"))
