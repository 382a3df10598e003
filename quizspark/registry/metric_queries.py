"""Joins (D), metrics, costs and profiles (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizspark import views as v
from quizspark.operators import catalog as cat, costs as co, joins as j, metrics as m, profile as p, runs as r
from quizspark.operators import sampling as s
from quizspark.registry.base import Registry, rounded

R = Registry()

# ---- joins -------------------------------------------------------------------------------------


@R.add("d01_results_with_questions", """
SELECT result_id, run_id, category, difficulty_level, CAST(value AS BIGINT) AS value, is_correct FROM graded""")
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "category", "difficulty_level", "value")
    return rounded(j.results_with_questions(v.results(spark, sf), q).select(
        "result_id", "run_id", "category", "difficulty_level", "value", "is_correct"))


@R.add("d02_questions_used", """
SELECT DISTINCT q.question_id, q.question FROM questions q JOIN results r USING (question_id) WHERE r.run_id = 3""")
def _(spark, sf):
    return j.questions_used(v.questions(spark, sf), v.results(spark, sf), 3).select("question_id", "question")


@R.add("d03_completed_performance", """
SELECT p.run_id, p.model_name, p.signed_score, strftime(r.created_at, '%Y-%m-%d') AS day
FROM performance p JOIN runs r USING (run_id) WHERE r.status = 'completed'""")
def _(spark, sf):
    return j.completed_performance(v.performance(spark, sf), v.runs(spark, sf)).select(
        "run_id", "model_name", "signed_score", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@R.add("d04_latest_and_previous", """
WITH ranked AS (SELECT p.*, row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, run_id DESC) AS rn
  FROM performance p JOIN runs r USING (run_id) WHERE r.status = 'completed' AND accuracy_rate IS NOT NULL)
SELECT a.model_name, a.run_id, round(a.accuracy_rate, 6) AS accuracy_rate, round(b.accuracy_rate, 6) AS previous_accuracy_rate
FROM (SELECT * FROM ranked WHERE rn = 1) a LEFT JOIN (SELECT * FROM ranked WHERE rn = 2) b USING (model_name)""")
def _(spark, sf):
    perf = j.completed_performance(v.performance(spark, sf), v.runs(spark, sf)).where(F.col("accuracy_rate").isNotNull())
    return rounded(j.latest_and_previous(perf).select("model_name", "run_id", "accuracy_rate", "previous_accuracy_rate"))


@R.add("d05_question_lookup", """
SELECT r.result_id, q.category FROM results r LEFT JOIN (SELECT * FROM questions WHERE question_id % 3 > 0) q USING (question_id)""")
def _(spark, sf):
    known = v.questions(spark, sf).where(F.col("question_id") % 3 > 0).select("question_id", "category")
    return j.results_with_questions(v.results(spark, sf), known, "left").select("result_id", "category")


PRICED_SQL = """
WITH catalog_prices AS (SELECT model_id, input_cost AS i, output_cost AS o FROM catalog
  UNION ALL SELECT 'lab/unlisted' AS model_id, min(input_cost), max(output_cost) FROM catalog),
priced AS (
  SELECT u.*, CASE WHEN c.model_id IS NOT NULL THEN 'dynamic' WHEN s.model_id IS NOT NULL THEN 'static'
      WHEN a1.model_id IS NOT NULL OR a2.model_id IS NOT NULL OR a3.model_id IS NOT NULL THEN 'alternative' ELSE 'none' END AS price_source,
    CAST(coalesce(c.i, s.input_cost, a1.input_cost, a2.input_cost, a3.input_cost, 0) AS DOUBLE) AS input_price,
    CAST(coalesce(c.o, s.output_cost, a1.output_cost, a2.output_cost, a3.output_cost, 0) AS DOUBLE) AS output_price
  FROM usage_log u LEFT JOIN catalog_prices c USING (model_id) LEFT JOIN prices s ON s.model_id = u.model_id
  LEFT JOIN prices a1 ON a1.model_id = replace(u.model_id, 'anthropic/claude-sonnet-4', 'anthropic/claude-3.5-sonnet')
  LEFT JOIN prices a2 ON a2.model_id = replace(u.model_id, 'claude-sonnet-4', 'claude-3.5-sonnet')
  LEFT JOIN prices a3 ON a3.model_id = replace(u.model_id, 'claude-sonnet', 'claude-3.5-sonnet'))
"""


def _dynamic(spark, sf):
    """The whole catalog, with one of the usage models at the bounds of its prices, and a row without an id."""
    catalog = v.catalog(spark, sf).select("model_id", "input_cost", "output_cost")
    bounds = catalog.agg(F.min("input_cost").alias("input_cost"), F.max("output_cost").alias("output_cost"))
    return catalog.unionByName(bounds.withColumn("model_id", F.lit("lab/unlisted"))).unionByName(bounds.withColumn("model_id", F.lit(None).cast("string")))


def priced(spark, sf):
    return j.price_usage(v.usage(spark, sf), _dynamic(spark, sf), cat.static_catalog(spark))


@R.add("d06_price_fallback", PRICED_SQL + """
SELECT event_id, price_source, round(input_price, 6) AS input_price, round(output_price, 6) AS output_price,
  round(((input_tokens / 1000000.0) * input_price + (output_tokens / 1000000.0) * output_price) * 0.8, 9) AS cost FROM priced""")
def _(spark, sf):
    cost = j.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_price"), F.col("output_price"), "premium")
    return priced(spark, sf).select(
        "event_id", "price_source", F.round("input_price", 6).alias("input_price"),
        F.round("output_price", 6).alias("output_price"), F.round(cost, 9).alias("cost"))


@R.add("d08_align_by_key", """
SELECT a.result_id, a.is_correct, b.latency_ms AS latency FROM results a JOIN results b
  ON a.result_id = b.result_id AND a.model_name = b.model_name""")
def _(spark, sf):
    rows = v.results(spark, sf)
    return rounded(j.aligned(rows.select("result_id", "model_name", "is_correct"),
                             rows.select("result_id", "model_name", F.col("latency_ms").alias("latency")),
                             ["result_id", "model_name"]).drop("model_name"))


# ---- metrics per run and model -----------------------------------------------------------------

ACC = "coalesce(avg(CAST(is_correct AS INT)), 0)"


@R.add("e01_accuracy", f"""
SELECT run_id, model_name, round({ACC}, 6) AS accuracy, count(*) FILTER (is_correct) AS correct_count,
  count(is_correct) AS answered_count, count(*) AS total_count FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.accuracy(v.results(spark, sf)))


@R.add("e02_accuracy_breakdowns", f"""
SELECT run_id, model_name, dimension, label, count(*) AS total, count(is_correct) AS answered,
  count(*) FILTER (is_correct) AS correct, round({ACC}, 6) AS accuracy FROM (
  SELECT run_id, model_name, is_correct, 'category' AS dimension, category AS label FROM graded
  UNION ALL SELECT run_id, model_name, is_correct, 'difficulty_level', difficulty_level FROM graded
  UNION ALL SELECT run_id, model_name, is_correct, 'value_bucket', value_bucket FROM graded) GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.breakdowns(v.graded(spark, sf)).drop("score"))


@R.add("e02b_accuracy_by_category", f"""
SELECT model_name, category, round({ACC}, 6) AS accuracy, count(*) FILTER (is_correct) AS correct_count,
  count(is_correct) AS answered_count, count(*) AS total_count FROM graded GROUP BY ALL HAVING count(is_correct) > 0""")
def _(spark, sf):
    return rounded(m.accuracy_by(v.graded(spark, sf), "category", ["model_name"]))


@R.add("e03_confidence_interval", f"""
SELECT run_id, model_name, round(p, 6) AS accuracy, n AS total_count,
  round(CASE WHEN n > 30 THEN greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)) END, 6) AS ci_low,
  round(CASE WHEN n > 30 THEN least(1, p + 1.96 * sqrt(p * (1 - p) / n)) END, 6) AS ci_high
FROM (SELECT run_id, model_name, {ACC} AS p, count(*) AS n FROM results GROUP BY ALL)""")
def _(spark, sf):
    return rounded(m.confidence_interval(m.accuracy(v.results(spark, sf))).select(
        "run_id", "model_name", "accuracy", "total_count", "ci_low", "ci_high"))


@R.add("e04_latency", """
SELECT run_id, model_name, round(avg(latency_ms / 1000), 6) AS mean_s, round(min(latency_ms / 1000), 6) AS min_s,
  round(max(latency_ms / 1000), 6) AS max_s, round(coalesce(stddev_samp(latency_ms / 1000), 0), 6) AS std_s,
  count(*) FILTER (is_timeout) AS timeout_count, count(*) FILTER (is_error) AS error_count FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.latency(v.results(spark, sf)))


@R.add("e05_latency_percentiles", """
WITH ranked AS (SELECT run_id, model_name, latency_ms, count(*) OVER w AS n,
    row_number() OVER (PARTITION BY run_id, model_name ORDER BY latency_ms) AS rn
  FROM results WINDOW w AS (PARTITION BY run_id, model_name))
SELECT run_id, model_name, round(median(latency_ms) / 1000, 6) AS median_s,
  round(max(latency_ms) FILTER (rn = least(floor(CAST(0.95 AS DOUBLE) * n), n - 1) + 1) / 1000, 6) AS p95_s,
  round(max(latency_ms) FILTER (rn = least(floor(CAST(0.99 AS DOUBLE) * n), n - 1) + 1) / 1000, 6) AS p99_s
FROM ranked GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.latency_percentiles(v.results(spark, sf)))


COST_SQL = """
SELECT run_id, model_name, round(cost, 6) AS total_cost, CAST(tokens AS BIGINT) AS total_tokens,
  CAST(tin AS BIGINT) AS input_tokens, CAST(tout AS BIGINT) AS output_tokens, good AS correct_count, n AS total_count,
  round(cost / n, 6) AS cost_per_question, round(CASE WHEN good > 0 THEN cost / good END, 6) AS cost_per_correct,
  round(tokens / n, 6) AS tokens_per_question, round(CASE WHEN good > 0 THEN tokens / good END, 6) AS tokens_per_correct,
  round(CASE WHEN good > 0 AND cost > 0 THEN 0.01 / (cost / good) ELSE 0 END, 6) AS cost_efficiency
FROM (SELECT run_id, model_name, CAST(sum(cost_usd) AS DOUBLE) AS cost, CAST(sum(tokens_used) AS DOUBLE) AS tokens,
  sum(tokens_input) AS tin, sum(tokens_output) AS tout, count(*) FILTER (is_correct) AS good, count(*) AS n
  FROM results GROUP BY ALL)"""


@R.add("e06_cost", COST_SQL)
def _(spark, sf):
    return rounded(m.cost(v.results(spark, sf)))


@R.add("e07_signed_scores", """
SELECT run_id, model_name, CAST(sum(points) AS BIGINT) AS total_score, count(*) FILTER (is_correct) AS positive_scores,
  count(*) FILTER (NOT is_correct) AS negative_scores, count(*) FILTER (is_correct IS NULL) AS unanswered_count
FROM graded GROUP BY ALL""")
def _(spark, sf):
    return m.signed_scores(v.graded(spark, sf))


@R.add("e08_score_breakdowns", """
SELECT run_id, model_name, dimension, label, CAST(sum(points) AS BIGINT) AS score FROM (
  SELECT run_id, model_name, points, 'category' AS dimension, category AS label FROM graded
  UNION ALL SELECT run_id, model_name, points, 'difficulty_level', difficulty_level FROM graded
  UNION ALL SELECT run_id, model_name, points, 'value_bucket', value_bucket FROM graded) GROUP BY ALL""")
def _(spark, sf):
    return m.breakdowns(v.graded(spark, sf)).select("run_id", "model_name", "dimension", "label", "score")


@R.add("e09_score_distribution", """
SELECT run_id, model_name, CASE WHEN is_correct IS NULL THEN 'Unanswered' WHEN points > 0 THEN '+$' || points
  WHEN points < 0 THEN '-$' || abs(points) ELSE '$0' END AS score_label, count(*) AS n FROM graded GROUP BY ALL""")
def _(spark, sf):
    return m.score_distribution(v.graded(spark, sf))


@R.add("e10_confidence_spread", """
SELECT run_id, model_name, round(coalesce(stddev_samp(confidence), 0), 6) AS performance_variance FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.confidence_spread(v.results(spark, sf)))


@R.add("e11_type_frequencies", """
WITH long AS (SELECT run_id, model_name, 'response_type' AS kind, response_type AS label FROM results
  UNION ALL SELECT run_id, model_name, 'match_type', match_type FROM results)
SELECT run_id, model_name, kind, label, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY run_id, model_name, kind), 6) AS share FROM long
GROUP BY run_id, model_name, kind, label""")
def _(spark, sf):
    return rounded(m.type_frequencies(v.results(spark, sf)))


def _steady(dim: str, name: str) -> str:
    return f"""(SELECT run_id, model_name, CASE WHEN count(*) > 1 AND avg(g) > 0 THEN 1 - stddev_samp(g) / avg(g) ELSE 0 END AS {name}
  FROM (SELECT run_id, model_name, {dim}, avg(CASE WHEN is_correct THEN confidence ELSE 0 END) AS g FROM graded GROUP BY ALL)
  GROUP BY ALL)"""


@R.add("e12_consistency", f"""
SELECT run_id, model_name, round(category_consistency, 6) AS category_consistency,
  round(difficulty_consistency, 6) AS difficulty_consistency
FROM {_steady('category', 'category_consistency')} a JOIN {_steady('difficulty_level', 'difficulty_consistency')} b
  USING (run_id, model_name)""")
def _(spark, sf):
    return rounded(m.consistency(v.graded(spark, sf)))


CORR = """CASE WHEN count(*) > 1 AND stddev_samp(confidence) * stddev_samp(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) > 0
  THEN covar_samp(confidence, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END)
    / (stddev_samp(confidence) * stddev_samp(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END)) ELSE 0 END"""


@R.add("e13_confidence_correlation", f"""
SELECT run_id, model_name, round({CORR}, 6) AS confidence_correlation FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.confidence_correlation(v.results(spark, sf)))


@R.add("e13b_label_correlation", """
SELECT lang, count(*) AS n, round(CASE WHEN stddev_samp(quality) * stddev_samp(toxic) > 0
  THEN covar_samp(quality, toxic) / (stddev_samp(quality) * stddev_samp(toxic)) ELSE 0 END, 6) AS correlation
FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def _(spark, sf):
    rows = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    as_results = rows.select("lang", F.col("quality").alias("confidence"), (F.col("toxic") == 1).alias("is_correct"))
    corr = m.confidence_correlation(as_results, ["lang"]).withColumnRenamed("confidence_correlation", "correlation")
    return rounded(corr.join(as_results.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang"))


COMPOSITE_SQL = f"""
WITH base AS (SELECT run_id, model_name, {ACC} AS acc, {CORR} AS corr, avg(latency_ms / 1000) AS secs,
    CASE WHEN count(*) FILTER (is_correct) > 0 AND sum(cost_usd) > 0
      THEN 0.01 / (CAST(sum(cost_usd) AS DOUBLE) / count(*) FILTER (is_correct)) ELSE 0 END AS eff
  FROM results GROUP BY ALL),
parts AS (SELECT *, greatest(0, least(1, corr + 0.5)) AS steady, least(1, eff) AS cheap, greatest(0, 1 - secs / 30) AS fast FROM base),
composite AS (SELECT *, greatest(0, least(1, 0.4 * acc + 0.25 * steady + 0.2 * cheap + 0.15 * fast)) AS overall FROM parts)
"""


@R.add("e14_composite_scores", COMPOSITE_SQL + """
SELECT run_id, model_name, round(overall, 6) AS overall_score, round(acc * 0.7 + steady * 0.3, 6) AS quality_score,
  round(cheap * 0.6 + fast * 0.4, 6) AS efficiency_score FROM composite""")
def _(spark, sf):
    rows = v.graded(spark, sf)
    return rounded(m.comprehensive_metrics(rows, percentiles=False).select(
        "run_id", "model_name", "overall_score", "quality_score", "efficiency_score"))


@R.add("e15_comprehensive_metrics", COMPOSITE_SQL + f""",
sums AS (SELECT run_id, model_name, count(*) AS total_count, count(is_correct) AS answered_count,
    count(*) FILTER (is_correct) AS correct_count, CAST(sum(points) AS BIGINT) AS total_score,
    count(*) FILTER (NOT is_correct) AS negative_scores, count(*) FILTER (is_correct IS NULL) AS unanswered_count,
    CAST(sum(cost_usd) AS DOUBLE) AS cost, CAST(sum(tokens_used) AS BIGINT) AS total_tokens,
    stddev_samp(latency_ms / 1000) AS std_s, count(*) FILTER (is_timeout) AS timeout_count,
    count(*) FILTER (is_error) AS error_count, count(DISTINCT category) AS category_count, avg(confidence) AS avg_confidence,
    median(latency_ms) / 1000 AS median_s FROM graded GROUP BY ALL),
ranked AS (SELECT run_id, model_name, latency_ms, count(*) OVER (PARTITION BY run_id, model_name) AS n,
    row_number() OVER (PARTITION BY run_id, model_name ORDER BY latency_ms) AS rn FROM results),
tails AS (SELECT run_id, model_name,
    max(latency_ms) FILTER (rn = least(floor(CAST(0.95 AS DOUBLE) * n), n - 1) + 1) / 1000 AS p95_s FROM ranked GROUP BY ALL)
SELECT run_id, model_name, round(acc, 6) AS accuracy, total_count, answered_count, correct_count, total_score, negative_scores,
  unanswered_count, round(secs, 6) AS mean_s, round(coalesce(std_s, 0), 6) AS std_s, round(median_s, 6) AS median_s,
  round(p95_s, 6) AS p95_s, timeout_count, error_count, round(cost, 6) AS total_cost, total_tokens,
  round(cost / total_count, 6) AS cost_per_question, round(eff, 6) AS cost_efficiency, category_count,
  round(avg_confidence, 6) AS avg_confidence, round(corr, 6) AS confidence_correlation,
  round(category_consistency, 6) AS category_consistency, round(difficulty_consistency, 6) AS difficulty_consistency,
  round(overall, 6) AS overall_score,
  round(CASE WHEN total_count > 30 THEN greatest(0, acc - 1.96 * sqrt(acc * (1 - acc) / total_count)) END, 6) AS ci_low
FROM composite JOIN sums USING (run_id, model_name) JOIN tails USING (run_id, model_name)
  JOIN {_steady('category', 'category_consistency')} a USING (run_id, model_name)
  JOIN {_steady('difficulty_level', 'difficulty_consistency')} b USING (run_id, model_name)""")
def _(spark, sf):
    return rounded(m.comprehensive_metrics(v.graded(spark, sf)).select(
        "run_id", "model_name", "accuracy", "total_count", "answered_count", "correct_count", "total_score",
        "negative_scores", "unanswered_count", "mean_s", "std_s", "median_s", "p95_s", "timeout_count", "error_count",
        "total_cost", "total_tokens", "cost_per_question", "cost_efficiency", "category_count", "avg_confidence",
        "confidence_correlation", "category_consistency", "difficulty_consistency", "overall_score", "ci_low"))


@R.add("e16_performance_summary", f"""
WITH cats AS (SELECT run_id, model_name, string_agg(category || '=' || CAST(score AS BIGINT), ';' ORDER BY category) AS category_scores,
    string_agg(CASE WHEN answered > 0 THEN category || '=' || CAST(CAST(round(acc * 1000000) AS BIGINT) AS VARCHAR) END, ';'
      ORDER BY category) AS category_performance
  FROM (SELECT run_id, model_name, category, sum(points) AS score, count(is_correct) AS answered, {ACC} AS acc
    FROM graded GROUP BY ALL) GROUP BY ALL)
SELECT run_id, model_name, count(*) AS total_questions, count(*) FILTER (is_correct) AS correct_answers,
  round({ACC}, 6) AS accuracy_rate, CAST(sum(points) AS BIGINT) AS signed_score, round(avg(latency_ms), 6) AS avg_response_time_ms,
  round(median(latency_ms), 6) AS median_response_time_ms, round(CAST(sum(cost_usd) AS DOUBLE), 6) AS total_cost_usd,
  CAST(sum(tokens_used) AS BIGINT) AS total_tokens, round(avg(confidence), 6) AS avg_confidence,
  count(*) FILTER (is_error) AS error_count, round(count(*) FILTER (is_error) / count(*), 6) AS error_rate,
  any_value(category_scores) AS category_scores, any_value(category_performance) AS category_performance
FROM graded JOIN cats USING (run_id, model_name) GROUP BY run_id, model_name""")
def _(spark, sf):
    def text(name, value):
        return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(
            e["key"], F.lit("="), value(e["value"]).cast("string"))), ";").alias(name)
    rows = m.performance_summary(v.graded(spark, sf))
    return rounded(rows.select(
        "run_id", "model_name", "total_questions", "correct_answers", "accuracy_rate", "signed_score",
        "avg_response_time_ms", "median_response_time_ms", "total_cost_usd", "total_tokens", "avg_confidence",
        "error_count", "error_rate", text("category_scores", lambda x: x.cast("bigint")),
        text("category_performance", lambda x: F.round(x * 1000000).cast("bigint"))))


@R.add("e17_compare_models", COMPOSITE_SQL + """,
sums AS (SELECT run_id, model_name, CAST(sum(points) AS BIGINT) AS score,
    CASE WHEN count(*) FILTER (is_correct) > 0 THEN CAST(sum(cost_usd) AS DOUBLE) / count(*) FILTER (is_correct) END AS cpc
  FROM graded GROUP BY ALL),
both_sides AS (SELECT * FROM composite JOIN sums USING (run_id, model_name))
SELECT a.run_id, round(a.acc - b.acc, 6) + 0.0 AS accuracy_diff, round(a.cpc - b.cpc, 6) + 0.0 AS cost_diff,
  round(a.secs - b.secs, 6) + 0.0 AS performance_diff, a.score - b.score AS score_diff,
  round(a.overall - b.overall, 6) + 0.0 AS overall_diff,
  CASE WHEN a.acc > b.acc THEN 'model-A' ELSE 'model-R' END AS accuracy_winner,
  CASE WHEN coalesce(a.cpc, 'inf'::DOUBLE) < coalesce(b.cpc, 'inf'::DOUBLE) THEN 'model-A' ELSE 'model-R' END AS cost_winner,
  CASE WHEN a.secs < b.secs THEN 'model-A' ELSE 'model-R' END AS performance_winner,
  CASE WHEN a.score > b.score THEN 'model-A' ELSE 'model-R' END AS score_winner,
  CASE WHEN a.overall > b.overall THEN 'model-A' ELSE 'model-R' END AS overall_winner
FROM both_sides a JOIN both_sides b ON a.run_id = b.run_id WHERE a.model_name = 'model-A' AND b.model_name = 'model-R'""")
def _(spark, sf):
    wide = m.comprehensive_metrics(v.graded(spark, sf), percentiles=False)
    return rounded(m.compare_models(wide, "model-A", "model-R"))


@R.add("e18_aggregate_runs", COMPOSITE_SQL + """,
sums AS (SELECT run_id, model_name,
    CASE WHEN count(*) FILTER (is_correct) > 0 THEN CAST(sum(cost_usd) AS DOUBLE) / count(*) FILTER (is_correct) END AS cpc
  FROM results GROUP BY ALL),
wide AS (SELECT *, round(overall, 9) AS o9, round(acc, 9) AS a9, round(cpc, 9) AS c9, round(secs, 9) AS s9
  FROM composite JOIN sums USING (run_id, model_name))
SELECT run_id, count(*) AS run_count, first(model_name ORDER BY o9 DESC, model_name) AS best_overall,
  first(model_name ORDER BY a9 DESC, model_name) AS best_accuracy,
  first(model_name ORDER BY coalesce(c9, 'inf'::DOUBLE), model_name) AS most_cost_effective,
  first(model_name ORDER BY s9, model_name) AS fastest, round(min(acc), 6) AS accuracy_min, round(max(acc), 6) AS accuracy_max,
  round(min(cpc), 6) AS cost_min, round(max(cpc), 6) AS cost_max, round(min(secs), 6) AS time_min, round(max(secs), 6) AS time_max
FROM wide GROUP BY run_id""")
def _(spark, sf):
    wide = m.comprehensive_metrics(v.graded(spark, sf), percentiles=False)
    even = wide.withColumns({c: F.round(c, 9) for c in ("overall_score", "accuracy", "cost_per_correct", "mean_s")})
    return rounded(m.aggregate_runs(even, ["run_id"]))


@R.add("e19_metric_spread", """
WITH wide AS (SELECT run_id, model_name, coalesce(avg(CAST(is_correct AS INT)), 0) AS acc,
    CAST(sum(cost_usd) AS DOUBLE) / count(*) AS cpq, avg(latency_ms / 1000) AS secs FROM results GROUP BY ALL),
pool AS (SELECT run_id, avg(latency_ms) AS mean_ms, median(latency_ms) AS median_ms, stddev_samp(latency_ms) AS std_ms,
    avg(CASE WHEN is_correct THEN 1 ELSE 0 END) AS overall_accuracy, CAST(sum(cost_usd) AS DOUBLE) AS total_cost FROM results GROUP BY ALL)
SELECT run_id, round(max(acc) - min(acc), 6) AS accuracy_spread, round(max(cpq) - min(cpq), 6) AS cost_spread,
  round(max(secs) - min(secs), 6) AS performance_spread, first(model_name ORDER BY round(acc, 9) DESC, model_name) AS best_accuracy,
  first(model_name ORDER BY round(cpq, 9), model_name) AS best_cost, first(model_name ORDER BY round(secs, 9), model_name) AS best_performance,
  round(any_value(mean_ms), 6) AS mean_ms, round(any_value(median_ms), 6) AS median_ms, round(any_value(std_ms), 6) AS std_ms,
  round(any_value(overall_accuracy), 6) AS overall_accuracy, round(any_value(total_cost), 6) AS total_cost
FROM wide JOIN pool USING (run_id) GROUP BY run_id""")
def _(spark, sf):
    rows = v.results(spark, sf)
    wide = m.cost(rows).join(m.accuracy(rows).select("run_id", "model_name", "accuracy"), ["run_id", "model_name"]).join(
        m.latency(rows).select("run_id", "model_name", "mean_s"), ["run_id", "model_name"])
    even = wide.withColumns({c: F.round(c, 9) for c in ("accuracy", "cost_per_question", "mean_s")})
    spread = m.metric_spread(even, ["run_id"]).select(
        "run_id", "accuracy_spread", "cost_spread", "performance_spread", "best_accuracy", "best_cost", "best_performance")
    pool = m.pooled_response_stats(rows, ["run_id"]).select(
        "run_id", "mean_ms", "median_ms", "std_ms", "overall_accuracy", "total_cost")
    return rounded(spread.join(pool, "run_id"))


@R.add("e20_run_summary", """
SELECT run_id, count(*) AS total_responses, count(*) FILTER (is_correct) AS correct_responses,
  round(count(*) FILTER (is_correct) / count(*), 6) AS overall_accuracy, count(DISTINCT category) AS categories,
  count(DISTINCT difficulty_level) AS difficulty_levels, CAST(min(value) AS BIGINT) AS value_min,
  CAST(max(value) AS BIGINT) AS value_max FROM graded GROUP BY ALL""")
def _(spark, sf):
    return rounded(r.run_summary(v.results(spark, sf), v.questions(spark, sf)))


@R.add("e21_question_statistics", """
WITH used AS (SELECT q.* FROM questions q WHERE question_id IN (SELECT question_id FROM results WHERE run_id = 5)),
scopes AS (SELECT 'all' AS scope, * FROM questions UNION ALL SELECT 'run 5', * FROM used)
SELECT scope, count(*) AS total_questions, count(DISTINCT category) AS unique_categories,
  CAST(min(value) FILTER (value > 0) AS BIGINT) AS value_min, CAST(max(value) FILTER (value > 0) AS BIGINT) AS value_max,
  round(avg(value) FILTER (value > 0), 6) AS value_average, count(*) FILTER (value > 0) AS value_count FROM scopes GROUP BY ALL""")
def _(spark, sf):
    q = v.questions(spark, sf)
    whole = p.question_statistics(q).withColumn("scope", F.lit("all"))
    one = p.question_statistics(q, v.results(spark, sf), 5).withColumn("scope", F.lit("run 5"))
    return rounded(whole.unionByName(one))


@R.add("e22_dashboard", """
SELECT (SELECT count(*) FROM questions) AS total_questions, (SELECT count(DISTINCT model_name) FROM performance) AS models_tested,
  (SELECT count(*) FROM results) AS questions_answered,
  (SELECT floor(max(accuracy_rate) * 10000 + 0.5) / 100 FROM performance) AS best_accuracy""")
def _(spark, sf):
    return p.dashboard(v.questions(spark, sf), v.performance(spark, sf), v.results(spark, sf))


@R.add("e23_completeness", """
WITH n AS (SELECT count(*) AS n, count(accuracy_rate) AS a, count(signed_score) AS s, count(avg_response_time_ms) AS t,
  count(total_cost_usd) AS c, count(model_name) AS m FROM performance)
SELECT 'accuracy_rate' AS column_name, n - a AS null_count, round((n - a) * 100 / n, 2) AS null_percentage FROM n
UNION ALL SELECT 'signed_score', n - s, round((n - s) * 100 / n, 2) FROM n
UNION ALL SELECT 'avg_response_time_ms', n - t, round((n - t) * 100 / n, 2) FROM n
UNION ALL SELECT 'total_cost_usd', n - c, round((n - c) * 100 / n, 2) FROM n
UNION ALL SELECT 'model_name', n - m, round((n - m) * 100 / n, 2) FROM n""")
def _(spark, sf):
    return p.completeness(v.performance(spark, sf), ["accuracy_rate", "signed_score", "avg_response_time_ms",
                                                     "total_cost_usd", "model_name"])


@R.add("e23b_quality_issues", """
SELECT count(*) AS total_records, count(*) FILTER (length(question) < 20) AS short_questions,
  count(DISTINCT category) AS unique_categories FROM questions""")
def _(spark, sf):
    return p.quality_issues(v.questions(spark, sf))


@R.add("e24_category_report", """
SELECT run_id, category, count(*) FILTER (is_correct) AS correct, count(*) AS total,
  round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy FROM graded GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.category_report(v.graded(spark, sf)))


@R.add("e25_grading_statistics", """
SELECT model_name, count(*) AS total_graded, count(*) FILTER (is_correct) AS correct_count,
  count(*) - count(*) FILTER (is_correct) AS incorrect_count, round(avg(confidence), 6) AS avg_confidence,
  round(count(*) FILTER (is_correct) / count(*), 6) AS accuracy_rate,
  round((count(*) - count(*) FILTER (is_correct)) / count(*), 6) AS error_rate FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.grading_statistics(v.results(spark, sf)))


@R.add("e26_confidence_distribution", """
WITH ranked AS (SELECT model_name, confidence, count(*) OVER (PARTITION BY model_name) AS n,
  row_number() OVER (PARTITION BY model_name ORDER BY confidence) AS rn FROM results)
SELECT model_name, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS min, round(max(confidence), 6) AS max,
  round(max(confidence) FILTER (rn = n // 2 + 1), 6) AS median, round(stddev_pop(confidence), 6) AS std FROM ranked GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.confidence_distribution(v.results(spark, sf)))


# ---- usage and cost ----------------------------------------------------------------------------

@R.add("e27_usage_summary", """
WITH per AS (SELECT model_id, sum(cost) AS c, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o,
  min(ts) AS a, max(ts) AS b FROM usage_log GROUP BY ALL)
SELECT round(sum(c), 4) AS total_cost, CAST(sum(i) AS BIGINT) AS total_input_tokens, CAST(sum(o) AS BIGINT) AS total_output_tokens,
  CAST(sum(n) AS BIGINT) AS total_requests, string_agg(model_id || '=' || CAST(round(c * 100) AS BIGINT), ';' ORDER BY model_id) AS cost_by_model,
  strftime(min(a), '%Y-%m-%d %H:%M:%S.%f') AS period_start, strftime(max(b), '%Y-%m-%d %H:%M:%S.%f') AS period_end,
  round(sum(c) / sum(n), 6) AS average_cost_per_request, first(model_id ORDER BY c DESC, model_id) AS most_expensive_model,
  first(model_id ORDER BY c, model_id) AS cheapest_model FROM per""")
def _(spark, sf):
    row = co.usage_summary(v.usage(spark, sf))
    listed = F.array_join(F.transform(F.map_entries("cost_by_model"), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string"))), ";")
    return rounded(row.withColumn("cost_by_model", listed).withColumn("total_cost", F.round("total_cost", 4)))


@R.add("e28_cost_breakdown", """
WITH names(model_id, model_name, provider) AS (VALUES ('openai/gpt-4', 'GPT-4', 'openai'),
  ('meta-llama/llama-2-70b-chat', 'Llama 2 70B Chat', 'meta'), ('google/palm-2-chat', 'PaLM 2 Chat', 'google'))
SELECT u.model_id, coalesce(any_value(n.model_name), u.model_id) AS model_name, coalesce(any_value(n.provider), 'unknown') AS provider,
  round(sum(cost), 4) AS total_cost, count(*) AS total_requests, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, round(sum(cost) / count(*), 6) AS average_cost_per_request,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_used, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used
FROM usage_log u LEFT JOIN names n USING (model_id) GROUP BY u.model_id""")
def _(spark, sf):
    return rounded(co.cost_breakdown(v.usage(spark, sf), cat.static_catalog(spark))
                   .withColumn("total_cost", F.round("total_cost", 4)))


@R.add("e29_daily_costs", """
SELECT strftime(ts, '%Y-%m-%d') AS date, round(sum(cost), 4) AS total_cost, count(*) AS total_requests,
  string_agg(DISTINCT model_id, ',' ORDER BY model_id) AS models_used, count(DISTINCT model_id) AS num_models
FROM usage_log WHERE ts <= TIMESTAMP '2024-01-31' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY 1""")
def _(spark, sf):
    days = co.daily_costs(v.usage(spark, sf), "2024-01-31", 20)
    return rounded(days.withColumn("models_used", F.array_join("models_used", ",")).withColumn(
        "total_cost", F.round("total_cost", 4)))


@R.add("e30_usage_counters", """
SELECT model_id, count(*) AS total_requests, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  round(sum(cost), 4) AS total_cost_usd, round(sum(cost) / count(*), 6) AS average_cost_per_request,
  round(sum(input_tokens + output_tokens) / count(*), 6) AS average_tokens_per_request FROM usage_log GROUP BY ALL""")
def _(spark, sf):
    return rounded(co.usage_counters(v.usage(spark, sf)).withColumn("total_cost_usd", F.round("total_cost_usd", 4)))


@R.add("e31_run_progress", """
WITH counts AS (SELECT run_id, count(*) AS completed, count(*) FILTER (is_correct) AS good, count(*) FILTER (NOT is_correct) AS bad,
  count(*) FILTER (is_correct IS NULL) AS unanswered, sum(latency_ms) / 1000 AS secs FROM results GROUP BY ALL)
SELECT run_id, completed AS completed_questions, unanswered, total_questions, round(completed * 100.0 / total_questions, 6) AS completion_pct,
  round(good * 100.0 / (good + bad), 6) AS success_rate, round((good + bad) * 100.0 / completed, 6) AS answer_rate,
  round((secs / completed) * (total_questions - completed), 6) AS remaining_seconds
FROM counts JOIN (SELECT s_suppkey AS run_id, 1000 + s_nationkey AS total_questions FROM supplier) USING (run_id)""")
def _(spark, sf):
    planned = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("run_id"), (F.lit(1000) + F.col("s_nationkey")).alias("total_questions"))
    return rounded(r.run_progress(r.progress_from_results(v.results(spark, sf), planned)).select(
        "run_id", "completed_questions", "unanswered", "total_questions", "completion_pct", "success_rate",
        "answer_rate", "remaining_seconds"))


@R.add("e32_filtered_counts", """
SELECT 'questions over $1000' AS what, count(*) AS n FROM questions WHERE value > 1000
UNION ALL SELECT 'distinct categories', count(DISTINCT category) FROM questions
UNION ALL SELECT 'distinct difficulties', count(DISTINCT difficulty_level) FROM questions""")
def _(spark, sf):
    q = v.questions(spark, sf)
    parts = [("questions over $1000", q.where(F.col("value") > 1000)),
             ("distinct categories", p.distinct_values(q, "category")),
             ("distinct difficulties", p.distinct_values(q, "difficulty_level"))]
    out = [p.filtered_count(df).select(F.lit(name).alias("what"), "n") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@R.add("e33_representativeness", """
WITH sample AS (SELECT * FROM questions ORDER BY md5('11|' || CAST(question_id AS VARCHAR)), question_id LIMIT 400),
o AS (SELECT 'category' AS column_name, category AS value, count(*) / sum(count(*)) OVER () AS share FROM questions GROUP BY category
  UNION ALL SELECT 'difficulty_level', difficulty_level, count(*) / sum(count(*)) OVER () FROM questions GROUP BY difficulty_level
  UNION ALL SELECT 'round', round, count(*) / sum(count(*)) OVER () FROM questions GROUP BY round),
s AS (SELECT 'category' AS column_name, category AS value, count(*) / sum(count(*)) OVER () AS share FROM sample GROUP BY category
  UNION ALL SELECT 'difficulty_level', difficulty_level, count(*) / sum(count(*)) OVER () FROM sample GROUP BY difficulty_level
  UNION ALL SELECT 'round', round, count(*) / sum(count(*)) OVER () FROM sample GROUP BY round)
SELECT o.column_name, round(avg(abs(o.share - s.share)), 6) AS mean_difference, round(max(abs(o.share - s.share)), 6) AS max_difference,
  (SELECT count(*) FROM o x WHERE x.column_name = o.column_name) AS original_unique,
  (SELECT count(*) FROM s x WHERE x.column_name = o.column_name) AS sample_unique,
  round((SELECT count(*) FROM sample) / (SELECT count(*) FROM questions), 6) AS sampling_ratio
FROM o JOIN s ON o.column_name = s.column_name AND o.value = s.value GROUP BY o.column_name""")
def _(spark, sf):
    q = v.questions(spark, sf)
    return rounded(s.representativeness(q, s.random_sample(q, 400, 11)))


@R.add("e34_batch_estimate", PRICED_SQL + """,
prices_used AS (SELECT model_id, any_value(input_price) AS ip, any_value(output_price) AS op, count(*) AS n FROM priced GROUP BY ALL)
SELECT model_id, n AS num_questions, round(((n * 100 / 1000000.0) * ip + (n * 50 / 1000000.0) * op) * 0.6, 6) AS estimated_total_cost,
  round(((n * 100 / 1000000.0) * ip + (n * 50 / 1000000.0) * op) * 0.6 / n, 9) AS cost_per_question,
  n * 150 AS total_tokens, CAST(40 AS DOUBLE) AS tier_discount FROM prices_used""")
def _(spark, sf):
    batches = priced(spark, sf).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("num_questions"), F.first("input_price").alias("input_price"),
        F.first("output_price").alias("output_price"))
    return co.batch_estimate(batches, "enterprise").select(
        "model_id", "num_questions", F.round("estimated_total_cost", 6).alias("estimated_total_cost"),
        F.round("cost_per_question", 9).alias("cost_per_question"), "total_tokens", "tier_discount")


@R.add("e35_catalog_summary", """
SELECT count(*) AS total_models, count(DISTINCT provider) AS providers, round(min(input_cost), 6) AS min_input_cost,
  round(max(input_cost), 6) AS max_input_cost, round(min(output_cost), 6) AS min_output_cost, round(max(output_cost), 6) AS max_output_cost,
  CAST(min(context_length) AS BIGINT) AS min_context, CAST(max(context_length) AS BIGINT) AS max_context,
  count(*) FILTER (supports_streaming) AS streaming_models FROM catalog""")
def _(spark, sf):
    return rounded(cat.catalog_summary(v.catalog(spark, sf)))


@R.add("e36_throughput", """
SELECT run_id, model_name, round(avg(tokens_output / (latency_ms / 1000)), 6) AS tokens_per_second,
  round(coalesce(1 - stddev_samp(latency_ms / 1000) / avg(latency_ms / 1000), 0), 6) AS latency_consistency,
  round(avg(latency_ms / 1000), 6) AS mean_s FROM results GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.throughput(v.results(spark, sf)))


@R.add("e37_category_intervals", f"""
SELECT model_name, category, round(p, 6) AS accuracy, round(1 - p, 6) AS error_rate, n AS total_count,
  round(CASE WHEN n > 30 THEN greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)) END, 6) AS ci_low,
  round(CASE WHEN n > 30 THEN least(1, p + 1.96 * sqrt(p * (1 - p) / n)) END, 6) AS ci_high
FROM (SELECT model_name, category, {ACC} AS p, count(*) AS n FROM graded GROUP BY ALL)""")
def _(spark, sf):
    return rounded(m.category_intervals(v.graded(spark, sf)).select(
        "model_name", "category", "accuracy", "error_rate", "total_count", "ci_low", "ci_high"))


@R.add("e37b_accuracy_significance", """
WITH a AS (SELECT run_id, model_name, count(*) FILTER (is_correct) AS x, count(is_correct) AS n FROM results GROUP BY ALL),
pair AS (SELECT p.run_id, p.x / p.n - q.x / q.n AS diff, (p.x + q.x) / (p.n + q.n) AS pool, 1.0 / p.n + 1.0 / q.n AS inv
  FROM a p JOIN a q USING (run_id) WHERE p.model_name = 'model-A' AND q.model_name = 'model-N')
SELECT run_id, round(diff, 6) + 0.0 AS accuracy_diff,
  round(CASE WHEN pool * (1 - pool) > 0 THEN diff / sqrt(pool * (1 - pool) * inv) ELSE 0 END, 6) + 0.0 AS z FROM pair""")
def _(spark, sf):
    return rounded(m.accuracy_significance(v.results(spark, sf), "model-A", "model-N"))


@R.add("e37c_accuracy_trend", """
SELECT model_name, count(*) AS runs, round(covar_pop(accuracy_rate, epoch_us(created_at) / 86400000000.0)
  / var_pop(epoch_us(created_at) / 86400000000.0), 9) AS slope_per_day
FROM performance JOIN runs USING (run_id) WHERE accuracy_rate IS NOT NULL AND status = 'completed' GROUP BY model_name""")
def _(spark, sf):
    rows = j.completed_performance(v.performance(spark, sf), v.runs(spark, sf))
    return rounded(m.accuracy_trend(rows), 9)


_PAIR = """pairs AS (SELECT run_id AS first_run, model_name AS first_model, run_id + 1 AS second_run, model_name AS second_model FROM sides
  UNION ALL SELECT run_id, model_name, run_id + 2, 'model-R' FROM sides WHERE model_name <> 'model-R')"""


def _pairs(rows):
    """Each model against itself in the next run, and against another model two runs on."""
    each = rows.select("run_id", "model_name").distinct()
    run, model = F.col("run_id"), F.col("model_name")
    return each.select(run.alias("first_run"), model.alias("first_model"), (run + 1).alias("second_run"), model.alias("second_model")).unionByName(
        each.where(model != "model-R").select(run.alias("first_run"), model.alias("first_model"), (run + 2).alias("second_run"),
                                              F.lit("model-R").alias("second_model")))


@R.add("e17b_compare_runs", COMPOSITE_SQL + f""",
sums AS (SELECT run_id, model_name, CAST(sum(points) AS BIGINT) AS score,
    CASE WHEN count(*) FILTER (is_correct) > 0 THEN CAST(sum(cost_usd) AS DOUBLE) / count(*) FILTER (is_correct) END AS cpc
  FROM graded GROUP BY ALL),
sides AS (SELECT * FROM composite JOIN sums USING (run_id, model_name)), {_PAIR}
SELECT p.*, round(a.acc, 6) AS a_accuracy, round(a.cpc, 6) AS a_cost_per_correct, round(a.secs, 6) AS a_mean_s, a.score AS a_total_score, round(a.overall, 6) AS a_overall_score,
  round(b.acc, 6) AS b_accuracy, round(b.cpc, 6) AS b_cost_per_correct, round(b.secs, 6) AS b_mean_s, b.score AS b_total_score, round(b.overall, 6) AS b_overall_score,
  round(a.acc - b.acc, 6) + 0.0 AS accuracy_diff, round(a.cpc - b.cpc, 6) + 0.0 AS cost_diff, round(a.secs - b.secs, 6) + 0.0 AS performance_diff, a.score - b.score AS score_diff,
  CASE WHEN a.score > b.score THEN p.first_model || ' (' || p.first_run || ')' ELSE p.second_model || ' (' || p.second_run || ')' END AS score_winner
FROM pairs p JOIN sides a ON a.run_id = p.first_run AND a.model_name = p.first_model JOIN sides b ON b.run_id = p.second_run AND b.model_name = p.second_model""")
def _(spark, sf):
    wide = m.comprehensive_metrics(v.graded(spark, sf), percentiles=False)
    return rounded(m.compare_pairs(wide, _pairs(wide)).drop(
        "overall_diff", "accuracy_winner", "cost_winner", "performance_winner", "overall_winner"))


@R.add("e37d_pair_significance", f"""
WITH sides AS (SELECT run_id, model_name, count(*) FILTER (is_correct) AS x, count(is_correct) AS n FROM results GROUP BY ALL), {_PAIR},
pair AS (SELECT p.*, a.x / a.n - b.x / b.n AS diff, (a.x + b.x) / (a.n + b.n) AS pool, 1.0 / a.n + 1.0 / b.n AS inv FROM pairs p
  JOIN sides a ON a.run_id = p.first_run AND a.model_name = p.first_model JOIN sides b ON b.run_id = p.second_run AND b.model_name = p.second_model)
SELECT first_run, first_model, second_run, second_model, round(diff, 6) + 0.0 AS accuracy_diff,
  round(CASE WHEN pool * (1 - pool) > 0 THEN diff / sqrt(pool * (1 - pool) * inv) ELSE 0 END, 6) + 0.0 AS z FROM pair""")
def _(spark, sf):
    rows = v.results(spark, sf)
    return rounded(m.pair_significance(rows, _pairs(rows)))


_NULL_KEYS = """keyed AS (SELECT * REPLACE (CASE WHEN run_id % 5 > 0 THEN run_id END AS run_id, nullif(model_name, 'model-N') AS model_name) FROM results)"""


def _null_keys(rows):
    return rows.withColumn("run_id", F.when(F.pmod(F.col("run_id"), F.lit(5)) > 0, F.col("run_id"))).withColumn(
        "model_name", F.nullif("model_name", F.lit("model-N")))


@R.add("e05b_percentiles_null_keys", f"""WITH {_NULL_KEYS}, r AS (SELECT run_id, model_name, latency_ms,
    row_number() OVER (PARTITION BY run_id, model_name ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY run_id, model_name) AS n FROM keyed)
SELECT run_id, model_name, round(median(latency_ms) / 1000, 6) AS median_s, round(max(latency_ms) FILTER (rn = least(floor(0.95 * n), n - 1) + 1) / 1000, 6) AS p95_s,
  round(max(latency_ms) FILTER (rn = least(floor(0.99 * n), n - 1) + 1) / 1000, 6) AS p99_s FROM r GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.latency_percentiles(_null_keys(v.results(spark, sf))))


@R.add("e11b_type_frequencies_null_keys", f"""WITH {_NULL_KEYS}, long AS (SELECT run_id, model_name, 'response_type' AS kind, response_type AS label FROM keyed
  UNION ALL SELECT run_id, model_name, 'match_type', match_type FROM keyed)
SELECT run_id, model_name, kind, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run_id, model_name, kind), 6) AS share FROM long
GROUP BY run_id, model_name, kind, label""")
def _(spark, sf):
    return rounded(m.type_frequencies(_null_keys(v.results(spark, sf))))


@R.add("e15b_metrics_null_keys", f"""WITH {_NULL_KEYS}, g AS (SELECT k.*, q.category FROM keyed k JOIN questions q USING (question_id))
SELECT run_id, model_name, count(*) AS total_count, round(avg(latency_ms) / 1000, 6) AS mean_s, round(median(latency_ms) / 1000, 6) AS median_s,
  count(DISTINCT category) AS category_count FROM g GROUP BY ALL""")
def _(spark, sf):
    return rounded(m.comprehensive_metrics(_null_keys(v.graded(spark, sf))).select(
        "run_id", "model_name", "total_count", "mean_s", "median_s", "category_count"))
