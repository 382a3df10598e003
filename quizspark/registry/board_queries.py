"""Leaderboards, histories, retention (F), top-k (G) and set operations (H)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizspark import views as v
from quizspark.operators import catalog as cat, leaderboard as lb, metrics as m, profile as p, retention as rt
from quizspark.operators import sampling as s, validate as val
from quizspark.plans.ranking import with_position
from quizspark.registry.base import Registry, rounded

R = Registry()


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Graded answers to a ranked leaderboard: accuracy and signed score per model."""
    rows = v.graded(spark, sf)
    board = m.accuracy(rows, ["model_name"]).join(m.signed_scores(rows, ["model_name"]), "model_name")
    return rounded(lb.model_ranking(board))


FLAGSHIP_SQL = """
SELECT model_name, round(avg(CAST(is_correct AS INT)), 6) AS accuracy, count(*) FILTER (is_correct) AS correct_count,
  count(is_correct) AS answered_count, count(*) AS total_count, CAST(sum(points) AS BIGINT) AS total_score,
  count(*) FILTER (is_correct) AS positive_scores, count(*) FILTER (NOT is_correct) AS negative_scores,
  count(*) FILTER (is_correct IS NULL) AS unanswered_count,
  row_number() OVER (ORDER BY sum(points) DESC, model_name) AS rank FROM graded GROUP BY model_name LIMIT 10"""


R.add("f00_model_leaderboard", FLAGSHIP_SQL)(flagship)

TREND_SQL = """
WITH ranked AS (SELECT p.*, r.created_at, row_number() OVER (PARTITION BY model_name ORDER BY r.created_at DESC, p.run_id DESC) AS rn
  FROM performance p JOIN runs r USING (run_id) WHERE r.status = 'completed' AND accuracy_rate IS NOT NULL),
trend AS (SELECT a.*, CASE WHEN b.accuracy_rate IS NULL THEN 'stable' WHEN a.accuracy_rate > b.accuracy_rate THEN 'up'
    WHEN a.accuracy_rate < b.accuracy_rate THEN 'down' ELSE 'stable' END AS trend
  FROM (SELECT * FROM ranked WHERE rn = 1) a LEFT JOIN (SELECT model_name, accuracy_rate FROM ranked WHERE rn = 2) b USING (model_name))
"""


@R.add("f01_trends", TREND_SQL + "SELECT model_name, run_id, round(accuracy_rate, 6) AS accuracy_rate, trend FROM trend")
def _(spark, sf):
    return rounded(lb.trends(v.performance(spark, sf), v.runs(spark, sf)).select(
        "model_name", "run_id", "accuracy_rate", "trend"))


@R.add("f02_web_leaderboard", TREND_SQL + """
SELECT row_number() OVER (ORDER BY accuracy_rate DESC, model_name) AS rank, model_name AS name,
  floor((accuracy_rate * 100) * 100 + 0.5) / 100.0 AS accuracy,
  floor((floor((accuracy_rate * 100) * 100 + 0.5) / 100.0) * 10 * 1 + 0.5) / 1.0 AS score, 1000 AS max_score,
  floor(coalesce(avg_response_time_ms, 1000) / 1000 * 100 + 0.5) / 100.0 AS avg_time,
  floor(coalesce(total_cost_usd, 0) * 100 + 0.5) / 100.0 AS cost,
  floor(CASE WHEN coalesce(total_cost_usd, 0) > 0 THEN accuracy_rate / total_cost_usd * 1000 ELSE accuracy_rate * 100 END + 0.5) AS efficiency,
  trend FROM trend ORDER BY 1 LIMIT 5""")
def _(spark, sf):
    return lb.web_leaderboard(v.performance(spark, sf), v.runs(spark, sf))


DONE = "performance p JOIN runs r USING (run_id) WHERE r.status = 'completed' AND signed_score IS NOT NULL"
BOARD = """rank, model_name, run_id, signed_score, round(coalesce(accuracy_rate, 0), 6) AS accuracy, correct_answers AS correct,
  total_questions - correct_answers AS incorrect"""


@R.add("f03_score_leaderboard", f"""
SELECT {BOARD} FROM (SELECT p.*, row_number() OVER (ORDER BY signed_score DESC, model_name, run_id) AS rank FROM {DONE})
WHERE rank <= 10""")
def _(spark, sf):
    return rounded(lb.score_leaderboard(v.performance(spark, sf), v.runs(spark, sf)))


@R.add("f04_unique_leaderboard", f"""
SELECT {BOARD} FROM (SELECT *, row_number() OVER (ORDER BY signed_score DESC, model_name, run_id) AS rank FROM (
  SELECT p.*, row_number() OVER (PARTITION BY model_name ORDER BY signed_score DESC, r.created_at DESC, run_id) AS rn FROM {DONE})
  WHERE rn = 1) WHERE rank <= 10""")
def _(spark, sf):
    return rounded(lb.score_leaderboard(v.performance(spark, sf), v.runs(spark, sf), unique=True))


@R.add("f05_flag_duplicates", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, doc_id > min(doc_id) OVER (PARTITION BY text) AS is_duplicate
FROM documents WHERE length(text) > 0""")
def _(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return val.flag_duplicates(docs, "text", "doc_id").where(F.length("text") > 0).select(
        "doc_id", "first_id", "is_duplicate")


@R.add("f05b_duplicate_questions", """
SELECT question_id, question, min(question_id) OVER (PARTITION BY question) AS first_id,
  question_id > min(question_id) OVER (PARTITION BY question) AS is_duplicate FROM questions""")
def _(spark, sf):
    return val.flag_duplicates(v.questions(spark, sf).select("question_id", "question"))


@R.add("f06_keep_last", """
SELECT run_id, models_tested FROM runs
QUALIFY row_number() OVER (PARTITION BY models_tested ORDER BY created_at DESC, run_id DESC) <= 5""")
def _(spark, sf):
    return rt.keep_last(v.runs(spark, sf).select("run_id", "models_tested", "created_at"), "models_tested", 5).drop("created_at")


@R.add("f06b_latest_per_key", """
SELECT models_tested, run_id, status FROM runs
QUALIFY row_number() OVER (PARTITION BY models_tested ORDER BY created_at DESC, run_id DESC) = 1""")
def _(spark, sf):
    runs = v.runs(spark, sf).select("models_tested", "run_id", "status", "created_at")
    return rt.latest_per_key(runs, "models_tested").select("models_tested", "run_id", "status")


@R.add("f07_expire", """
SELECT run_id, 'all states' AS rule, created_at < TIMESTAMP '1999-06-01' - INTERVAL 400 DAY AS expired FROM runs
UNION ALL SELECT run_id, 'finished', status IN ('completed', 'failed') AND created_at < TIMESTAMP '1999-06-01' - INTERVAL 400 DAY FROM runs""")
def _(spark, sf):
    runs = v.runs(spark, sf).select("run_id", "status", "created_at")
    parts = []
    for rule, states in (("all states", None), ("finished", ["completed", "failed"])):
        kept, gone = rt.expire(runs, "1999-06-01", 400, states=states)
        parts += [df.select("run_id", F.lit(rule).alias("rule"), F.lit(flag).alias("expired"))
                  for df, flag in ((kept, False), (gone, True))]
    return reduce(DataFrame.unionByName, parts)


@R.add("f08_rate_audit", """
WITH seen AS (SELECT event_id, epoch_us(ts) AS us, count(*) OVER w AS recent_requests, min(epoch_us(ts)) OVER w AS oldest
  FROM usage_log WINDOW w AS (PARTITION BY model_id ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND 1 PRECEDING))
SELECT event_id, recent_requests, recent_requests >= 3 AS is_violation,
  round(CASE WHEN recent_requests >= 3 THEN (600000000 - (us - oldest)) / 1000000.0 ELSE 0 END, 6) AS wait_seconds FROM seen""")
def _(spark, sf):
    log = v.usage(spark, sf).select("event_id", "ts", "model_id")
    return rounded(rt.rate_audit(log, 3, window_seconds=600).select(
        "event_id", "recent_requests", "is_violation", "wait_seconds"))


@R.add("f09_model_history", """
SELECT run_id, status, strftime(created_at, '%Y-%m-%d') AS day FROM runs WHERE CASE WHEN models_tested[1] = '['
  THEN list_contains(CAST(models_tested AS JSON)::VARCHAR[], 'model-2') ELSE contains(models_tested, 'model-2') END
ORDER BY created_at DESC, run_id DESC LIMIT 20""")
def _(spark, sf):
    return lb.model_history(v.runs(spark, sf), "model-2").select(
        "run_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


# ---- top-k -------------------------------------------------------------------------------------

@R.add("g01_recent_runs", "SELECT run_id, status FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 10")
def _(spark, sf):
    return lb.recent_runs(v.runs(spark, sf)).select("run_id", "status")


@R.add("g02_top_categories", """
SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM questions), 6) AS percent
FROM questions GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def _(spark, sf):
    return rounded(p.top_categories(v.questions(spark, sf)))


@R.add("g03_top_category_scores", """
SELECT * FROM (SELECT run_id, model_name, category, CAST(sum(points) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY run_id, model_name ORDER BY sum(points) DESC, category) AS rank FROM graded
  GROUP BY run_id, model_name, category)
WHERE rank <= 5""")
def _(spark, sf):
    scores = m.breakdowns(v.graded(spark, sf)).where(F.col("dimension") == "category").select(
        "run_id", "model_name", F.col("label").alias("category"), "score")
    return rounded(lb.top_category_scores(scores))


@R.add("g04_cheapest_models", """
SELECT model_id, round(input_cost + output_cost, 6) AS price FROM catalog ORDER BY input_cost + output_cost, model_id LIMIT 5""")
def _(spark, sf):
    return cat.cheapest_models(v.catalog(spark, sf)).select(
        "model_id", F.round(F.col("input_cost") + F.col("output_cost"), 6).alias("price"))


_SORTED = {"rank": ("signed_score", "DESC"), "score": ("signed_score", "DESC"), "accuracy": ("accuracy_rate", "DESC"),
           "speed": ("avg_response_time_ms", "ASC"), "cost": ("total_cost_usd", "ASC"), "efficiency": ("efficiency", "DESC")}
_EFFICIENCY = "CASE WHEN total_cost_usd > 0 THEN accuracy_rate / total_cost_usd END"


@R.add("g06_resort_leaderboard", f"WITH board AS (SELECT *, {_EFFICIENCY} AS efficiency FROM performance) " + " UNION ALL ".join(
    f"SELECT '{by}' AS sorted_by, run_id, row_number() OVER (ORDER BY {col} {way} NULLS LAST, model_name, run_id) AS place FROM board"
    for by, (col, way) in _SORTED.items()))
def _(spark, sf):
    """The whole board under each of its six orders."""
    board, parts = v.performance(spark, sf).withColumn("efficiency", F.expr(_EFFICIENCY)), []
    for by in _SORTED:
        rows = lb.resort(board, by).select("run_id", F.monotonically_increasing_id().alias("_at"))
        parts.append(with_position(rows, "_at", "place").select(F.lit(by).alias("sorted_by"), "run_id", "place"))
    return reduce(DataFrame.unionByName, parts)


# ---- sets --------------------------------------------------------------------------------------

@R.add("h01_concatenated_strata", """
SELECT question_id, difficulty_level FROM questions
QUALIFY row_number() OVER (PARTITION BY difficulty_level ORDER BY md5('5|' || CAST(question_id AS VARCHAR)), question_id) <= 40""")
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "difficulty_level")
    levels = p.distinct_values(q, "difficulty_level")
    quota = levels.withColumn("n_take", F.lit(40).cast("bigint"))
    return s.smallest_by_hash(q, ["difficulty_level"], s.seeded_key(5, "question_id"), "question_id", quota)


@R.add("h02_outcome_union", """
SELECT result_id, coalesce(is_correct, FALSE) AS correct FROM results
QUALIFY row_number() OVER (PARTITION BY coalesce(is_correct, FALSE) ORDER BY md5('9|' || result_id), result_id) <= 25""")
def _(spark, sf):
    rows = s.outcome_sample(v.results(spark, sf).select("result_id", "is_correct"), correct=25, incorrect=25, seed=9)
    return rows.select("result_id", F.coalesce("is_correct", F.lit(False)).alias("correct"))


@R.add("h03_common_and_missing_values", """
WITH sample AS (SELECT DISTINCT question FROM (
  SELECT * FROM questions ORDER BY md5('3|' || CAST(question_id AS VARCHAR)), question_id LIMIT 60))
SELECT DISTINCT q.question, s.question IS NOT NULL AS in_sample FROM questions q LEFT JOIN sample s ON q.question = s.question""")
def _(spark, sf):
    q = v.questions(spark, sf)
    return s.value_overlap(q, s.random_sample(q, 60, 3), "question")
