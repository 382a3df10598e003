"""Streaming jobs (M), run over the event and line-item files to the end of the input.

Append-mode windows appear once the watermark has passed them, so the SQL keeps the windows that end
at or before (newest event - lateness).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quizspark import views as v
from quizspark.operators import catalog as cat
from quizspark.registry.base import Registry, rounded
from quizspark.streaming import jobs as st

R = Registry()


def _event_stream(spark, sf):
    """The usage log of ``views.usage`` as a stream."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    return st.read_parquet_stream(spark, f"{sf}/events*.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), v.usage_model(kind).alias("model_id"),
        F.col("user_id").cast("string").alias("session_id"), (k * 10).alias("input_tokens"), k.alias("output_tokens"),
        F.col("value").alias("cost"), (kind == "error").alias("is_error"))


@R.add("m01_running_grading_statistics", """
SELECT model_name, response_type, count(*) AS total_graded, count(*) FILTER (is_correct) AS correct_count,
  count(*) - count(*) FILTER (is_correct) AS incorrect_count, round(avg(confidence), 6) AS avg_confidence FROM results GROUP BY ALL""")
def _(spark, sf):
    line = F.col("l_linenumber")
    rows = st.read_parquet_stream(spark, f"{sf}/lineitem*.parquet").select(
        F.concat(F.lit("model-"), "l_returnflag").alias("model_name"),
        F.when(line <= 2, "jeopardy_format").when(line <= 4, "direct_answer").when(line == 5, "refusal")
        .when(line == 6, "uncertain").otherwise("explanation").alias("response_type"),
        F.when((F.col("l_linestatus") == "O") & (line == 7), F.lit(None).cast("boolean"))
        .otherwise(F.col("l_discount") < 0.05).alias("is_correct"), (1 - F.col("l_discount")).alias("confidence"))
    return rounded(st.run_to_table(st.grading_statistics(rows), "complete", "grading"))


@R.add("m02_usage_windows", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, model_id, count(*) AS requests, round(sum(cost), 4) AS cost
FROM usage_log WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM usage_log) - INTERVAL 1 HOUR GROUP BY ALL""")
def _(spark, sf):
    out = st.run_to_table(st.usage_windows(_event_stream(spark, sf)), "append", "usage-windows")
    return rounded(out.withColumn("cost", F.round("cost", 4)))


@R.add("m03_request_rates", """
WITH w AS (SELECT model_id, make_timestamp((epoch_us(ts) // 600000000 - k) * 600000000) AS window_start
  FROM usage_log, range(0, 6) AS r(k))
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, model_id, count(*) AS requests FROM w
WHERE window_start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM usage_log) - INTERVAL 1 MINUTE
GROUP BY ALL HAVING count(*) >= 6""")
def _(spark, sf):
    rates = st.request_rates(_event_stream(spark, sf), 6, "60 minutes", "10 minutes")
    return rounded(st.run_to_table(rates, "append", "rates"))


@R.add("m04_session_activity", """
WITH gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh
  FROM usage_log WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS requests,
  count(*) FILTER (is_error) AS errors, round(sum(cost), 4) AS cost FROM numbered GROUP BY session_id, s
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM usage_log) - INTERVAL 1 HOUR""")
def _(spark, sf):
    out = st.run_to_table(st.session_activity(_event_stream(spark, sf)), "append", "sessions")
    return rounded(out.withColumn("cost", F.round("cost", 4)))


@R.add("m05_first_seen", "SELECT DISTINCT session_id, model_id FROM usage_log")
def _(spark, sf):
    rows = _event_stream(spark, sf).select("session_id", "model_id", "ts")
    # A horizon longer than the log makes "first within the horizon" the first of all.
    seen = st.first_seen(rows, ["session_id", "model_id"], horizon="90 days")
    return st.run_to_table(seen, "append", "first-seen").select("session_id", "model_id")


@R.add("m06_run_progress", """
SELECT session_id AS run_id, count(*) AS completed, count(*) FILTER (NOT is_error) AS successful,
  count(*) FILTER (is_error) AS failed FROM usage_log GROUP BY ALL""")
def _(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("session_id").alias("run_id"), "ts", (~F.col("is_error")).alias("is_correct"))
    return st.run_totals(st.run_to_table(st.run_progress(rows), "update", "progress", ["run_id", "period_start"])).drop("last_seen")


@R.add("m06b_stalled_runs", """
WITH gaps AS (SELECT session_id, ts, is_error, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) > INTERVAL 12 HOURS AS cut FROM usage_log),
marked AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY session_id ORDER BY ts) AS stretch FROM gaps),
sessions AS (SELECT session_id AS run_id, count(*) AS completed, count(*) FILTER (NOT is_error) AS successful, count(*) FILTER (is_error) AS failed,
  min(ts) AS started, max(ts) AS last_seen FROM marked GROUP BY session_id, stretch)
SELECT run_id, completed, successful, failed, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') AS last_seen
FROM sessions WHERE last_seen + INTERVAL 12 HOURS <= (SELECT max(ts) FROM usage_log) - INTERVAL 10 MINUTES""")
def _(spark, sf):
    rows = _event_stream(spark, sf).select(F.col("session_id").alias("run_id"), "ts", (~F.col("is_error")).alias("is_correct"))
    return rounded(st.run_to_table(st.stalled_runs(rows, "12 hours"), "append", "stalled"))


@R.add("m07_enrich_with_prices", """
SELECT event_id, round((input_tokens * coalesce(input_cost, 0) + output_tokens * coalesce(output_cost, 0)) / CAST(1000000 AS DOUBLE), 9) AS list_cost
FROM usage_log LEFT JOIN prices USING (model_id)""")
def _(spark, sf):
    priced = st.enrich_with_prices(_event_stream(spark, sf), cat.static_catalog(spark))
    return st.run_to_table(priced, "append", "priced").select("event_id", F.round("list_cost", 9).alias("list_cost"))
