import pytest
from pyspark.sql import functions as F

from quizspark.operators import catalog as cat, costs as co, joins as j, leaderboard as lb, metrics as m, runs as r

SCHEMA = ("run_id int, model_name string, question_id int, category string, difficulty_level string, value int, is_correct boolean, "
          "confidence double, latency_ms int, cost_usd decimal(10,6), tokens_used bigint, tokens_input bigint, tokens_output bigint")


def frame(spark, outcomes, value=400, confidence=lambda i: 0.5 + i / 1000):
    from decimal import Decimal
    rows = [(1, "m", i, f"c{i % 2}", "Easy", value, ok, confidence(i), 100, Decimal("0.001"), 10, 6, 4) for i, ok in enumerate(outcomes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_one_correct_row(spark):
    row = m.comprehensive_metrics(frame(spark, [True])).first()
    assert row["accuracy"] == 1.0 and row["mean_s"] == 0.1 and row["total_cost"] == 0.001 and row["total_score"] == 400
    assert row["confidence_correlation"] == 0 and row["std_s"] == 0 and row["ci_low"] is None


def test_all_unanswered_and_none_correct(spark):
    row = m.comprehensive_metrics(frame(spark, [None, None])).first()
    assert (row["accuracy"], row["total_count"], row["unanswered_count"], row["total_score"]) == (0.0, 2, 2, 0)
    row = m.comprehensive_metrics(frame(spark, [False, False, None])).first()
    assert row["cost_per_correct"] is None and row["cost_efficiency"] == 0 and row["total_score"] == -800


def test_interval_needs_more_than_thirty(spark):
    short = m.confidence_interval(m.accuracy(frame(spark, [True, False] * 15))).first()
    long = m.confidence_interval(m.accuracy(frame(spark, [True, False] * 15 + [None]))).first()
    assert short["ci_low"] is None and abs(long["ci_low"] - (0.5 - 1.96 * (0.25 / 31) ** 0.5)) < 1e-12


def test_constant_confidence_has_no_correlation(spark):
    row = m.confidence_correlation(frame(spark, [True, False, True], confidence=lambda i: 0.7)).first()
    assert row["confidence_correlation"] == 0


def test_score_distribution(spark):
    got = {x["score_label"]: x["n"] for x in m.score_distribution(frame(spark, [True, False, None, True])).collect()}
    assert got == {"+$400": 2, "-$400": 1, "Unanswered": 1}
    assert m.score_distribution(frame(spark, [True], value=0)).first()["score_label"] == "$0"


def test_breakdown_scores_add_up(spark):
    rows = frame(spark, [True, False, None, True, True])
    total = m.signed_scores(rows).first()["total_score"]
    for d in m.BREAKDOWNS:
        assert m.breakdowns(rows).where(F.col("dimension") == d).agg(F.sum("score")).first()[0] == total


def test_price_fallback_chain(spark):
    usage = spark.createDataFrame([(i, x) for i, x in enumerate(
        ["dyn/one", "openai/gpt-4", "anthropic/claude-sonnet", "unknown/x", "openai/gpt-5"])], "id int, model_id string")
    dynamic = spark.createDataFrame([("dyn/one", 0.000001, 2.0)], "model_id string, input_cost double, output_cost double")
    got = {x["model_id"]: x for x in j.price_usage(usage, dynamic, cat.static_catalog(spark)).collect()}
    assert got["dyn/one"]["price_source"] == "dynamic" and abs(got["dyn/one"]["input_price"] - 1) < 1e-9
    assert got["openai/gpt-4"]["input_price"] == 30.0 and got["openai/gpt-4"]["price_source"] == "static"
    assert got["anthropic/claude-sonnet"]["output_price"] == 15.0 and got["anthropic/claude-sonnet"]["price_source"] == "alternative"
    assert got["unknown/x"]["price_source"] == "none" and got["openai/gpt-5"]["input_price"] == 0.0


@pytest.mark.parametrize("tier,factor", [("free", 0), ("basic", 1), ("premium", 0.8), ("enterprise", 0.6)])
def test_token_cost_tiers(spark, tier, factor):
    row = spark.range(1).select(j.token_cost(F.lit(1000), F.lit(500), F.lit(0.5), F.lit(1.5), tier)).first()
    assert abs(row[0] - 0.00125 * factor) < 1e-12


def test_usage_reports(spark):
    u = spark.createDataFrame([("2024-01-15 10:00:00", "a", 1000, 500, 0.2, "s1"), ("2024-01-15 11:00:00", "b", 10, 5, 0.3, "s1"),
                               ("2024-01-16 10:00:00", "a", 1, 1, 0.1, "s2")],
                              "t string, model_id string, input_tokens int, output_tokens int, cost double, session_id string").withColumn(
        "ts", F.col("t").cast("timestamp"))
    row = co.usage_summary(u).first()
    assert abs(row["total_cost"] - 0.6) < 1e-9 and row["total_requests"] == 3 and set(row["cost_by_model"]) == {"a", "b"}
    assert co.usage_summary(u.where("false")).first()["total_requests"] == 0
    assert [x["num_models"] for x in co.daily_costs(u).collect()] == [2, 1]
    assert co.daily_costs(u, "2024-01-16 12:00:00", 1).count() == 1


def test_trends_and_ties(spark):
    perf = spark.createDataFrame([(1, "up", 0.5, 5, None, 10), (2, "up", 0.6, 5, 0.0, 10), (3, "down", 0.6, 9, 1.0, 10), (4, "down", 0.5, 9, 2.0, 10),
                                  (5, "same", 0.5, 1, 1.0, 10), (6, "same", 0.5, 1, 1.0, 10), (7, "single", 0.9, 2, 1.0, 10), (8, "gone", None, 3, 1.0, 10)],
                                 "run_id int, model_name string, accuracy_rate double, signed_score int, total_cost_usd double, correct_answers int")
    perf = perf.withColumn("avg_response_time_ms", F.lit(None).cast("double")).withColumn("total_questions", F.lit(20))
    runs = spark.createDataFrame([(i, "completed" if i != 6 else "completed", f"2024-01-0{i}") for i in range(1, 9)],
                                 "run_id int, status string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    got = {x["model_name"]: x["trend"] for x in lb.trends(perf, runs).collect()}
    assert got == {"up": "up", "down": "down", "same": "stable", "single": "stable"}
    web = {x["name"]: x for x in lb.web_leaderboard(perf, runs).collect()}
    assert web["single"]["rank"] == 1 and web["up"]["efficiency"] == 60 and web["up"]["avg_time"] == 1.0 and web["up"]["score"] == 600
    unique = lb.score_leaderboard(perf, runs, unique=True).collect()
    assert len(unique) == 5 and unique[0]["model_name"] == "down" and unique[0]["run_id"] == 4


def test_progress(spark):
    df = spark.createDataFrame([(10, 4, 2, 1, 8.0), (0, 0, 0, 0, 0.0)],
                               "total_questions int, completed_questions int, successful int, failed int, elapsed_seconds double")
    a, b = r.run_progress(df).collect()
    assert (a["completion_pct"], round(a["success_rate"], 4), a["answer_rate"], a["remaining_seconds"]) == (40.0, 66.6667, 75.0, 12.0)
    assert (b["completion_pct"], b["success_rate"], b["remaining_seconds"]) == (0.0, 0.0, None)


def test_deviations_of_large_close_values(spark):
    """Values whose squares leave no digit for what lies between them, over several fine groups."""
    rows = [(1, "m", c, lvl, 100, True, 0.5 + 1e-9 * i, 1e9 + 100 * i, i % 2 == 0) for i, (c, lvl) in enumerate([("a", "Easy"), ("b", "Hard"), ("a", "Hard"), ("b", "Easy")])]
    df = spark.createDataFrame(rows, "run_id int, model_name string, category string, difficulty_level string, value int, x boolean, confidence double, "
                               "latency_ms double, is_correct boolean").drop("x").withColumns(
        {c: F.lit(0).cast("bigint") for c in ("tokens_used", "tokens_input", "tokens_output")}).withColumn("cost_usd", F.lit(0).cast("decimal(10,6)"))
    got = m.comprehensive_metrics(df, ["run_id", "model_name"]).first()
    assert abs(got["std_s"] - 0.1290994) < 1e-6
    want = df.agg(F.stddev("confidence"), F.corr("confidence", F.col("is_correct").cast("int"))).first()
    assert abs(got["performance_variance"] - want[0]) < 1e-12 and abs(got["confidence_correlation"] - want[1]) < 1e-4


def test_prices_from_a_whole_catalog(spark):
    usage = spark.createDataFrame([("a",), ("a",), (None,), ("nobody",)], "model_id string")
    catalog = spark.createDataFrame([("a", 5.0, 6.0), ("a", 3.0, 4.0), (None, 1.0, 1.0), ("b", 9.0, 9.0)], "model_id string, input_cost double, output_cost double")
    got = sorted((str(r["model_id"]), r["price_source"], r["input_price"]) for r in j.price_usage(usage, catalog, cat.static_catalog(spark)).collect())
    assert [g[:2] for g in got] == [("None", "none"), ("a", "dynamic"), ("a", "dynamic"), ("nobody", "none")] and got[1][2] == got[2][2] > 0


def test_rows_are_read_once(spark):
    """The rows may be a join; what follows reads the written columns and never the join again."""
    from quizspark.operators import metrics
    rows = spark.createDataFrame([(1, "m", 1, True, 0.5, 100, 0.1, 10, 4, 6), (1, "m", 2, None, 0.7, 300, 0.2, 20, 8, 12)],
                                 "run_id int, model_name string, question_id int, is_correct boolean, confidence double, latency_ms int, cost_usd double, tokens_used int, "
                                 "tokens_input int, tokens_output int")
    asked = spark.createDataFrame([(1, "a", "Easy", 100), (2, "b", "Hard", 200)], "question_id int, category string, difficulty_level string, value int")
    out = metrics.comprehensive_metrics(rows.join(asked, "question_id"))
    assert "question_id" not in out._jdf.queryExecution().analyzed().toString()
    got = out.first()
    assert (got["total_count"], got["category_count"], got["median_s"], got["p95_s"]) == (2, 2, 0.2, 0.3)
