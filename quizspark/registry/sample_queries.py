"""Sampling (K). Every sampler has an SQL counterpart because the order is md5(seed | id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quizspark import fixed_values as fv, views as v
from quizspark.operators import sampling as s
from quizspark.registry.base import Registry, rounded

R = Registry()


def order(seed: int, col: str = "question_id") -> str:
    return f"md5('{seed}|' || CAST({col} AS VARCHAR)), {col}"


def allocation_sql(source: str, strata: str, n: str) -> str:
    """CTEs counts, base, alloc for proportional allocation (strata without NULL)."""
    return f"""counts AS (SELECT {strata}, count(*) AS cnt FROM {source} GROUP BY ALL),
base AS (SELECT *, least(greatest(1, floor({n} * (cnt / (SELECT CAST(sum(cnt) AS DOUBLE) FROM counts)))), cnt) AS a FROM counts),
numbered AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, {strata}) AS rn, {n} - (SELECT sum(a) FROM base) AS gap FROM base),
alloc AS (SELECT *, CAST(a + CASE WHEN gap > 0 AND rn <= gap AND a < cnt THEN 1 ELSE 0 END AS BIGINT) AS take FROM numbered),
exact_alloc AS (SELECT *, CAST(a + CASE WHEN gap > 0 AND rn <= gap AND a < cnt THEN 1 WHEN gap < 0 AND rn <= -gap AND a > 1 THEN -1 ELSE 0 END AS BIGINT)
  AS take FROM numbered)"""


def stratified_sql(source: str, strata: str, n: str, seed: int, alloc: str = "alloc", id_col: str = "question_id",
                   cols: str = "question_id") -> str:
    return f"""{allocation_sql(source, strata, n)},
picked AS (SELECT s.*, take, row_number() OVER (PARTITION BY {strata} ORDER BY {order(seed, id_col)}) AS pos
  FROM {source} s JOIN {alloc} USING ({strata}))
SELECT {cols} FROM picked WHERE pos <= take"""


FPC = """least(greatest(ceil(b / (1 + (b - 1) / n)), 30), n)"""


@R.add("k01_sample_size", f"""
SELECT category, n AS population, CAST(ceil(1.96 * 1.96 * 0.25 / 0.0025) AS BIGINT) AS needed, n >= ceil(1.96 * 1.96 * 0.25 / 0.0025) AS enough FROM (
  SELECT category, count(*) AS n FROM graded GROUP BY ALL)""")
def _(spark, sf):
    need = F.lit(s.sample_size())
    return rounded(v.graded(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("population")).select(
        "category", "population", need.alias("needed"), (F.col("population") >= need).alias("enough")))


@R.add("k02_sample_size_fpc", f"""
SELECT category, n AS population, CAST({FPC} AS BIGINT) AS needed FROM (
  SELECT category, count(*) AS n, CAST(3.8416 * 0.25 / 0.0025 AS DOUBLE) AS b FROM graded GROUP BY ALL)""")
def _(spark, sf):
    return rounded(v.graded(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("population")).select(
        "category", "population", s.sample_size_fpc(F.col("population")).alias("needed")))


@R.add("k03_random_sample", f"SELECT result_id, run_id FROM results ORDER BY {order(42, 'result_id')} LIMIT 700")
def _(spark, sf):
    return s.random_sample(v.results(spark, sf).select("result_id", "run_id"), 700, 42, "result_id")


@R.add("k04_stratified_sample", "WITH " + stratified_sql(
    "runs", "benchmark_mode, status", "500", 42, id_col="run_id", cols="run_id, benchmark_mode, status"))
def _(spark, sf):
    runs = v.runs(spark, sf).select("run_id", "benchmark_mode", "status")
    return s.stratified_sample(runs, 500, ["benchmark_mode", "status"], 42, "run_id")


@R.add("k04b_allocation", f"WITH {allocation_sql('questions', 'category, difficulty_level', '120')} "
       "SELECT category, difficulty_level, cnt AS n_rows, take AS n_take FROM alloc")
def _(spark, sf):
    return s.allocation(v.questions(spark, sf), ["category", "difficulty_level"], 120)


@R.add("k05_exact_stratified_sample", "WITH " + stratified_sql(
    "questions", "category, difficulty_level", "60", 7, "exact_alloc", cols="question_id, category, difficulty_level"))
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "category", "difficulty_level")
    return s.stratified_sample(q, 60, ["category", "difficulty_level"], 7, exact=True)


@R.add("k04c_many_categories", "WITH " + stratified_sql("topics", "category", "300", 42).replace(
    "counts AS", "topics AS (SELECT question_id, topic AS category FROM questions), counts AS", 1))
def _(spark, sf):
    """More than fifty categories under the default strata."""
    q = v.questions(spark, sf).select("question_id", F.col("topic").alias("category"))
    return s.stratified_sample(q, 300).select("question_id")


@R.add("k05b_three_strata", "WITH " + stratified_sql(
    "questions", "category, difficulty_level, round", "400", 7, "exact_alloc", cols="question_id, category, difficulty_level, round"))
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "category", "difficulty_level", "round")
    return s.stratified_sample(q, 400, ["category", "difficulty_level", "round"], 7, exact=True)


@R.add("k05c_many_strata", "WITH " + stratified_sql("customers", "o_custkey", "3000", 7, "exact_alloc", "o_orderkey", "o_orderkey, o_custkey").replace(
    "counts AS", "customers AS (SELECT o_orderkey, o_custkey FROM orders), counts AS", 1))
def _(spark, sf):
    """A stratum per customer."""
    rows = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return s.stratified_sample(rows, 3000, ["o_custkey"], 7, "o_orderkey", exact=True)


@R.add("k06c_time_of_day_bins", """SELECT event_id, CAST(greatest(0, ceil((rn - 1) * 7 / greatest(n - 1, 1)) - 1) AS BIGINT) AS time_period FROM (
  SELECT event_id, count(*) OVER () AS n, row_number() OVER (ORDER BY ts, md5('42|' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM events)""")
def _(spark, sf):
    """Bins whose bounds fall inside days."""
    rows = v.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rounded(s.time_bins(rows, "ts", 7, 42, "event_id").select("event_id", "time_period"))


BINNED = """binned AS (SELECT *, CAST(greatest(0, ceil((rn - 1) * 5 / greatest(n - 1, 1)) - 1) AS INT) AS time_period FROM (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY created_at, md5('42|' || CAST(run_id AS VARCHAR)), run_id) AS rn FROM runs))"""


@R.add("k06_time_bins", f"WITH {BINNED} SELECT run_id, CAST(time_period AS BIGINT) AS time_period FROM binned")
def _(spark, sf):
    runs = v.runs(spark, sf).select("run_id", "created_at")
    return rounded(s.time_bins(runs, "created_at", 5, 42, "run_id").select("run_id", "time_period"))


@R.add("k06b_temporal_sample", f"WITH {BINNED}, levels AS (SELECT *, status AS difficulty_level FROM binned), " + stratified_sql(
    "levels", "time_period, difficulty_level", "400", 42, id_col="run_id", cols="run_id, difficulty_level"))
def _(spark, sf):
    runs = v.runs(spark, sf).select("run_id", "created_at", F.col("status").alias("difficulty_level"))
    return s.temporal_sample(runs, 400, "created_at", 5, 42, "run_id").select("run_id", "difficulty_level")


@R.add("k07_balanced_sample", f"""
SELECT question_id, difficulty_level FROM questions
QUALIFY row_number() OVER (PARTITION BY difficulty_level ORDER BY {order(3)}) <= CASE difficulty_level WHEN 'Hard' THEN 60 ELSE 120 END""")
def _(spark, sf):
    return s.balanced_sample(v.questions(spark, sf).select("question_id", "difficulty_level"), 300, seed=3)


@R.add("k08_systematic_sample", """
WITH numbered AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS i, (SELECT count(*) FROM runs) // 200 AS step FROM runs)
SELECT run_id FROM numbered WHERE i % step = 42 % step AND i < 42 % step + step * 200""")
def _(spark, sf):
    return s.systematic_sample(v.runs(spark, sf).select("run_id"), 200, 42, "run_id")


@R.add("k09_outcome_sample", f"""
WITH rows AS (SELECT result_id, coalesce(is_correct, FALSE) AS ok FROM results),
have AS (SELECT count(*) FILTER (ok) AS c, count(*) FILTER (NOT ok) AS i FROM rows),
quota AS (SELECT least(50, c) AS c1, least(101 - least(50, c), i) AS i1, c FROM have)
SELECT result_id, ok FROM rows QUALIFY row_number() OVER (PARTITION BY ok ORDER BY {order(42, 'result_id')})
  <= CASE WHEN ok THEN (SELECT CASE WHEN i1 < 50 AND c > c1 THEN least(101 - i1, c) ELSE c1 END FROM quota) ELSE (SELECT i1 FROM quota) END""")
def _(spark, sf):
    rows = s.outcome_sample(v.results(spark, sf).select("result_id", "is_correct"), 101)
    return rows.select("result_id", F.coalesce("is_correct", F.lit(False)).alias("ok"))


@R.add("k10_preset_sample", " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, question_id FROM (WITH {stratified_sql('questions', 'category, difficulty_level', str(n), 42)})"
    for mode, n in fv.MODE_PRESETS.items()))
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "category", "difficulty_level")
    return reduce(DataFrame.unionByName, [s.preset_sample(q, mode).select(F.lit(mode).alias("mode"), "question_id")
                                          for mode in fv.MODE_PRESETS])


@R.add("k11_draw_by_method", f"""
SELECT 'random' AS method, question_id FROM (SELECT question_id FROM questions ORDER BY {order(5)} LIMIT 80)
UNION ALL SELECT 'balanced', question_id FROM (SELECT question_id FROM questions
  QUALIFY row_number() OVER (PARTITION BY difficulty_level ORDER BY {order(5)}) <= CASE difficulty_level WHEN 'Hard' THEN 16 ELSE 32 END)
UNION ALL SELECT 'stratified', question_id FROM (WITH {stratified_sql('questions', 'topic', '80', 5)})""")
def _(spark, sf):
    q = v.questions(spark, sf).select("question_id", "difficulty_level", "topic")
    parts = [s.draw(q, m, 80, 5, strata=["topic"]).select(F.lit(m).alias("method"), "question_id")
             for m in ("random", "balanced", "stratified")]
    return reduce(DataFrame.unionByName, parts)
