import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quizspark.operators import metrics as m, retention as rt, validate as val
from quizspark.operators.filters import get_questions
from quizspark.plans import quantiles as q
from quizspark.plans.ranking import rows_at_ranks, seeded_key, smallest_by_hash, with_position
from quizspark.plans.storage import written


def test_order_statistics_match_sorting_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([rng.gauss(5, 2), 1e9 * rng.random(), 3.0])) for _ in range(3000)]
    rows += [(f"g{i % 40}", float(rng.randint(0, 5))) for i in range(800)] + [("one", 7.5), ("nul", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    n = F.col("n")
    got = {r["k"]: r for r in q.order_statistics(df, ["k"], "v", {
        "p95": q.floor_index_rank(0.95, n), "lo": q.lower_median_rank(n), "up": q.upper_median_rank(n)}).collect()}
    assert "nul" not in got
    for k in {r[0] for r in rows} - {"nul"}:
        s = sorted(v for key, v in rows if key == k)
        assert got[k]["p95"] == s[min(int(0.95 * len(s)), len(s) - 1)]
        assert got[k]["up"] == s[len(s) // 2] and got[k]["lo"] == s[(len(s) - 1) // 2]


def test_order_statistics_in_two_scans_against_sorting(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), rng.choice([rng.gauss(0, 1), 0.5, rng.expovariate(1) * 1e6])) for _ in range(60_000)]
    df = written(spark.createDataFrame(rows, "k string, v double").repartition(5), "values")
    n = F.col("n")
    ranks = {"p1": q.floor_index_rank(0.01, n), "lo": q.lower_median_rank(n), "p95": q.floor_index_rank(0.95, n), "first": F.lit(1), "last": n}
    out = q.order_statistics(df, ["k"], "v", ranks)
    got = {r["k"]: r for r in out.collect()}
    for k in ("a", None):
        s = sorted(v for key, v in rows if key == k)
        assert [got[k][x] for x in ranks] == [s[int(0.01 * len(s))], s[(len(s) - 1) // 2], s[int(0.95 * len(s))], s[0], s[-1]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    assert final.count("Scan parquet") == 2 and "SortMergeJoin" not in final


def test_percentile_edges(spark):
    for n in (1, 19, 20, 21, 100):
        rows = [(1, "m", i) for i in range(n)]
        df = spark.createDataFrame(rows, "run_id int, model_name string, latency_ms int")
        row = m.latency_percentiles(df).first()
        assert row["p95_s"] == min(int(0.95 * n), n - 1) / 1000 and row["median_s"] == (n - 1) / 2000


def test_position_numeric_and_text(spark):
    ids = random.Random(1).sample(range(10 ** 9), 2000)
    got = with_position(spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5), "id").collect()
    rank = {v: i + 1 for i, v in enumerate(sorted(ids))}
    assert {r["id"]: r["position"] for r in got} == rank
    words = [f"w{i}" for i in ids]
    got = with_position(spark.createDataFrame([(w,) for w in words], "id string"), "id").collect()
    assert {r["id"]: r["position"] for r in got} == {v: i + 1 for i, v in enumerate(sorted(words))}


def test_smallest_by_hash_takes_exact_counts(spark):
    df = spark.range(20000).withColumn("g", F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, None).otherwise("cold"))
    quota = spark.createDataFrame([("hot", 7000), ("cold", 3), (None, 5), ("none", 4)], "g string, n_take bigint")
    got = smallest_by_hash(df, ["g"], seeded_key(1, "id"), "id", quota)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 7000, "cold": 3, None: 5}
    want = df.where("g = 'cold'").orderBy(seeded_key(1, "id"), "id").limit(3)
    assert {r["id"] for r in got.where("g = 'cold'").collect()} == {r["id"] for r in want.collect()}


def test_duplicates_with_hot_text(spark):
    rows = [(i, "same text" if i % 3 else f"text {i % 50}") for i in range(3000)] + [(9001, ""), (9002, None)]
    df = spark.createDataFrame(rows, "question_id int, question string")
    got = {r["question_id"]: r["is_duplicate"] for r in val.flag_duplicates(df).collect()}
    seen, want = set(), {}
    for i, text in rows:
        want[i] = bool(text) and text in seen
        seen.add(text)
    assert got == want


def test_duplicate_flags_of_unique_texts_shuffle_no_rows(spark):
    rows = [(None, "same"), (4, "same"), (2, "same"), (7, "own"), (None, "alone"), (3, " ")]
    got = {(r[0], r[1]): (r["first_id"], r["is_duplicate"]) for r in val.flag_duplicates(spark.createDataFrame(rows, "question_id int, question string")).collect()}
    assert got == {(None, "same"): (2, False), (4, "same"): (2, True), (2, "same"): (2, False), (7, "own"): (7, False),
                   (None, "alone"): (None, False), (3, " "): (3, False)}
    unique = val.flag_duplicates(written(spark.range(5000).select(F.col("id").alias("question_id"), F.col("id").cast("string").alias("question")), "u"))
    assert unique.where("is_duplicate").count() == 0
    unique.collect()
    assert "hashpartitioning" not in unique._jdf.queryExecution().executedPlan().toString()


def test_deep_page_by_position(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("question_id"))
    for limit, offset in ((10, 2500), (500, 2900), (5, 0), (3000, 1)):
        for gathered in (100, 10_000):
            got = [r[0] for r in get_questions(df, limit=limit, offset=offset, gathered=gathered).collect()]
            assert sorted(got) == list(range(3000))[offset:offset + limit]


def test_rate_audit_against_brute_force(spark):
    rng = random.Random(3)
    at = sorted(rng.sample(range(0, 4 * 3600 * 1000), 900))
    rows = [(i, "hot" if i % 3 else "m", t / 1000) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "event_id int, model_id string, s double").withColumn(
        "ts", F.timestamp_millis(F.round(F.col("s") * 1000).cast("bigint")))
    got = {r["event_id"]: r for r in rt.rate_audit(df, 3, chunk_seconds=600).collect()}
    assert len(got) == len(rows)
    for i, k, t in rows:
        recent = [u for _, k2, u in rows if k2 == k and t - 60 < u < t]
        assert got[i]["recent_requests"] == len(recent)
        wait = 60 - (t - min(recent)) if len(recent) >= 3 else 0
        assert abs(got[i]["wait_seconds"] - wait) < 1e-5


def test_keep_last_and_expire(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01", "completed"), (2, "a", "2024-02-01", "running"), (3, "a", "2024-02-01", "failed"),
                                (4, "b", "2023-01-01", "running")], "run_id int, k string, d string, status string").withColumn(
        "created_at", F.col("d").cast("timestamp"))
    assert sorted(r["run_id"] for r in rt.keep_last(df, "k", 2).collect()) == [2, 3, 4]
    assert {r["k"]: r["run_id"] for r in rt.latest_per_key(df, "k").collect()} == {"a": 3, "b": 4}
    kept, gone = rt.expire(df, "2024-03-01", 30, states=["completed", "failed"])
    assert sorted(r["run_id"] for r in gone.collect()) == [1] and kept.count() == 3


def test_rate_window_longer_than_a_chunk(spark):
    rows = [(i, "m", i * 1000) for i in range(10)]
    log = spark.createDataFrame(rows, "event_id int, model_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = rt.rate_audit(log, 3, window_seconds=9000, chunk_seconds=3600).orderBy("event_id").collect()
    assert [r["recent_requests"] for r in got] == [min(i, 8) for i in range(10)]


def test_offset_without_limit(spark):
    from quizspark.operators.filters import get_questions
    df = spark.range(500).select(F.col("id").alias("question_id"))
    assert sorted(r[0] for r in get_questions(df, offset=123).collect()) == list(range(123, 500))


def test_radix_selection_in_several_rounds(spark):
    """Small cells force several rounds; the rows are those of the whole order."""
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(3000)], "id int, g int").repartition(4)
    quota = spark.createDataFrame([(None, 100), (0, 1), (1, 5000), (2, 0)], "g int, n_take int")
    got = smallest_by_hash(df, ["g"], seeded_key(1, "id"), "id", quota, rows_per_cell=2)
    order = sorted((hashlib.md5(f"1|{i}".encode()).hexdigest(), i, None if i % 5 == 0 else i % 3) for i in range(3000))
    for g, n in ((None, 100), (0, 1), (1, 5000), (2, 0)):
        assert sorted(r["id"] for r in got.collect() if r["g"] == g) == sorted([i for _, i, x in order if x == g][:n])
    one = spark.range(1).selectExpr("77L AS n_take")
    assert sorted(r["id"] for r in smallest_by_hash(df, [], seeded_key(1, "id"), "id", one, rows_per_cell=1).collect()) == sorted(i for _, i, _ in order[:77])
    assert smallest_by_hash(df.limit(0), [], seeded_key(1, "id"), "id", one).collect() == []
    alike = spark.createDataFrame([(7, i) for i in range(50)], "id int, x int")
    assert len(smallest_by_hash(alike, [], seeded_key(1, "id"), "x", one.selectExpr("20L AS n_take"), rows_per_cell=3).collect()) == 20


def test_radix_selection_leaves_the_table_where_it_is(spark):
    df = spark.range(100_000).repartition(4).selectExpr("id", "id % 7 AS g")
    path = written(df, "radix-test")
    got = smallest_by_hash(path, [], seeded_key(1, "id"), "id", spark.range(1).selectExpr("1000L AS n_take"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.count("Relation") == 2 and "substring(md5" in plan
    assert got.count() == 1000


@pytest.mark.parametrize("n,step,rows_per_cell", [(10, 7, 3), (50, 40, 2), (1, 5000, 1), (300, 1, 4)])
def test_rows_at_ranks(spark, n, step, rows_per_cell):
    rng = random.Random(2)
    ids = [rng.choice([rng.randint(-50, 50), rng.randint(0, 10**12), 5]) for _ in range(5000)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    start = 3 % step
    got = rows_at_ranks(df, "id", start, step, n, min(ids), max(ids), rows_per_cell)
    want = [x for k, x in enumerate(sorted(ids)) if k % step == start and k < start + step * n]
    assert sorted(r[0] for r in got.collect()) == want
