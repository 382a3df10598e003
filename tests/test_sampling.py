import pytest
from pyspark.sql import functions as F

from quizspark.operators import sampling as s


@pytest.fixture(scope="module")
def population(spark):
    levels = F.element_at(F.array(*[F.lit(x) for x in ("Easy", "Medium", "Hard")]), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(100).select(
        F.col("id").cast("string").alias("question_id"), F.concat(F.lit("C"), (F.col("id") % 5).cast("string")).alias("category"),
        levels.alias("difficulty_level"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("air_date"))


def test_sizes(spark):
    assert s.sample_size(0.95, 0.05) == 385 and s.sample_size(0.95, 0.5) == 30
    got = spark.createDataFrame([(n,) for n in (20, 100, 1000, 99999, 100000)], "n bigint").select(s.sample_size_fpc(F.col("n"))).collect()
    assert [r[0] for r in got] == [20, 80, 278, 383, 383]


def test_same_seed_same_rows(population):
    a = {r[0] for r in s.random_sample(population, 30, 1).select("question_id").collect()}
    assert a == {r[0] for r in s.random_sample(population.repartition(9), 30, 1).select("question_id").collect()} and len(a) == 30
    assert a != {r[0] for r in s.random_sample(population, 30, 2).select("question_id").collect()}
    assert s.random_sample(population, 500).count() == 100


def test_empty_raises(population):
    with pytest.raises(s.SamplingError):
        s.stratified_sample(population.where("false"))


def test_stratified_bounds_and_min_one(population):
    got = s.stratified_sample(population, 30)
    assert 30 <= got.count() <= 35 and got.select("category").distinct().count() == 5
    assert s.stratified_sample(population, 3, ["category", "difficulty_level"]).count() == 15
    assert s.stratified_sample(population, 3, ["category", "difficulty_level"], exact=True).count() == 15


def test_exact_removes_surplus(spark):
    df = spark.range(1000).select(F.col("id").alias("question_id"), F.when(F.col("id") < 700, "big").when(F.col("id") < 703, None)
                                  .otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("category"))
    loose, exact = (s.allocation(df, ["category"], 12, e) for e in (False, True))
    assert loose.agg(F.sum("n_take")).first()[0] == 19
    assert exact.agg(F.sum("n_take")).first()[0] == 17 and exact.where("category IS NULL").count() == 0


def test_rank_bins_match_equal_width_cut(spark):
    for n in (2, 5, 6, 11, 97):
        df = spark.range(n).select(F.col("id").alias("question_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("air_date"))
        got = [r["time_period"] for r in s.time_bins(df, "air_date").orderBy("air_date").collect()]
        edges = [(n - 1) * k / 5 for k in range(1, 6)]
        assert got == [next(b for b, e in enumerate(edges) if i <= e + 1e-9) for i in range(n)]


def test_bins_follow_the_time_of_day(spark):
    df = spark.range(100).select(F.col("id").alias("question_id"), F.timestamp_seconds(F.col("id") * 60).alias("air_date"))
    got = [r["time_period"] for r in s.time_bins(df, "air_date").orderBy("air_date").collect()]
    assert got == sorted(got) and [got.count(b) for b in range(5)] == [20] * 5


def test_without_any_date_the_sample_is_stratified(population):
    none = population.withColumn("air_date", F.lit(None).cast("date"))
    a, b = (sorted(r[0] for r in x.select("question_id").collect()) for x in (s.temporal_sample(none, 20), s.stratified_sample(none, 20)))
    assert a == b and len(a) >= 20


def test_no_shuffle_of_the_rows(spark):
    """Only the rows of the last cell of each group are shuffled."""
    df = spark.range(50_000).select(F.col("id").alias("question_id"), (F.col("id") % 3).alias("g"), F.lit("x" * 50).alias("payload"))
    chosen = s.stratified_sample(df, 700, ["g"])
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and chosen.count() == 700


def test_hot_day_is_split_between_bins(spark):
    df = spark.range(1000).select(F.col("id").alias("question_id"), F.when(F.col("id") < 900, "2020-01-05").otherwise("2020-01-09").cast("date").alias("air_date"))
    counts = {r["time_period"]: r["count"] for r in s.time_bins(df, "air_date").groupBy("time_period").count().collect()}
    assert counts == {0: 200, 1: 200, 2: 200, 3: 200, 4: 200}


def test_balanced_and_missing_level(population):
    got = s.balanced_sample(population.where("difficulty_level <> 'Hard'"), 20).groupBy("difficulty_level").count().collect()
    assert {r[0]: r[1] for r in got} == {"Easy": 8, "Medium": 8}


def test_systematic(spark):
    df = spark.range(103).select((F.col("id") * 3).alias("question_id"))
    got = sorted(r[0] for r in s.systematic_sample(df, 10, 42).collect())
    assert got == [(2 + 10 * i) * 3 for i in range(10)]


def test_outcomes(spark):
    df = spark.range(50).select(F.col("id").alias("result_id"), F.when(F.col("id") < 47, True).when(F.col("id") == 47, None).otherwise(False).alias("is_correct"))
    got = s.outcome_sample(df, 10).collect()
    assert len(got) == 10 and sum(1 for r in got if r["is_correct"]) == 7
    assert s.outcome_sample(df, 10, correct=2).count() == 5


def test_representativeness(population):
    row = {r["column_name"]: r for r in s.representativeness(population, population).collect()}
    assert set(row) == {"category", "difficulty_level"} and row["category"]["max_difference"] == 0 and row["category"]["sampling_ratio"] == 1
