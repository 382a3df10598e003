import datetime as dt

import pytest
from pyspark.sql import functions as F

from quizspark.functions import labels
from quizspark.operators import clean as c, filters as f


def test_clean_text_strips_then_decodes_once(values):
    assert values(["This   has    extra   spaces", "<b>x</b> &quot;q&quot; and &amp; s", "Another &lt;test&gt;", "&amp;lt;",
                   "  a b \x1f", None], c.clean_text) == [
        "This has extra spaces", 'x "q" and & s', "Another <test>", "<", "a b", None]


def test_parse_value(values):
    assert values(["$200", "400", "$1,000", None, "", "NULL", "invalid", "400.0", " 7 ", "-5"], c.parse_value) == [
        200, 400, 1000, None, None, None, None, None, 7, -5]


def test_parse_date(values):
    d = dt.date
    assert values(["2020-01-01", "01/15/2020", "January 20, 2020", "invalid-date", None, "03/04/2020", "13/02/2020",
                   "2020-01-02 03:04:05"], c.parse_date) == [
        d(2020, 1, 1), d(2020, 1, 15), d(2020, 1, 20), None, None, d(2020, 3, 4), d(2020, 2, 13), d(2020, 1, 2)]


def test_difficulty_and_buckets(spark):
    rows = spark.createDataFrame([(v,) for v in (200, 600, 601, 1200, 1201, None)], "v int")
    assert [r[0] for r in rows.select(labels.difficulty_level(F.col("v"))).collect()] == [
        "Easy", "Easy", "Medium", "Medium", "Hard", "Unknown"]
    rows = spark.createDataFrame([(v,) for v in (0, 399, 400, 799, 800)], "v int")
    assert [r[0][:3] for r in rows.select(labels.value_bucket(F.col("v"))).collect()] == ["Low", "Low", "Med", "Med", "Hig"]


def test_preprocess_pipeline(spark):
    raw = spark.createDataFrame([
        ("This is a <b>clue</b> with tags", "What is a tag?", "SCIENCE", "$200", "2020-01-01", 1),
        ("  spaced    out   clue  ", "X", " art ", "bad", "nope", 2),
        ("", "X", "A", "$1", None, 3), ("short", "X", "A", "$1", None, 4), ("exactly 10", "X", "A", "$1,600", None, 5),
        ("a fine long clue", None, "A", "$1", None, 6)],
        "Clue string, Response string, ` Subject` string, Worth string, Date string, Episode int")
    rows = c.preprocess(raw).orderBy("show_number").collect()
    assert [r["show_number"] for r in rows] == [1, 2, 5]
    assert rows[0]["question"] == "This is a clue with tags" and rows[0]["difficulty_level"] == "Easy"
    assert rows[1]["value"] is None and rows[1]["difficulty_level"] == "Unknown" and rows[1]["category"] == "art"
    assert rows[2]["difficulty_level"] == "Hard" and rows[2]["question_length"] == 10
    assert len({r["id"] for r in rows}) == 3


def test_standardize_first_column_wins(spark):
    df = spark.createDataFrame([("a", "b")], "clue string, prompt string")
    assert c.standardize_columns(df).columns == ["question", "prompt"]


def test_flatten_nested(spark):
    df = spark.createDataFrame([(1, ((2, ["a", None]),))], "id int, p struct<q struct<r int, s array<string>>>")
    assert c.flatten(df).first().asDict() == {"id": 1, "p_q_r": 2, "p_q_s": "a, None"}


def test_models_tested(values):
    assert values(['["a","b"]', "plain", "[broken"], c.parse_models_tested) == [["a", "b"], ["plain"], ["[broken"]]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Art", "Easy", 100, "2020-01-01", "Jeopardy!"), (2, "art", "Hard", None, "bad", "Final Jeopardy!"),
                                (3, "Music", "Hard", 500, "2021-06-01", "Double Jeopardy!")],
                               "question_id int, category string, difficulty_level string, value int, air_date string, round string")

    def ids(d):
        return sorted(r["question_id"] for r in d.collect())
    assert ids(f.by_category(df, ["ART"])) == [1, 2]
    assert ids(f.by_value_range(df, 100, 500)) == [1, 3] and ids(f.by_value_range(df)) == [1, 2, 3]
    assert ids(f.by_date_range(df, "2020-01-01", "2020-12-31")) == [1]
    assert ids(f.by_round(df, ["final", "double jeopardy"])) == [2, 3]
    assert ids(f.apply_filters(df.drop("round"), {"rounds": ["final"], "min_value": 200})) == [3]
    assert ids(f.get_questions(df, limit=1, offset=1)) == [2]


@pytest.mark.parametrize("model,expected", [("m-1", [1, 3]), ("m", [3])])
def test_runs_with_model(spark, model, expected):
    runs = spark.createDataFrame([(1, '["m-1","x"]'), (2, '["y"]'), (3, "some m-1 text")], "run_id int, models_tested string")
    assert [r[0] for r in f.runs_with(runs, model=model).select("run_id").orderBy("run_id").collect()] == expected
