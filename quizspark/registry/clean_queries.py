"""Cleaning, derivation (B) and filters (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizspark import views as v
from quizspark.functions import labels, text as tx
from quizspark.operators import catalog as cat, clean as c, filters as f
from quizspark.plans.ranking import with_position
from quizspark.registry.base import Registry, rounded

R = Registry()
WS = tx.WS


def sql_clean(col: str) -> str:
    """SQL of the text cleaning chain."""
    bare = (f"trim(regexp_replace(regexp_replace({col}, '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'))")
    return (f"replace(replace(replace(replace({bare}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")


def sql_value(col: str) -> str:
    digits = f"trim(regexp_replace({col}, '[$,]', '', 'g'))"
    return f"CASE WHEN regexp_full_match({digits}, '[+-]?[0-9]+') THEN TRY_CAST({digits} AS INT) END"


def sql_date(col: str) -> str:
    formats = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%B %d, %Y"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({col}, '{x}')" for x in formats) + ") AS DATE)"


def _raw(spark, sf):
    return c.standardize_columns(v.raw_questions(spark, sf))


@R.add("b01_standardize_columns", """
SELECT page, subject AS category, worth AS value, date_text AS air_date, md5(clue) AS question_md5, md5(response) AS answer_md5
FROM raw_questions""")
def _(spark, sf):
    return _raw(spark, sf).select("page", "category", "value", "air_date", F.md5("question").alias("question_md5"),
                                  F.md5("answer").alias("answer_md5"))


@R.add("b02_clean_text", f"""
SELECT page_id, {sql_clean('html')} AS text FROM pages
UNION ALL SELECT -1 - doc_id, {sql_clean('text')} FROM documents""")
def _(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", c.clean_text(F.col("html")).alias("text"))
    docs = v.documents(spark, sf).select((-1 - F.col("doc_id")).alias("page_id"),
                                                  c.clean_text(F.col("text")).alias("text"))
    return pages.unionByName(docs)


@R.add("b03_parse_value", f"SELECT page, CAST({sql_value('worth')} AS BIGINT) AS value FROM raw_questions")
def _(spark, sf):
    return rounded(_raw(spark, sf).select("page", c.parse_value(F.col("value")).alias("value")))


@R.add("b04_parse_date", f"SELECT page, strftime({sql_date('date_text')}, '%Y-%m-%d') AS air_date FROM raw_questions")
def _(spark, sf):
    return rounded(_raw(spark, sf).select("page", c.parse_date(F.col("air_date")).alias("air_date")))


@R.add("b05_filter_invalid", """
SELECT question_id, question, answer FROM questions WHERE length(question) >= 10 AND length(answer) >= 1""")
def _(spark, sf):
    return c.filter_invalid(v.questions(spark, sf)).select("question_id", "question", "answer")


@R.add("b06_difficulty_level", """
SELECT CASE WHEN value IS NULL THEN 'Unknown' WHEN value <= 600 THEN 'Easy' WHEN value <= 1200 THEN 'Medium' ELSE 'Hard' END
  AS difficulty_level, count(*) AS n FROM
  (SELECT CASE WHEN p_partkey % 10 > 0 THEN p_size * 50 END AS value FROM part) GROUP BY 1""")
def _(spark, sf):
    value = F.when(F.col("p_partkey") % 10 > 0, F.col("p_size") * 50)
    return v.table(spark, sf, "part").groupBy(labels.difficulty_level(value).alias("difficulty_level")).agg(
        F.count(F.lit(1)).alias("n"))


@R.add("b07_add_metadata", """
SELECT md5(question || '|' || answer) AS id, question_id, length(question) AS question_length,
  length(answer) AS answer_length FROM questions""")
def _(spark, sf):
    return rounded(c.add_metadata(v.questions(spark, sf)).select(
        "id", "question_id", "question_length", "answer_length"))


@R.add("b08_preprocess", f"""
SELECT page, md5(question || '|' || answer) AS id, category, CAST(value AS BIGINT) AS value,
  strftime(air_date, '%Y-%m-%d') AS air_date,
  CASE WHEN value IS NULL THEN 'Unknown' WHEN value <= 600 THEN 'Easy' WHEN value <= 1200 THEN 'Medium' ELSE 'Hard' END
    AS difficulty_level, length(question) AS question_length, length(answer) AS answer_length
FROM (SELECT page, {sql_clean('clue')} AS question, {sql_clean('response')} AS answer, {sql_clean('subject')} AS category,
  {sql_value('worth')} AS value, {sql_date('date_text')} AS air_date FROM raw_questions)
WHERE length(question) >= 10 AND length(answer) >= 1""")
def _(spark, sf):
    done = c.preprocess(v.raw_questions(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return rounded(done.select("page", "id", "category", "value", "air_date", "difficulty_level",
                               "question_length", "answer_length"))


@R.add("b09_value_bucket", """
SELECT question_id, CASE WHEN value < 400 THEN 'Low ($1-399)' WHEN value < 800 THEN 'Medium ($400-799)'
  ELSE 'High ($800+)' END AS bucket FROM questions""")
def _(spark, sf):
    return v.questions(spark, sf).select("question_id", labels.value_bucket(F.col("value")).alias("bucket"))


@R.add("b10_sampling_defaults", """
SELECT question_id, CAST(coalesce(nullif(CASE WHEN question_id % 4 > 0 THEN value WHEN question_id % 8 = 0 THEN 0 END, 0), 400) AS BIGINT)
  AS value, coalesce(nullif(CASE WHEN question_id % 5 > 0 THEN difficulty_level WHEN question_id % 10 = 0 THEN '' END, ''), 'Medium')
  AS difficulty_level FROM questions""")
def _(spark, sf):
    qid = F.col("question_id")
    holes = v.questions(spark, sf).select(
        "question_id", F.when(qid % 4 > 0, F.col("value")).when(qid % 8 == 0, 0).alias("value"),
        F.when(qid % 5 > 0, F.col("difficulty_level")).when(qid % 10 == 0, "").alias("difficulty_level"))
    return rounded(c.sampling_defaults(holes))


@R.add("b11_flatten", """
SELECT question_id, category AS detail_category, CAST(value AS BIGINT) AS detail_price_value,
  topic || ', ' || difficulty_level AS detail_tags FROM questions""")
def _(spark, sf):
    nested = v.questions(spark, sf).select("question_id", F.struct(
        "category", F.struct("value").alias("price"), F.array("topic", "difficulty_level").alias("tags")).alias("detail"))
    return rounded(c.flatten(nested))


@R.add("b12_parse_models_tested", """
SELECT run_id, CASE WHEN models_tested[1] = '[' THEN array_to_string(CAST(models_tested AS JSON)::VARCHAR[], '+')
  ELSE models_tested END AS models FROM runs""")
def _(spark, sf):
    return v.runs(spark, sf).select("run_id", F.array_join(
        c.parse_models_tested(F.col("models_tested")), "+").alias("models"))


@R.add("b13_normalize_catalog", """
SELECT model_id, name, provider, CAST(context_length AS BIGINT) AS context_length, round(input_cost, 6) AS input_cost,
  round(output_cost, 6) AS output_cost, array_to_string(capabilities, ',') AS capabilities, available FROM catalog""")
def _(spark, sf):
    return rounded(v.catalog(spark, sf).select(
        "model_id", "name", "provider", "context_length", "input_cost", "output_cost",
        F.array_join("capabilities", ",").alias("capabilities"), "available"))


# ---- filters -----------------------------------------------------------------------------------

def _ids(df):
    return df.select("question_id")


@R.add("c01_filter_category", "SELECT question_id FROM questions WHERE lower(category) IN ('brand#1', 'brand#12')")
def _(spark, sf):
    return _ids(f.by_category(v.questions(spark, sf), ["BRAND#1", "brand#12"]))


@R.add("c02_filter_difficulty", "SELECT question_id FROM questions WHERE difficulty_level IN ('Easy', 'Hard')")
def _(spark, sf):
    return _ids(f.by_difficulty(v.questions(spark, sf), ["Easy", "Hard"]))


@R.add("c03_filter_value_range", "SELECT question_id FROM questions WHERE value BETWEEN 400 AND 1200")
def _(spark, sf):
    return _ids(f.by_value_range(v.questions(spark, sf), 400, 1200))


@R.add("c04_filter_date_range", """
SELECT question_id FROM questions WHERE air_date BETWEEN DATE '1985-01-01' AND DATE '1988-12-31'""")
def _(spark, sf):
    text_dates = v.questions(spark, sf).withColumn("air_date", F.col("air_date").cast("string"))
    return _ids(f.by_date_range(text_dates, "1985-01-01", "1988-12-31"))


@R.add("c05_filter_round", "SELECT question_id FROM questions WHERE round IN ('Jeopardy!', 'Final Jeopardy!')")
def _(spark, sf):
    return _ids(f.by_round(v.questions(spark, sf), ["single", "final"]))


@R.add("c06_apply_filters", """
SELECT question_id FROM questions WHERE lower(category) IN ('brand#3', 'brand#4', 'brand#5')
  AND difficulty_level IN ('Medium', 'Hard') AND value >= 700 AND air_date >= DATE '1984-10-01' AND round = 'Double Jeopardy!'""")
def _(spark, sf):
    return _ids(f.apply_filters(v.questions(spark, sf), {
        "categories": ["Brand#3", "Brand#4", "Brand#5"], "difficulty_levels": ["Medium", "Hard"], "min_value": 700,
        "start_date": "1984-10-01", "rounds": ["double"]}))


@R.add("c07_question_page", """
SELECT question_id, category, CAST(value AS BIGINT) AS value FROM questions WHERE difficulty_level = 'Hard' AND value <= 2000
ORDER BY question_id LIMIT 50 OFFSET 20""")
def _(spark, sf):
    return rounded(f.get_questions(v.questions(spark, sf), {"difficulty_level": "Hard", "max_value": 2000}, 50, 20)
                   .select("question_id", "category", "value"))


@R.add("c07b_deep_page", """
SELECT question_id, category, CAST(value AS BIGINT) AS value FROM questions ORDER BY question_id LIMIT 40 OFFSET 90""")
def _(spark, sf):
    """A page beyond what may be gathered, found by position."""
    return rounded(f.get_questions(v.questions(spark, sf), limit=40, offset=90, gathered=100).select("question_id", "category", "value"))


@R.add("c08_contains_text", """
SELECT result_id FROM graded WHERE contains(lower(model_name), 'del-a') AND contains(lower(category), 'brand#1')""")
def _(spark, sf):
    rows = f.contains_text(v.graded(spark, sf), "model_name", "DEL-A")
    return f.contains_text(rows, "category", "brand#1").select("result_id")


@R.add("c09_runs_with_model", """
SELECT run_id FROM runs WHERE status = 'completed' AND CASE WHEN models_tested[1] = '['
  THEN list_contains(CAST(models_tested AS JSON)::VARCHAR[], 'model-3') ELSE contains(models_tested, 'model-3') END""")
def _(spark, sf):
    return f.runs_with(v.runs(spark, sf), "completed", "model-3").select("run_id")


@R.add("c10_usage_filter", """
SELECT event_id FROM usage_log WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
  AND model_id = 'openai/gpt-4' """)
def _(spark, sf):
    return f.usage_between(v.usage(spark, sf), "2024-01-05", "2024-01-20 12:00:00", "openai/gpt-4").select("event_id")


@R.add("c11_lookup_by_id", "SELECT question_id, question FROM questions WHERE question_id = 7")
def _(spark, sf):
    return f.by_id(v.questions(spark, sf), "question_id", 7).select("question_id", "question")


@R.add("c12_catalog_filters", """
SELECT model_id FROM catalog WHERE lower(provider) = 'promo' AND list_contains(capabilities, 'long_context')
  AND context_length >= 120000 AND (contains(lower(model_id), 'red') OR contains(lower(name), 'red')
  OR contains(lower(provider), 'red') OR len([x FOR x IN capabilities IF contains(lower(x), 'red')]) > 0)""")
def _(spark, sf):
    rows = f.with_context(f.with_capability(f.by_provider(v.catalog(spark, sf), "PROMO"), "long_context"), 120000)
    return f.search_catalog(rows, "Red").select("model_id")


@R.add("c13_errors_only", "SELECT result_id FROM results WHERE NOT coalesce(is_correct, FALSE) OR is_error")
def _(spark, sf):
    log = v.results(spark, sf).withColumn("error", F.when(F.col("is_error"), "failed"))
    return f.errors_only(log).select("result_id")


@R.add("g05_catalog_listing", """
SELECT provider, name, model_id, row_number() OVER (ORDER BY provider, name, model_id) AS place FROM catalog""")
def _(spark, sf):
    placed = with_position(cat.listing(v.catalog(spark, sf)).select("provider", "name", "model_id"), ["provider", "name", "model_id"], "place")
    return placed.withColumn("place", F.col("place").cast("bigint"))
