"""Validation rules, audits and fixes (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizspark import fixed_values as fv, views as v
from quizspark.operators import validate as val
from quizspark.registry.base import Registry
from quizspark.registry.text_sql import WS, lit

R = Registry()

# A question table with holes and defects: documents as questions, urls and names as answers.
DIRTY = """
SELECT 'd' || doc_id AS question_id, text AS question, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN text
    WHEN doc_id % 7 = 2 THEN 'well, who is ' || source ELSE '  ' || lang || '    <b>' || source || '</b>' END AS answer,
  CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN lang || '_' || source WHEN doc_id % 9 = 2 THEN 'x' WHEN doc_id % 9 = 3 THEN 'Science '
    ELSE 'HISTORY' END AS category,
  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'abc' WHEN doc_id % 6 = 2 THEN CAST(0 - n_chars AS VARCHAR)
    WHEN doc_id % 6 = 3 THEN CAST(n_chars * 10 AS VARCHAR) ELSE '800' END AS value,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '1950-05-05' WHEN doc_id % 5 = 2 THEN '2031-01-01' WHEN doc_id % 5 = 3 THEN 'soon'
    ELSE '2004-09-06' END AS air_date,
  CASE WHEN doc_id % 4 = 0 THEN 'Impossible' ELSE 'Easy' END AS difficulty_level FROM documents
UNION ALL SELECT 'q' || question_id, question, answer, category, CAST(value AS VARCHAR), CAST(air_date AS VARCHAR), difficulty_level FROM questions"""


def dirty(spark, sf):
    d, i = v.documents(spark, sf), F.col("doc_id")
    docs = d.select(
        F.concat(F.lit("d"), i.cast("string")).alias("question_id"), F.col("text").alias("question"),
        F.when(i % 7 == 0, "").when(i % 7 == 1, F.col("text"))
        .when(i % 7 == 2, F.concat(F.lit("well, who is "), "source"))
        .otherwise(F.concat(F.lit("  "), "lang", F.lit("    <b>"), "source", F.lit("</b>"))).alias("answer"),
        F.when(i % 9 == 0, F.lit(None)).when(i % 9 == 1, F.concat("lang", F.lit("_"), "source")).when(i % 9 == 2, "x")
        .when(i % 9 == 3, "Science ").otherwise("HISTORY").alias("category"),
        F.when(i % 6 == 0, F.lit(None)).when(i % 6 == 1, "abc").when(i % 6 == 2, (-F.col("n_chars")).cast("string"))
        .when(i % 6 == 3, (F.col("n_chars") * 10).cast("string")).otherwise("800").alias("value"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, "1950-05-05").when(i % 5 == 2, "2031-01-01").when(i % 5 == 3, "soon")
        .otherwise("2004-09-06").alias("air_date"),
        F.when(i % 4 == 0, "Impossible").otherwise("Easy").alias("difficulty_level"))
    q = v.questions(spark, sf).select(
        F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("question_id"), "question", "answer", "category",
        F.col("value").cast("string").alias("value"), F.col("air_date").cast("string").alias("air_date"), "difficulty_level")
    return docs.unionByName(q)


AS_OF = "2026-01-01"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _list(*tests: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN {text} END" for test, text in tests)
    return f"[x FOR x IN [{cases}] IF x IS NOT NULL]"


def _guard(col: str, text: str, otherwise: str) -> str:
    return f"CASE WHEN coalesce({col}, '') = '' THEN [{lit(text)}] ELSE {otherwise} END"


def question_sql(c: str = "question", strict: bool = False) -> str:
    s = strip(c)
    tests = [
        (f"length({s}) < 10", f"'Question too short (' || length({s}) || ' chars, minimum 10)'"),
        (f"length({s}) > 500", f"'Question too long (' || length({s}) || ' chars, maximum 500)'"),
        (f"right({s}, 1) NOT IN ('.', '?', '!') AND NOT (left({s}, 1) = '''' AND right({s}, 1) = '''') AND NOT (left({s}, 1) = '\"' AND right({s}, 1) = '\"')",
         lit("Question should end with proper punctuation or be properly quoted")),
        (f"regexp_matches({s}, '<[^>]+>')", lit("Question contains HTML tags")),
        (f"regexp_matches({s}, '{WS}{{3,}}')", lit("Question contains excessive whitespace"))]
    if strict:
        tests += [(f"length({s}) - length(replace({s}, '?', '')) > 1", lit("Question contains multiple question marks")),
                  (rf"NOT regexp_matches({s}, '(?i)(^|[^\p{{L}}\p{{N}}_])(this|these|it|he|she)($|[^\p{{L}}\p{{N}}_])')",
                   lit("Question may not follow typical Jeopardy format"))]
    return _guard(c, "Question is empty or not a string", _list(*tests))


def answer_sql(c: str = "answer", strict: bool = False) -> str:
    s = strip(c)
    tests = [
        (f"length({s}) < 1", lit("Answer is empty after stripping whitespace")),
        (f"length({s}) > 200", f"'Answer too long (' || length({s}) || ' chars, maximum 200)'"),
        (f"regexp_matches({s}, '<[^>]+>')", lit("Answer contains HTML tags")),
        (f"regexp_matches({s}, '{WS}{{3,}}')", lit("Answer contains excessive whitespace"))]
    if strict:
        tests.append((f"regexp_matches(lower({s}), 'what is|who is|where is|when is') AND NOT regexp_matches(lower({s}), "
                      "'^(what|who|where|when|how) (is|are|was|were)')", lit("Answer format may be incorrect for Jeopardy style")))
    return _guard(c, "Answer is empty or not a string", _list(*tests))


def category_sql(c: str = "category", custom: bool = True) -> str:
    s = strip(c)
    tests = [
        (f"length({s}) < 2", f"'Category too short (' || length({s}) || ' chars, minimum 2)'"),
        (f"length({s}) > 50", f"'Category too long (' || length({s}) || ' chars, maximum 50)'"),
        (rf"NOT regexp_matches({s}, '^[A-Za-z0-9\s&\-.!?''\"]+$')", lit("Category contains invalid characters"))]
    if not custom:
        known = ", ".join(lit(k) for k in fv.KNOWN_CATEGORIES)
        tests.append((f"upper({s}) NOT IN ({known})", f"'Category ''' || {s} || ''' not in predefined valid categories'"))
    return _guard(c, "Category is empty or not a string", _list(*tests))


def value_sql(c: str = "value", strict: bool = False) -> str:
    n = f"TRY_CAST({c} AS BIGINT)"
    tests = [(f"{n} <= 0", f"'Value must be positive (got ' || {n} || ')'"),
             (f"{n} > 10000", f"'Value unusually high (' || {n} || '), maximum expected is 10000'")]
    if strict:
        allowed = fv.ERA_VALUES["all"]
        tests.append((f"{n} NOT IN ({', '.join(map(str, allowed))})",
                      f"'Value ' || {n} || {lit(f' not in valid set for era {chr(39)}all{chr(39)}: {allowed}')}"))
    return (f"CASE WHEN {c} IS NULL THEN [] WHEN {n} IS NULL THEN ['Value ''' || {c} || ''' cannot be converted to integer'] "
            f"ELSE {_list(*tests)} END")


def date_sql(c: str = "air_date") -> str:
    d = f"TRY_CAST({c} AS DATE)"
    return (f"CASE WHEN {c} IS NULL THEN [] WHEN {d} IS NULL THEN ['Invalid date format'] ELSE " + _list(
        (f"{d} < DATE '1964-01-01'", f"'Date ' || {d} || ' is before Jeopardy started (1964)'"),
        (f"{d} > DATE '{AS_OF}'", f"'Date ' || {d} || ' is in the future'")) + " END")


def difficulty_sql(c: str = "difficulty_level") -> str:
    levels = ", ".join(lit(x) for x in fv.DIFFICULTY_LEVELS)
    message = lit(f"' not in valid levels: {fv.DIFFICULTY_LEVELS}")
    return f"CASE WHEN {c} IS NULL THEN [] ELSE " + _list(
        (f"{c} NOT IN ({levels})", f"'Difficulty ''' || {c} || {message}")) + " END"


def _rule(name: str, sql: str, column: str, build) -> None:
    @R.add(name, f"WITH dirty AS ({DIRTY}) SELECT question_id, array_to_string({sql}, ' | ') AS issues FROM dirty")
    def _(spark, sf):
        return dirty(spark, sf).select("question_id", F.array_join(build(F.col(column)), " | ").alias("issues"))


_rule("l01_question_rules", question_sql(), "question", val.question_issues)
_rule("l01b_question_rules_strict", question_sql(strict=True), "question", lambda c: val.question_issues(c, True))
_rule("l02_answer_rules", answer_sql(strict=True), "answer", lambda c: val.answer_issues(c, True))
_rule("l03_category_rules", category_sql(custom=False), "category", lambda c: val.category_issues(c, True, False))
_rule("l04_value_rules", value_sql(strict=True), "value", lambda c: val.value_issues(c, True))
_rule("l05_date_rules", date_sql(), "air_date", lambda c: val.date_issues(c, AS_OF))
_rule("l06_difficulty_rules", difficulty_sql(), "difficulty_level", val.difficulty_issues)

CHECKED = f"""WITH dirty AS ({DIRTY}), checked AS (SELECT question_id, {question_sql()} AS qi, {answer_sql()} AS ai,
  {category_sql()} AS ci, {value_sql()} AS vi, {date_sql()} AS di, {difficulty_sql()} AS li FROM dirty)"""


@R.add("l07_field_report", CHECKED + """, f AS (
SELECT 'question' AS field, len(qi) AS n, qi, ai FROM checked UNION ALL SELECT 'answer', len(ai), qi, ai FROM checked
UNION ALL SELECT 'category', len(ci), qi, ai FROM checked UNION ALL SELECT 'value', len(vi), qi, ai FROM checked
UNION ALL SELECT 'air_date', len(di), qi, ai FROM checked UNION ALL SELECT 'difficulty_level', len(li), qi, ai FROM checked)
SELECT field, count(*) FILTER (n = 0) AS valid, count(*) FILTER (n > 0) AS invalid, count(*) AS total_questions,
  count(*) FILTER (len(qi) = 0 AND len(ai) = 0) AS valid_questions FROM f GROUP BY ALL""")
def _(spark, sf):
    return val.field_report(dirty(spark, sf), AS_OF)


@R.add("l07b_issue_rows", CHECKED + """
SELECT question_id, 'question' AS field, unnest(qi) AS issue FROM checked
UNION ALL SELECT question_id, 'answer', unnest(ai) FROM checked""")
def _(spark, sf):
    return val.issue_rows(dirty(spark, sf), AS_OF)


@R.add("l08_audit", f"""WITH dirty AS ({DIRTY}), c AS (SELECT coalesce(question, '') <> '' AS q, coalesce(answer, '') <> '' AS a,
    coalesce(category, '') <> '' AS k, value IS NOT NULL AS v, len({question_sql()}) = 0 AS qok, len({answer_sql()}) = 0 AS aok,
    len({category_sql()}) = 0 AS kok, len({value_sql()}) = 0 AS vok, question FROM dirty),
r AS (SELECT 'missing_data' AS check_name, count(*) FILTER (NOT (q AND a AND k)) AS issues, count(*) FILTER (q AND a AND k) AS passed_count FROM c
UNION ALL SELECT 'format_validation', count(*) FILTER (q AND NOT qok) + count(*) FILTER (a AND NOT aok),
  count(*) FILTER (q AND qok) + count(*) FILTER (a AND aok) FROM c
UNION ALL SELECT 'category_consistency', count(*) FILTER (k AND NOT kok), count(*) FILTER (k AND kok) FROM c
UNION ALL SELECT 'value_range_validation', count(*) FILTER (v AND NOT vok), count(*) FILTER (v AND vok) FROM c
UNION ALL SELECT 'duplicate_detection', count(*) FILTER (q) - count(DISTINCT CASE WHEN q THEN question END),
  count(DISTINCT CASE WHEN q THEN question END) FROM c)
SELECT *, issues = 0 AS passed FROM r""")
def _(spark, sf):
    return val.audit(dirty(spark, sf))


def _tidy(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN {c} ELSE regexp_replace({strip(c)}, '{WS}{{3,}}', ' ', 'g') END"


@R.add("l09_auto_fix", f"""WITH dirty AS ({DIRTY}), fixed AS (SELECT question_id, question, answer, category, {_tidy('question')} AS q, {_tidy('answer')} AS a,
  CASE WHEN coalesce(category, '') = '' THEN category ELSE upper({strip('category')}) END AS c FROM dirty)
SELECT question_id, md5(q) AS question_md5, a AS answer, c AS category FROM fixed
WHERE q IS DISTINCT FROM question OR a IS DISTINCT FROM answer OR c IS DISTINCT FROM category""")
def _(spark, sf):
    return val.auto_fix(dirty(spark, sf)).select("question_id", F.md5("question").alias("question_md5"), "answer", "category")


@R.add("l10_schema_split", f"""WITH dirty AS ({DIRTY}), typed AS (SELECT *, TRY_CAST(value AS BIGINT) AS n FROM dirty),
judged AS (SELECT question_id, {strip('question')} AS q, {strip('answer')} AS a, concat_ws('; ',
  CASE WHEN length({strip('question')}) < 10 THEN 'question: must be at least 10 characters long' END,
  CASE WHEN length({strip('answer')}) < 1 THEN 'answer: cannot be empty' END, CASE WHEN n < 0 THEN 'value: must be non-negative' END,
  CASE WHEN difficulty_level NOT IN ('Easy', 'Medium', 'Hard', 'Unknown') THEN 'difficulty_level: unknown level' END) AS reason FROM typed)
SELECT question_id, reason, CASE WHEN reason = '' THEN md5(q || '|' || a) END AS kept_md5 FROM judged""")
def _(spark, sf):
    typed = dirty(spark, sf).withColumn("value", F.col("value").try_cast("bigint"))
    good, bad = val.schema_split(typed)
    return good.select("question_id", F.lit("").alias("reason"), F.md5(F.concat_ws("|", "question", "answer")).alias("kept_md5")
                       ).unionByName(bad.select("question_id", F.col("rejected_because").alias("reason"),
                                                F.lit(None).cast("string").alias("kept_md5")))


_GATED = f"""SELECT len({question_sql()}) = 0 AND len({answer_sql()}) = 0 AND len({category_sql()}) = 0 AND len({value_sql()}) = 0 AS ok FROM"""


@R.add("l11_quality_gate", f"""WITH dirty AS ({DIRTY}), well AS (SELECT question_id, answer AS question, question AS answer, category, CAST(value AS VARCHAR) AS value FROM questions),
judged AS (SELECT 'mixed' AS input, ok FROM ({_GATED} dirty) UNION ALL SELECT 'well formed', ok FROM ({_GATED} well))
SELECT input, count(*) AS n, count(*) FILTER (ok) * 100.0 / count(*) >= 80 AS passes FROM judged GROUP BY ALL""")
def _(spark, sf):
    """The gate at its own minimum over a set that fails and one that passes."""
    well = v.questions(spark, sf).select("question_id", F.col("answer").alias("question"), F.col("question").alias("answer"), "category",
                                         F.col("value").cast("string").alias("value"))
    rows = []
    for name, df in (("mixed", dirty(spark, sf).select(*well.columns)), ("well formed", well)):
        try:
            val.require_quality(df, AS_OF)
            passes = True
        except val.ValidationError:
            passes = False
        rows.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("input"), "n", F.lit(passes).alias("passes")))
    return rows[0].unionByName(rows[1])
