"""Text functions, parsing, matching (I), grading (J), alternatives (D7) and batch inference (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizspark import fixed_values as fv, views as v
from quizspark.functions import match as mt, parse as ps, prompts as pr, similarity as si, text as tx
from quizspark.operators import grade as g
from quizspark.registry import text_sql as q
from quizspark.registry.base import Registry, rounded

R = Registry()

TEXTS = """
SELECT 'd' || doc_id AS id, text FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'r' || result_id, response_text FROM responses"""


def texts(spark, sf):
    """Documents, conversation turns and responses as one column of whole texts."""
    docs = v.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = v.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), "text")
    answers = v.responses(spark, sf).select(F.concat(F.lit("r"), "result_id").alias("id"), F.col("response_text").alias("text"))
    return docs.unionByName(turns).unionByName(answers)


def with_texts(select: str) -> str:
    return f"WITH texts AS ({TEXTS}) {select}"


@R.add("i01_normalize_text", with_texts(f"SELECT id, md5({q.norm('text')}) AS norm_md5 FROM texts"))
def _(spark, sf):
    return texts(spark, sf).select("id", F.md5(tx.normalize_text(F.col("text"))).alias("norm_md5"))


@R.add("i02_question_content", with_texts(f"""
SELECT id, {q.content('n')} AS content, n LIKE 'w%' AS starts_w FROM (SELECT id, {q.norm('text')} AS n FROM texts)"""))
def _(spark, sf):
    rows = texts(spark, sf).select("id", tx.normalize_text(F.col("text")).alias("n"))
    return rows.select("id", tx.question_content(F.col("n")).alias("content"), F.col("n").startswith("w").alias("starts_w"))


@R.add("i03_extract_numbers", f"""
SELECT 'd' || doc_id AS id, array_to_string(list_sort({q.numbers('text')}), ' ') AS numbers FROM documents
UNION ALL SELECT 'p' || page_id, array_to_string(list_sort({q.numbers('url')}), ' ') FROM pages""")
def _(spark, sf):
    docs = v.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    urls = v.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
                                              F.col("url").alias("text"))
    return docs.unionByName(urls).select("id", F.array_join(
        F.array_sort(tx.extract_numbers(F.col("text"))), " ").alias("numbers"))


@R.add("i04_extract_years", f"""
SELECT 'd' || doc_id AS id, array_to_string({q.years('text')}, ' ') AS years FROM documents
UNION ALL SELECT 'q' || question_id, array_to_string({q.years("'in ' || strftime(air_date, '%Y') || ' on ' || air_date")}, ' ') FROM questions""")
def _(spark, sf):
    docs = v.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    dated = v.questions(spark, sf).select(
        F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("id"),
        F.concat(F.lit("in "), F.date_format("air_date", "yyyy"), F.lit(" on "), F.col("air_date").cast("string")).alias("text"))
    return docs.unionByName(dated).select("id", F.array_join(tx.extract_years(F.col("text")), " ").alias("years"))


@R.add("i05_words_to_digits", with_texts(f"SELECT id, md5({q.words('text', fv.NUMBER_WORDS)}) AS text_md5 FROM texts"))
def _(spark, sf):
    return texts(spark, sf).select("id", F.md5(tx.words_to_digits(F.col("text"))).alias("text_md5"))


@R.add("i06_expand_abbreviations", with_texts(f"SELECT id, md5({q.words('text', q.EXPANSIONS)}) AS text_md5 FROM texts"))
def _(spark, sf):
    return texts(spark, sf).select("id", F.md5(tx.expand_abbreviations(F.col("text"))).alias("text_md5"))


@R.add("i07_fuzzy_scores", f"""WITH n AS (SELECT result_id, {q.norm('response_text')} AS na, {q.norm('answer')} AS ne FROM responses),
{q.fuzzy_ctes('n', 'f')} SELECT result_id, s1 AS ratio, s2 AS partial_ratio, s3 AS token_sort_ratio, s4 AS token_set_ratio, best FROM f""")
def _(spark, sf):
    rows = v.responses(spark, sf).select("result_id", tx.normalize_text(F.col("response_text")).alias("a"),
                                         tx.normalize_text(F.col("answer")).alias("b"))
    return rounded(rows.withColumn("s", si.fuzzy_scores(F.col("a"), F.col("b"))).select("result_id", "s.*"))


@R.add("i07b_edit_similarity", f"""
SELECT result_id, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6)
  AS similarity, array_to_string(list_sort(string_split(a, ' ')), ' ') = array_to_string(list_sort(string_split(b, ' ')), ' ') AS same_tokens
FROM (SELECT result_id, {q.norm('response_text')} AS a, {q.norm('answer')} AS b FROM responses)""")
def _(spark, sf):
    rows = v.responses(spark, sf).select("result_id", tx.normalize_text(F.col("response_text")).alias("a"),
                                         tx.normalize_text(F.col("answer")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rounded(rows.select("result_id", tx.levenshtein_similarity(a, b).alias("similarity"),
                               (tx.sorted_tokens(a) == tx.sorted_tokens(b)).alias("same_tokens")))


@R.add("i08_token_jaccard", f"""
SELECT result_id, array_to_string(a, ' ') AS tokens, round({q.jaccard('a', 'b')}, 6) AS jaccard FROM (
  SELECT result_id, {q.tokens('na')} AS a, {q.tokens('nb')} AS b FROM (
    SELECT result_id, {q.norm('response_text')} AS na, {q.norm('answer')} AS nb FROM responses))""")
def _(spark, sf):
    rows = v.responses(spark, sf).select(
        "result_id", tx.meaningful_tokens(tx.normalize_text(F.col("response_text"))).alias("a"),
        tx.meaningful_tokens(tx.normalize_text(F.col("answer"))).alias("b"))
    return rounded(rows.select("result_id", F.array_join("a", " ").alias("tokens"),
                               tx.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@R.add("i08b_document_tokens", f"""
SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (
  SELECT doc_id, {q.tokens('n')} AS t FROM (SELECT doc_id, {q.norm('text')} AS n FROM documents))""")
def _(spark, sf):
    rows = v.documents(spark, sf).select("doc_id", tx.meaningful_tokens(tx.normalize_text(F.col("text"))).alias("t"))
    return rounded(rows.select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct")))


@R.add("i08c_synonym_similarity", f"""
WITH syn AS (SELECT DISTINCT split_part(question, ' ', 1) AS a, split_part(question, ' ', 2) AS b, 0.75 AS sim FROM questions),
rows AS (SELECT result_id, {q.tokens('na')} AS ta, {q.tokens('ne')} AS te FROM (
  SELECT result_id, {q.norm('response_text')} AS na, {q.norm('category || chr(32) || question')} AS ne FROM responses)),
tok AS (SELECT result_id, te, len(ta) AS n, unnest(ta) AS t, generate_subscripts(ta, 1) AS pos FROM rows),
best AS (SELECT result_id, n, pos, greatest(max(CASE WHEN list_contains(te, t) THEN 1 ELSE 0 END),
    coalesce(max(CASE WHEN list_contains(te, syn.b) THEN sim END), 0)) AS s
  FROM tok LEFT JOIN syn ON syn.a = t GROUP BY ALL)
SELECT r.result_id, round(coalesce(x.s, 0), 6) AS synonym_score FROM rows r LEFT JOIN (
  SELECT result_id, sum(s) / any_value(n) AS s FROM best GROUP BY result_id) x USING (result_id)""")
def _(spark, sf):
    synonyms = v.questions(spark, sf).select(
        F.split_part("question", F.lit(" "), F.lit(1)).alias("token_a"),
        F.split_part("question", F.lit(" "), F.lit(2)).alias("token_b"), F.lit(0.75).alias("sim")).distinct()
    rows = v.responses(spark, sf).select(
        "result_id", tx.meaningful_tokens(tx.normalize_text(F.col("response_text"))).alias("ta"),
        tx.meaningful_tokens(tx.normalize_text(F.concat_ws(" ", "category", "question"))).alias("te"))
    return rounded(mt.synonym_similarity(rows, "result_id", "ta", "te", synonyms).select("result_id", "synonym_score"))


@R.add("i09_match_answers", f"""
WITH {q.matched('responses', 'response_text', 'answer', "category LIKE 'Brand#1%'")}
SELECT result_id, is_match, round(conf, 6) AS confidence, mtype AS match_type FROM matched""")
def _(spark, sf):
    needs = F.col("category").startswith("Brand#1")
    rows = mt.match_answers(v.responses(spark, sf), "response_text", "answer", needs)
    return rounded(rows.select("result_id", "match.is_match", "match.confidence", "match.match_type"))


@R.add("i09b_match_answers_fuzzy", f"""WITH {q.matched('responses', 'response_text', 'answer')}
SELECT result_id, is_match, round(conf, 6) AS confidence, mtype AS match_type FROM matched""")
def _(spark, sf):
    rows = mt.match_answers(v.responses(spark, sf), "response_text", "answer")
    return rounded(rows.select("result_id", "match.is_match", "match.confidence", "match.match_type"))


@R.add("d07_match_alternatives", f"""
WITH tagged AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM responses),
fan AS (SELECT rid, result_id, response_text, 0 AS pos, answer AS acceptable FROM tagged
  UNION ALL SELECT rid, result_id, response_text, 1, upper(question) FROM tagged
  UNION ALL SELECT rid, result_id, response_text, 2, 'five ' || question FROM tagged),
{q.matched('fan', 'response_text', 'acceptable')},
numbered AS (SELECT *, list_position(['exact', '{fv.QUESTION_TYPE}', 'number_date', 'abbreviation', 'fuzzy', 'semantic'], mtype) AS s FROM matched)
SELECT result_id, is_match, round(conf, 6) AS confidence, mtype AS match_type, acceptable AS matched_against FROM numbered
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY NOT is_match, CASE WHEN is_match THEN 0 ELSE -conf END, s, pos) = 1""")
def _(spark, sf):
    rows = v.responses(spark, sf).withColumn("also", F.array(
        F.upper("question"), F.concat(F.lit("five "), "question")))
    out = mt.match_any(rows, "response_text", "answer", "also")
    return rounded(out.select("result_id", "match.is_match", "match.confidence", "match.match_type", "matched_against"))


ANSWERS = """
SELECT 'c' || conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'r' || result_id, response_text FROM responses UNION ALL SELECT 'd' || doc_id, text FROM documents"""


def answers(spark, sf):
    turns = v.table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), "text")
    replies = v.responses(spark, sf).select(F.concat(F.lit("r"), "result_id").alias("id"), F.col("response_text").alias("text"))
    docs = v.documents(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return turns.unionByName(replies).unionByName(docs)


@R.add("i10_clean_response", f"WITH answers AS ({ANSWERS}) SELECT id, md5({q.clean_response('text')}) AS clean_md5 FROM answers")
def _(spark, sf):
    return answers(spark, sf).select("id", F.md5(ps.clean_response(F.col("text"))).alias("clean_md5"))


PARSED = f"WITH answers AS ({ANSWERS}), {q.parsed('answers', 'text')} "


@R.add("i11_response_type", PARSED + "SELECT id, rtype AS response_type FROM parsed")
def _(spark, sf):
    return ps.parse_responses(answers(spark, sf), "text").select("id", "parsed.response_type")


@R.add("i12_uncertainty_phrases", PARSED + "SELECT id, array_to_string(hints, '|') AS phrases FROM parsed")
def _(spark, sf):
    rows = ps.parse_responses(answers(spark, sf), "text")
    return rows.select("id", F.array_join("parsed.confidence_indicators", "|").alias("phrases"))


@R.add("i13_reasoning", PARSED + f"SELECT id, md5(CASE WHEN rtype <> 'error' THEN {q.reasoning('clean')} END) AS reasoning_md5 FROM parsed")
def _(spark, sf):
    return ps.parse_responses(answers(spark, sf), "text").select("id", F.md5("parsed.reasoning").alias("reasoning_md5"))


@R.add("i14_extract_answer", PARSED + "SELECT id, extracted AS answer FROM parsed")
def _(spark, sf):
    return ps.parse_responses(answers(spark, sf), "text").select("id", F.col("parsed.extracted_answer").alias("answer"))


_MARK = "CASE WHEN suffix(t, '?') THEN '' ELSE '?' END"


@R.add("i14b_adapter_answer", rf"""
WITH answers AS ({ANSWERS}), stripped AS (SELECT id, regexp_replace(text, '^{q.WS}+|{q.WS}+$', '', 'g') AS t FROM answers),
cut AS (SELECT id, CASE WHEN regexp_matches(t, '(?i)^(what|who|where|when|why|how) (is|are|was|were)')
    THEN CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) || {_MARK} WHEN contains(t, '?') THEN split_part(t, '?', 1) || {_MARK}
      WHEN contains(t, chr(10)) THEN split_part(t, chr(10), 1) || {_MARK} ELSE t END
    ELSE CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) WHEN contains(t, chr(10)) THEN split_part(t, chr(10), 1) ELSE t END END AS a
  FROM stripped)
SELECT id, regexp_replace(a, '^{q.WS}+|{q.WS}+$', '', 'g') AS answer FROM cut""")
def _(spark, sf):
    return answers(spark, sf).select("id", ps.adapter_answer(F.col("text")).alias("answer"))


@R.add("i15_quality_score", PARSED + "SELECT id, round(quality, 6) AS quality FROM parsed")
def _(spark, sf):
    rows = ps.parse_responses(answers(spark, sf), "text")
    return rounded(rows.select("id", F.col("parsed.quality_score").alias("quality")))


@R.add("i16_parse_responses", PARSED + f"""
SELECT rtype AS response_type, count(*) AS n, CAST(sum(len(hints)) AS BIGINT) AS phrases, CAST(sum(length(extracted)) AS BIGINT) AS answer_chars,
  CAST(sum({q.word_count('clean')}) AS BIGINT) AS words, count(*) FILTER (regexp_matches(clean, {q.lit(ps.FORM_ANYWHERE)})) AS in_form,
  round(avg(quality), 6) AS quality FROM parsed GROUP BY ALL""")
def _(spark, sf):
    rows = ps.parse_responses(answers(spark, sf), "text")
    return rounded(rows.groupBy("parsed.response_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("parsed.confidence_indicators")).alias("phrases"),
        F.sum(F.length("parsed.extracted_answer")).alias("answer_chars"), F.sum("parsed.word_count").alias("words"),
        F.count_if("parsed.has_question_form").alias("in_form"), F.avg("parsed.quality_score").alias("quality")))


# ---- prompts -----------------------------------------------------------------------------------

def _prompt_sql(template: str) -> str:
    up = template == "instructional"
    tail = {"basic_qa": ["", "Answer:"], "jeopardy_style": ["", "Response:"], "chain_of_thought": ["", *fv.THOUGHT_STEPS],
            "few_shot": ["Response:"], "instructional": ["", "YOUR RESPONSE:"]}[template]
    head = [fv.SYSTEM_PROMPTS[template], ""]
    if up:
        head += [*fv.INSTRUCTION_LINES, ""]
    if template == "few_shot":
        for i, e in enumerate(fv.FEW_SHOT_EXAMPLES, 1):
            head += [f"Example {i}:", f"Category: {e['category']}", f"Value: {e['value']}", f"Clue: {e['question']}",
                     f"Response: {e['correct_answer']}", ""]
        head.append("Now answer this new clue:")
    label = (lambda s: s.upper()) if up else (lambda s: s)
    ask = "Question: " if template == "basic_qa" else label("Clue: ")
    context = [f"{q.lit(label('Category: '))} || cat", f"{q.lit(label('Value: '))} || val", f"{q.lit(label('Difficulty: '))} || dif"]
    gap = [] if template == "few_shot" else ["CASE WHEN coalesce(cat, val, dif) IS NOT NULL THEN '' END"]
    parts = [q.lit(x) for x in head] + context + gap + [f"{q.lit(ask)} || question"] + [q.lit(x) for x in tail]
    return f"concat_ws(chr(10), {', '.join(parts)})"


_PROMPT_ROWS = """
rows AS (SELECT question_id, question, nullif(CASE WHEN question_id % 3 > 0 THEN category ELSE '' END, '') AS cat,
  CASE WHEN question_id % 4 > 0 THEN '$' || value END AS val, CASE WHEN question_id % 5 > 0 THEN difficulty_level END AS dif FROM questions)"""


def _prompt_rows(spark, sf):
    i = F.col("question_id")
    return v.questions(spark, sf).select(
        "question_id", "question", F.when(i % 3 > 0, F.col("category")).otherwise("").alias("cat"),
        F.when(i % 4 > 0, F.concat(F.lit("$"), F.col("value").cast("string"))).alias("val"),
        F.when(i % 5 > 0, F.col("difficulty_level")).alias("dif"))


def _prompt(template: str):
    return pr.build_prompt(F.col("question"), F.col("cat"), F.col("val"), F.col("dif"), template)


@R.add("i17_build_prompts", f"WITH {_PROMPT_ROWS} " + " UNION ALL ".join(
    f"SELECT question_id, '{t}' AS template, {_prompt_sql(t)} AS prompt FROM rows" for t in pr.TEMPLATES))
def _(spark, sf):
    rows = _prompt_rows(spark, sf)
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("template"), _prompt(t).alias("prompt")) for t in pr.TEMPLATES]))
    return rows.select("question_id", both.alias("p")).select("question_id", "p.template", "p.prompt")


@R.add("i18_prompt_tokens", f"WITH {_PROMPT_ROWS} SELECT question_id, length({_prompt_sql('few_shot')}) // 4 AS tokens FROM rows")
def _(spark, sf):
    return _prompt_rows(spark, sf).select("question_id", pr.estimate_tokens(_prompt("few_shot")).alias("tokens"))


# ---- grading -----------------------------------------------------------------------------------

_CREDIT = ("CAST(CASE WHEN conf >= 0.9 THEN 1 WHEN conf >= 0.7 THEN 0.85 WHEN conf >= 0.5 THEN 0.65 "
           "WHEN conf >= 0.3 THEN 0.45 ELSE 0 END AS DOUBLE)")
_LIMIT = """(CASE WHEN contains(lower(category), 'science') OR contains(lower(category), 'history') THEN CAST(0.65 AS DOUBLE)
  WHEN contains(lower(category), 'wordplay') OR contains(lower(category), 'language') THEN CAST(0.80 AS DOUBLE) ELSE CAST(0.70 AS DOUBLE) END
  * CASE WHEN lower(difficulty_level) = 'hard' OR value > 1000 THEN CAST(0.9 AS DOUBLE)
    WHEN lower(difficulty_level) = 'easy' OR value < 400 THEN CAST(1.1 AS DOUBLE) ELSE 1 END)"""
_FUZZY_LIMIT = """(CASE WHEN contains(lower(category), 'science') OR contains(lower(category), 'history') THEN 0.75
  WHEN contains(lower(category), 'wordplay') OR contains(lower(category), 'language') THEN 0.85 ELSE 0.80 END)"""
_FORM = f"rtype = '{fv.QUESTION_TYPE}'"
_RIGHT = {
    "strict": ("is_match AND mtype = 'exact'", "CASE WHEN is_match AND mtype = 'exact' THEN 1 ELSE 0 END"),
    "lenient": ("is_match AND conf >= 0.7", "CASE WHEN is_match AND conf >= 0.7 THEN conf ELSE 0 END"),
    "jeopardy": (f"is_match AND {_FORM} AND conf >= 0.7", f"conf * CASE WHEN {_FORM} THEN 1 ELSE 0.5 END"),
    "adaptive": (f"is_match AND conf >= CASE WHEN len(hints) > 0 THEN {_LIMIT} * CAST(0.9 AS DOUBLE) ELSE {_LIMIT} END", "conf"),
}
_THEMED = "CASE question_id % 4 WHEN 0 THEN 'World History' WHEN 1 THEN 'Wordplay' WHEN 2 THEN 'JEOPARDY history' ELSE category END"


def _grade_sql(mode: str) -> str:
    need = "(TRUE)" if mode == "jeopardy" else "contains(lower(category), 'jeopardy')"
    right, score = _RIGHT[mode]
    limit = _FUZZY_LIMIT if mode == "adaptive" else "0.8"
    return f"""SELECT * FROM (WITH {q.parsed('themed', 'response_text')}, {q.matched('parsed', 'extracted', 'answer', need, limit=limit)}
SELECT result_id, '{mode}' AS mode, CASE WHEN is_timeout THEN NULL WHEN rtype IN ('refusal', 'error') OR is_error THEN FALSE ELSE {right} END AS is_correct,
  round(CAST(CASE WHEN is_timeout OR is_error OR rtype IN ('refusal', 'error') THEN 0 ELSE {score} END AS DOUBLE), 6) AS score,
  round(CASE WHEN is_timeout OR is_error OR rtype IN ('refusal', 'error') THEN 0 ELSE conf END, 6) AS confidence,
  round(CASE WHEN is_timeout OR is_error OR rtype IN ('refusal', 'error') THEN 0 ELSE {_CREDIT} END, 6) AS partial_credit,
  CASE WHEN is_timeout OR is_error OR rtype IN ('refusal', 'error') THEN 'exact' ELSE mtype END AS match_type, rtype AS response_type FROM matched)"""


_THEMED_CTE = f"WITH themed AS (SELECT * REPLACE ({_THEMED} AS category) FROM responses) "


def themed(spark, sf):
    i = F.pmod(F.col("question_id"), F.lit(4))
    theme = (F.when(i == 0, "World History").when(i == 1, "Wordplay").when(i == 2, "JEOPARDY history")
             .otherwise(F.col("category")))
    return (v.responses(spark, sf).withColumn("category", theme)
            .withColumn("error_text", F.when(F.col("is_error"), "failed")))


def _graded_rows(spark, sf, mode):
    rows = g.grade(themed(spark, sf), "response_text", "answer", mode, error="error_text",
                   unanswered=F.col("is_timeout"))
    return rounded(rows.select(
        "result_id", F.lit(mode).alias("mode"), "graded.is_correct", "graded.score", "graded.confidence",
        "graded.partial_credit", "graded.match_type", "graded.response_type"))


def _add_mode(mode: str, name: str) -> None:
    R.add(name, _THEMED_CTE + _grade_sql(mode))(lambda spark, sf: _graded_rows(spark, sf, mode))


_add_mode("strict", "j01_grade_strict")
_add_mode("lenient", "j01b_grade_lenient")
_add_mode("jeopardy", "j01c_grade_question_form")
_add_mode("adaptive", "j01d_grade_adaptive")


@R.add("j02_partial_credit", f"""
SELECT result_id, round({_CREDIT}, 6) AS credit FROM (SELECT result_id, CAST((l_linenumber * 13 + l_quantity) % 101 AS DOUBLE) / 100 AS conf FROM (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS result_id, l_linenumber, l_quantity FROM lineitem))""")
def _(spark, sf):
    conf = F.pmod(F.col("attempt") * 13 + F.col("tokens_output"), F.lit(101)) / 100.0
    return rounded(v.results(spark, sf).select("result_id", g.partial_credit(conf, F.lit(True)).alias("credit")))


@R.add("j03_outcomes", _THEMED_CTE + f""", {q.parsed('themed', 'response_text')}
SELECT rtype AS response_type, CASE WHEN is_timeout THEN 'unanswered' WHEN rtype IN ('refusal', 'error') OR is_error THEN 'failed'
  ELSE 'graded' END AS outcome, count(*) AS n FROM parsed GROUP BY ALL""")
def _(spark, sf):
    rows = g.grade(themed(spark, sf), "response_text", "answer", "lenient", error="error_text",
                   unanswered=F.col("is_timeout"))
    outcome = F.coalesce(F.substring_index("graded.failure_reason", ":", 1), F.lit("graded"))
    return rows.groupBy("graded.response_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.add("j04_adaptive_thresholds", f"""
WITH themed AS (SELECT * REPLACE ({_THEMED} AS category) FROM questions)
SELECT question_id, round({_LIMIT}, 6) AS confidence_threshold, round(CASE WHEN contains(lower(category), 'history') THEN 0.75
  WHEN contains(lower(category), 'wordplay') THEN 0.85 ELSE 0.80 END, 6)::DOUBLE AS fuzzy_threshold FROM themed""")
def _(spark, sf):
    i = F.pmod(F.col("question_id"), F.lit(4))
    rows = v.questions(spark, sf).withColumn("category", F.when(i == 0, "World History").when(i == 1, "Wordplay")
                                             .when(i == 2, "JEOPARDY history").otherwise(F.col("category")))
    return rounded(g.adaptive_thresholds(rows).select("question_id", "confidence_threshold", "fuzzy_threshold"))


@R.add("j05_form_required", f"""
SELECT question_id, contains(lower({_THEMED}), 'jeopardy') OR question_id % 10 = 0 AS by_context, TRUE AS by_mode FROM questions""")
def _(spark, sf):
    i = F.pmod(F.col("question_id"), F.lit(4))
    theme = F.when(i == 0, "World History").when(i == 1, "Wordplay").when(i == 2, "JEOPARDY history").otherwise(F.col("category"))
    flag = F.when(F.col("question_id") % 10 == 0, "jeopardy")
    return v.questions(spark, sf).select(
        "question_id", g.form_required("lenient", theme, False, flag).alias("by_context"),
        g.form_required("jeopardy", theme).alias("by_mode"))


@R.add("j06_grade_batch_fuzzy", f"""WITH {q.parsed('responses', 'response_text')}, {q.matched('parsed', 'extracted', 'answer', "contains(lower(category), 'jeopardy')")},
m AS (SELECT *, rtype IN ('refusal', 'error') AS off FROM matched)
SELECT result_id, is_match AND conf >= 0.7 AND NOT off AS is_correct, round(CASE WHEN is_match AND conf >= 0.7 AND NOT off THEN conf ELSE 0 END, 6) AS score,
  round(CASE WHEN off THEN 0 ELSE {_CREDIT} END, 6) AS partial_credit, CASE WHEN off THEN 'exact' ELSE mtype END AS match_type FROM m""")
def _(spark, sf):
    rows = v.responses(spark, sf).select("result_id", "question_id", "response_text")
    q_ = v.questions(spark, sf).select("question_id", "answer", "category", "difficulty_level", "value")
    return rounded(g.grade_batch(rows, q_, "lenient").select(
        "result_id", "graded.is_correct", "graded.score", "graded.partial_credit", "graded.match_type"))


@R.add("j06b_grade_batch", f"""WITH {q.parsed('responses', 'response_text')}, {q.matched('parsed', 'extracted', 'answer')}
SELECT rtype AS response_type, CASE WHEN rtype IN ('refusal', 'error') THEN 'exact' ELSE mtype END AS match_type, count(*) AS n,
  count(*) FILTER (is_match AND conf >= 0.7 AND rtype NOT IN ('refusal', 'error')) AS correct,
  round(sum(CASE WHEN is_match AND conf >= 0.7 AND rtype NOT IN ('refusal', 'error') THEN conf ELSE 0 END), 4) AS score,
  round(sum(CASE WHEN rtype IN ('refusal', 'error') THEN 0 ELSE {_CREDIT} END), 4) AS credit, round(avg(quality), 6) AS quality
FROM matched GROUP BY ALL""")
def _(spark, sf):
    rows = v.responses(spark, sf).select("result_id", "question_id", "response_text")
    q_ = v.questions(spark, sf).select("question_id", "answer", "category", "difficulty_level", "value")
    graded = g.grade_batch(rows, q_, "lenient")
    return graded.groupBy("graded.response_type", "graded.match_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("graded.is_correct").alias("correct"),
        F.round(F.sum("graded.score"), 4).alias("score"), F.round(F.sum("graded.partial_credit"), 4).alias("credit"),
        F.round(F.avg("graded.response_quality_score"), 6).alias("quality"))


_OUTCOME = f"""SELECT result_id, is_match AND conf >= 0.7 AND NOT off AS is_correct, round(CASE WHEN is_match AND conf >= 0.7 AND NOT off THEN conf ELSE 0 END, 6) AS score,
  round(CASE WHEN off THEN 0 ELSE {_CREDIT} END, 6) AS partial_credit, CASE WHEN off THEN 'exact' ELSE mtype END AS match_type"""


@R.add("j06c_grade_acceptable_answers", f"""WITH tagged AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM responses), {q.parsed('tagged', 'response_text')},
fan AS (SELECT *, 0 AS pos, answer AS acceptable FROM parsed UNION ALL SELECT *, 1, 'who is ' || substr(question, 1, 3) || substr(question, 5) FROM parsed
  UNION ALL SELECT *, 2, 'I don''t know' FROM parsed WHERE question_id % 3 = 0),
{q.matched('fan', 'extracted', 'acceptable', "contains(lower(category), 'jeopardy')")},
m AS (SELECT *, rtype IN ('refusal', 'error') AS off FROM matched QUALIFY row_number() OVER (PARTITION BY rid ORDER BY NOT is_match,
  CASE WHEN is_match THEN 0 ELSE -conf END, list_position(['exact', '{fv.QUESTION_TYPE}', 'number_date', 'abbreviation', 'fuzzy', 'semantic'], mtype), pos) = 1)
{_OUTCOME}, acceptable AS matched_against FROM m""")
def _(spark, sf):
    name = F.col("question")
    also = F.array(F.concat(F.lit("who is "), F.substring(name, 1, 3), F.substr(name, F.lit(5))),
                   F.when(F.pmod(F.col("question_id"), F.lit(3)) == 0, "I don't know"))
    rows = v.responses(spark, sf).withColumn("also", F.filter(also, lambda x: x.isNotNull()))
    graded = g.grade(rows, "response_text", "answer", "lenient", acceptable="also")
    return rounded(graded.select("result_id", "graded.is_correct", "graded.score", "graded.partial_credit", "graded.match_type", "matched_against"))


@R.add("j06d_grade_synonyms", f"""WITH {q.parsed('responses', 'response_text')},
{q.matched('parsed', 'extracted', 'answer', "contains(lower(category), 'jeopardy')", synonyms="(question_id % 11) / 10")},
m AS (SELECT *, rtype IN ('refusal', 'error') AS off FROM matched)
{_OUTCOME} FROM m""")
def _(spark, sf):
    rows = v.responses(spark, sf).withColumn("synonym", F.pmod(F.col("question_id"), F.lit(11)) / 10)
    graded = g.grade(rows, "response_text", "answer", "lenient", synonym_score="synonym")
    return rounded(graded.select("result_id", "graded.is_correct", "graded.score", "graded.partial_credit", "graded.match_type"))


@R.add("j07_results_projection", f"""WITH {q.parsed('responses', 'response_text')}, {q.matched('parsed', 'extracted', 'answer')},
scored AS (SELECT *, is_match AND conf >= 0.7 AND rtype NOT IN ('refusal', 'error') AS ok, CASE WHEN rtype IN ('refusal', 'error') THEN 0 ELSE conf END AS c FROM matched)
SELECT run_id, question_id, model_name, md5(response_text) AS response_md5, ok AS is_correct, round(c, 2) AS confidence_score,
  CAST(CASE WHEN ok THEN value ELSE -value END AS BIGINT) AS signed_score, CAST(latency_ms AS BIGINT) AS response_time_ms,
  tokens_output AS tokens_generated, round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd FROM scored""")
def _(spark, sf):
    rows = g.to_results(g.grade(v.responses(spark, sf).drop("is_correct"), "response_text", "answer", "lenient"))
    return rounded(rows.withColumn("response_text", F.md5("response_text")).withColumnRenamed("response_text", "response_md5"))
