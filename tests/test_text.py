import random
import time

import pytest
from pyspark.sql import functions as F

from quizspark.functions import match as mt, parse as ps, prompts as pr, similarity as si, text as tx
from quizspark.operators import grade as g


def test_normalize(values):
    assert values(["  The  Eiffel-Tower!! ", "Café, l'été (no. 1)", None, "a", "An apple", "x y"], tx.normalize_text) == [
        "eiffel-tower", "café l'été no 1", "", "a", "apple", "x y"]


def test_question_content(values):
    assert values(["what is gold", "who were the beatles", "why are we", "gold", "how is it"], tx.question_content) == [
        "gold", "the beatles", None, None, "it"]


def test_numbers_and_years(values):
    got = values(["paid $1,200.50 and 7", "in 1989 or 2031 or 3000", "none"], lambda c: F.array_sort(tx.extract_numbers(c)))
    assert got[0] == ["1", "1200.50", "200", "50", "7"] or "1200.50" in got[0]
    assert values(["in 1989 or 2031 or 3000", "19890"], tx.extract_years) == [["1989", "2031"], []]


def test_words(values):
    assert values(["Five and seventeen, oneness", "hundred"], tx.words_to_digits) == ["5 and 17, oneness", "100"]
    assert values(["usa and dc", "las"], tx.expand_abbreviations) == ["united states and washington washington d.c.", "las"]


@pytest.mark.parametrize("text,kind,answer", [
    ("", "error", ""), ("   ", "error", ""), ("What is gold?", "jeopardy_format", "What is gold?"),
    ("I believe the answer is What is gold", "jeopardy_format", "What is gold?"),
    ("What is gold. This is correct.", "jeopardy_format", "What is gold.?"),
    ("It is William Shakespeare.", "direct_answer", "William Shakespeare"),
    ("I think it's gold.", "uncertain", "I think it's gold"),
    ("I'm not sure, but possibly Paris?", "refusal", ""), ("I don't know the answer.", "refusal", ""),
    ("Paris because of the tower", "explanation", "Paris because of the tower")])
def test_parse(spark, text, kind, answer):
    row = ps.parse_responses(spark.createDataFrame([(text,)], "t string"), "t").first()["parsed"]
    assert (row["response_type"], row["extracted_answer"]) == (kind, answer)


def test_clean_quality_and_reasoning(spark, values):
    assert values(["  Answer:  Gold  ", "Final answer: X"], ps.clean_response) == ["Gold", "X"]
    df = spark.createDataFrame([("What is gold?",), ("I don't know",), ("maybe Rome",), ("ab",)], "t string")
    scores = [round(r[0], 6) for r in ps.parse_responses(df, "t").select("parsed.quality_score").collect()]
    assert scores == [1.0, 0.0, 0.9, 0.7]
    text = "Rome because it was the seat of power. Also since the forum stood there! ok"
    row = ps.parse_responses(spark.createDataFrame([(text,), ("x " * 25,), ("short",)], "t string"), "t").select("parsed.reasoning").collect()
    assert row[0][0] == "it was the seat of power.. the forum stood there!"
    assert row[1][0] == ("x " * 25).strip() and row[2][0] is None


def test_adapter_answer(values):
    assert values(["What is Paris?", "What is Paris. Yes", "Paris. It is", "line\nnext", " plain "], ps.adapter_answer) == [
        "What is Paris", "What is Paris?", "Paris", "line", "plain"]


CASES = [
    ("Paris", "What is Paris?", True), ("What is Paris?", "What is Paris?", True), ("What is Paaris?", "What is Paris?", True),
    ("What is London?", "What is Paris?", False), ("usa", "united states", True), ("in 1989", "1989", True),
    ("five", "5", False), ("42", "42 days", True), ("", "x", False), ("shakespeare william", "william shakespeare", True)]


def test_match_table(spark):
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(CASES)], "i int, a string, e string")
    got = {r["i"]: r["match"] for r in mt.match_answers(df, "a", "e").collect()}
    assert [got[i]["is_match"] for i in range(len(CASES))] == [m for _, _, m in CASES]
    assert got[0]["match_type"] == "jeopardy_format" and got[0]["confidence"] == 0.8
    assert got[3]["confidence"] >= 0.7 and got[4]["match_type"] == "abbreviation" and got[5]["match_type"] == "number_date"


def test_number_rule_counts_twice_unless_asked(spark):
    df = spark.createDataFrame([("42", "42 days")], "a string, e string")
    plain = mt.match_answers(df, "a", "e", fuzzy=False).first()["match"]
    fixed = mt.match_answers(df, "a", "e", fuzzy=False, count_distinct=True).first()["match"]
    assert (plain["is_match"], plain["confidence"]) == (False, 0.5) and (fixed["match_type"], fixed["is_match"]) == ("number_date", True)


def test_form_penalty(spark):
    df = spark.createDataFrame([("paris", "What is Paris?"), ("What is Paris?", "Paris")], "a string, e string")
    got = [r["match"]["confidence"] for r in mt.match_answers(df, "a", "e", True, fuzzy=False).collect()]
    assert got == [0.4, 0.9]


def test_match_alternatives(spark):
    df = spark.createDataFrame([(1, "NYC", "Big Apple", ["new york city", "gotham"]), (2, "rome", "Paris", None)],
                               "id int, a string, e string, alt array<string>")
    got = {r["id"]: r for r in mt.match_any(df, "a", "e", "alt").collect()}
    assert got[1]["match"]["is_match"] and got[1]["matched_against"] == "new york city" and not got[2]["match"]["is_match"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _ratio(a, b):
    n = max(len(a), len(b))
    return int(100 * (n - _distance(a, b)) / n + 0.5) if n else 100


def test_fuzzy_scores_against_definition(spark):
    pairs = [("paris", "paaris"), ("red widget", "widget red"), ("", "x"), ("abc", "abc"), ("new york mets", "new york mets vs braves"),
             ("a", None), ("straße café", "strasse cafe"), ("the red red dog", "dog the blue"), ("", ""), ("one two", "six")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", si.fuzzy_scores(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        if b is None:
            assert got[i] is None
            continue
        wa, wb = a.split(), b.split()
        few, many = (wa, wb) if len(wa) <= len(wb) else (wb, wa)
        shared = " ".join(sorted(set(wa) & set(wb)))
        left, right = (" ".join([shared, *sorted(set(x) - set(y))]).strip() for x, y in ((wa, wb), (wb, wa)))
        expected = (_ratio(a, b), max(_ratio(" ".join(many[k:k + len(few)]), " ".join(few)) for k in range(len(many) - len(few) + 1)) if few else 0,
                    _ratio(" ".join(sorted(wa)), " ".join(sorted(wb))), max(_ratio(shared, left), _ratio(shared, right), _ratio(left, right)) if wa and wb else 0)
        assert tuple(got[i])[:4] == expected and got[i]["best"] == max(expected)


def test_synonyms(spark):
    rows = spark.createDataFrame([(1, ["car", "fast"], ["auto", "fast"]), (2, ["tree"], ["auto"]), (3, [], ["auto"])],
                                 "id int, ta array<string>, te array<string>")
    synonyms = spark.createDataFrame([("car", "auto", 0.9), ("car", "van", 0.99)], "token_a string, token_b string, sim double")
    got = {r["id"]: round(r["synonym_score"], 6) for r in mt.synonym_similarity(rows, "id", "ta", "te", synonyms).collect()}
    assert got == {1: 0.95, 2: 0.0, 3: 0.0}


def test_prompt_lines(spark):
    df = spark.createDataFrame([("Clue text", "ART", None), ("Clue text", "", None)], "q string, c string, v string")
    got = [r[0] for r in df.select(pr.build_prompt(F.col("q"), F.col("c"), F.col("v"), template="basic_qa")).collect()]
    head = "You are an expert quiz contestant. Answer the question accurately and concisely.\n"
    assert got == [head + "\nCategory: ART\n\nQuestion: Clue text\n\nAnswer:", head + "\nQuestion: Clue text\n\nAnswer:"]


@pytest.mark.parametrize("mode,right,score", [("strict", False, 0.0), ("lenient", True, 0.8), ("jeopardy", False, 0.2), ("adaptive", True, 0.8)])
def test_grading_modes(spark, mode, right, score):
    df = spark.createDataFrame([("Paris", "What is Paris?", "ART", "Medium", 500)], "r string, e string, category string, difficulty_level string, value int")
    got = g.grade(df, "r", "e", mode, fuzzy=False).first()["graded"]
    assert (got["is_correct"], round(got["score"], 6)) == (right, score)


def test_outcomes(spark):
    df = spark.createDataFrame([("sorry", None, False), ("Paris", "boom", False), ("Paris", None, True), ("Paris", None, False)],
                               "r string, err string, skip boolean").withColumn("e", F.lit("Paris"))
    got = [r["graded"]["is_correct"] for r in g.grade(df, "r", "e", "lenient", error="err", unanswered=F.col("skip")).collect()]
    assert got == [False, False, None, True]


def test_apply_model_keeps_failures(spark):
    def ask(prompt):
        if prompt == "bad":
            raise RuntimeError("no quota")
        return {"response_text": prompt.upper(), "latency_ms": 5, "tokens_used": 2, "cost_usd": 0.1}
    rows = g.apply_model(spark.createDataFrame([(1, "hi"), (2, "bad")], "question_id bigint, prompt string"), ask).orderBy("question_id").collect()
    assert rows[0]["response_text"] == "HI" and rows[1]["error"] == "no quota" and rows[1]["response_text"] == ""


def test_long_texts_have_bounded_work(spark):
    rng = random.Random(3)
    def long(n):
        return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    b = long(400)
    rows = [(1, long(800), b), (2, long(200) + " " + b + " " + long(200), b)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    started = time.time()
    got = {r["i"]: r for r in df.select("i", si.best_score(F.col("a"), F.col("b")).alias("best"), si.fuzzy_scores(F.col("a"), F.col("b")).alias("s")).collect()}
    assert time.time() - started < 60
    assert got[2]["best"] == got[2]["s"]["partial_ratio"] == 100 and got[1]["best"] == got[1]["s"]["best"] < 50


def test_best_score_equals_best_of_all(spark):
    rng = random.Random(4)
    rows = [(i, *[" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 6))) for _ in "ab"]) for i in range(300)]
    df = spark.createDataFrame([*rows, (999, None, "a"), (998, "a", None)], "i int, a string, b string")
    for r in df.select(si.best_score(F.col("a"), F.col("b")).alias("best"), si.fuzzy_scores(F.col("a"), F.col("b"))["best"].alias("all")).collect():
        assert r["best"] == r["all"]


def test_lists_of_answers_are_folded_in_the_row(spark):
    df = spark.createDataFrame([(None, "rome", "paris", ["x", "Rome!"]), (None, "rome", "paris", None), (1, "rome", "rome", [])], "id int, a string, e string, alt array<string>")
    out = mt.match_any(df, "a", "e", "alt")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == [*df.columns, "match", "matched_against"]
    assert sorted((str(r["id"]), r["match"]["is_match"], r["matched_against"]) for r in out.collect()) == [
        ("1", True, "rome"), ("None", False, "paris"), ("None", True, "Rome!")]


def test_synonyms_of_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, ["a"], ["b"]), (1, ["z"], ["q"]), (None, ["a"], ["b"]), (None, None, ["b"]), (2, ["a", "a", "b"], ["b", "c"])],
                                 "id int, ta array<string>, te array<string>")
    synonyms = spark.createDataFrame([("a", "b", 0.5), ("a", "b", 0.4), ("a", "c", 0.75), ("z", "x", 1.0)], "token_a string, token_b string, sim double")
    out = mt.synonym_similarity(rows, "id", "ta", "te", synonyms)
    assert out.columns == ["id", "ta", "te", "synonym_score"]
    assert sorted((str(r["id"]), round(r["synonym_score"], 6)) for r in out.collect()) == [
        ("1", 0.0), ("1", 0.5), ("2", round(2.5 / 3, 6)), ("None", 0.0), ("None", 0.5)]


def test_question_starters_in_list_order(spark):
    df = spark.createDataFrame([("So how was it? And somewhat  is odd. Who is there",), ("none",), ("WHY IS it so! what were they",)], "c string")
    assert [r[0] for r in df.select(ps.question_hit(F.col("c"))).collect()] == ["what  is odd.", None, "WHY IS it so!"]


def test_rows_carry_only_what_later_steps_read():
    from quizspark.plans.stages import _kept
    steps = [lambda x: {"p": x("a") + x("b")}, lambda x: {"q": x("p") * 2}, lambda x: {"r": x("q") + x("a")}]
    assert _kept(steps, "r") == [["a", "p"], ["a", "q"], ["r"]]


def test_text_expressions_run_without_functions_on_elements(spark):
    """Functions on array elements are interpreted row by row; the expressions every row goes through have none."""
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    for made in (tx.normalize_text(F.col("a")), tx.meaningful_tokens(F.col("a")), tx.extract_numbers(F.col("a")), ps.phrases_found(F.col("a"), ["x", "y"]),
                 si.better_ratio(F.col("a"), F.col("b"), F.lit(3))):
        assert "lambda" not in df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_later_answers_only_for_better_strategies(spark):
    rows = [("paris france", "paaris france", ["what is paris france", "paris france", "x"]), ("in 1989", "1989", ["nineteen", "in 1989"]),
            ("gold", "silver", ["copper", "gould"]), ("", "x", [""]), ("gold", "gold", [None, "gold"]), ("gold", "silver", None)]
    df = spark.createDataFrame(rows, "a string, e string, also array<string>")
    for r in mt.match_any(df, "a", "e", "also").collect():
        each = [(x, mt.match_answers(spark.createDataFrame([(r["a"], x)], "a string, e string"), "a", "e").first()["match"]) for x in [r["e"], *(r["also"] or [])]]
        want = min(enumerate(each), key=lambda p: (not p[1][1]["is_match"], 0 if p[1][1]["is_match"] else -p[1][1]["confidence"],
                                                   mt._ORDER.index(p[1][1]["match_type"]), p[0]))[1]
        assert (r["matched_against"], r["match"]) == want
