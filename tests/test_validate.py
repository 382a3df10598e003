import pytest
from pyspark.sql import functions as F

from quizspark.operators import validate as val


def test_question_rules(values):
    got = values(["This is a fine question.", "Short", "", None, "x" * 501 + ".", "Tag <b>here</b> in text.", "too   many   blanks.",
                  "'quoted clue here'", "no end mark here"], val.question_issues)
    assert got[0] == [] and len(got[1]) == 2 and got[1][0] == "Question too short (5 chars, minimum 10)"
    assert got[2] == got[3] == ["Question is empty or not a string"] and "too long (502" in got[4][0]
    assert got[5] == ["Question contains HTML tags"] and got[6] == ["Question contains excessive whitespace"]
    assert got[7] == [] and got[8] == ["Question should end with proper punctuation or be properly quoted"]


def test_value_and_date_rules(values):
    got = values(["200", None, "abc", "-5", "20000", "250"], lambda c: F.size(val.value_issues(c, True)))
    assert got == [0, 0, 1, 2, 2, 1]
    got = values(["2020-01-01", None, "nope", "1950-01-01", "2025-01-02"], lambda c: val.date_issues(c, "2025-01-01"))
    assert [len(x) for x in got] == [0, 0, 1, 1, 1] and "future" in got[4][0]


def test_category_rules(values):
    got = values(["FOOD & DRINK", "A", "bad_chars", None, "Cooking"], lambda c: F.size(val.category_issues(c, True, False)))
    assert got == [0, 2, 2, 1, 1]


@pytest.fixture
def mixed(spark):
    return spark.createDataFrame([
        (1, "This is a valid question.", "Good", "ART", "200", "2020-01-01", "Easy"),
        (2, "Short", "Good", "ART", "-1", "1950-01-01", "Odd"), (3, "This is a valid question.", "", "a_b", "x", None, None)],
        "question_id int, question string, answer string, category string, value string, air_date string, difficulty_level string")


def test_report_and_audit(mixed):
    got = {r["field"]: (r["valid"], r["invalid"], r["valid_questions"]) for r in val.field_report(mixed, "2025-01-01").collect()}
    assert got["question"] == (2, 1, 1) and got["category"] == (2, 1, 1) and got["difficulty_level"] == (2, 1, 1)
    audit = {r["check_name"]: (r["issues"], r["passed_count"], r["passed"]) for r in val.audit(mixed).collect()}
    assert audit == {"missing_data": (1, 2, False), "format_validation": (1, 4, False), "category_consistency": (1, 2, False),
                     "value_range_validation": (2, 1, False), "duplicate_detection": (1, 2, False)}
    assert {r["field"] for r in val.issue_rows(mixed, "2025-01-01").collect()} == {"question", "answer"}


def test_broken_agrees_with_issues(values):
    texts = ["This is a fine question.", "Short", "", None, " ", "x" * 501 + ".", "Tag <b>a</b> in it.", "a_b", "A", "12", "-5", "20000", "abc",
             "2020-01-01", "1950-01-01", "2030-01-01", "Easy", "Odd", "what is", "so what is it"]
    for rule in (lambda c: val.question_rule(c, True), lambda c: val.answer_rule(c, True), lambda c: val.category_rule(c, True, False),
                 lambda c: val.value_rule(c, True), lambda c: val.date_rule(c, "2025-01-01"), val.difficulty_rule):
        assert values(texts, lambda c: rule(c).broken()) == [bool(x) for x in values(texts, lambda c: rule(c).issues())]


def test_fix_split_and_gate(mixed, spark):
    fixed = val.auto_fix(spark.createDataFrame([(1, "a    b", "x", "art "), (2, "ok", "ok", "ART")],
                                               "question_id int, question string, answer string, category string")).collect()
    assert [(r["question"], r["category"]) for r in fixed] == [("a b", "ART")]
    good, bad = val.schema_split(mixed)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(val.ValidationError):
        val.require_quality(mixed, "2025-01-01")
    with pytest.raises(val.ValidationError):
        val.schema_split(mixed.drop("answer"))


def test_schema_split_needs_a_valid_row(spark):
    for rows in ([], [("short", "x")]):
        with pytest.raises(val.ValidationError):
            val.schema_split(spark.createDataFrame(rows, "question string, answer string"))
