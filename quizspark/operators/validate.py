"""Validation rules, audits and automatic fixes for question tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quizspark import fixed_values as fv
from quizspark.functions import text as tx
from quizspark.plans.storage import written

_TAG = "<[^>]+>"
_GAPS = tx.WS + "{3,}"
MSG = fv.ISSUE_TEXTS
FIELDS = ("question", "answer", "category", "value", "air_date", "difficulty_level")


class ValidationError(ValueError):
    """The table breaks a rule that makes it unusable."""


def _issues(*tests: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(test, F.lit(text) if isinstance(text, str) else text) for test, text in tests]))


def _filled(name: str, x: Column) -> Column:
    """An issue's text with a number or a name in its place."""
    return F.replace(F.lit(MSG[name]), F.lit("{x}"), x.cast("string"))


def _empty(c: Column) -> Column:
    return F.coalesce(F.length(c) == 0, F.lit(True))


class Rule(NamedTuple):
    """The tests of a field with the text of each. Where ``alone`` holds its text is the only issue; where ``absent`` holds there is none."""

    tests: list[tuple[Column, str | Column]]
    alone: tuple[Column, str | Column] | None = None
    absent: Column | None = None

    def issues(self) -> Column:
        out = _issues(*self.tests)
        if self.alone:
            out = F.when(self.alone[0], _issues(self.alone)).otherwise(out)
        return out if self.absent is None else F.when(self.absent, F.array().cast("array<string>")).otherwise(out)

    def broken(self) -> Column:
        """Whether there is an issue; no text is built."""
        out = reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test, _ in self.tests])
        if self.alone:
            out = F.coalesce(self.alone[0], F.lit(False)) | out
        return out if self.absent is None else ~self.absent & out


def question_rule(c: Column, strict: bool = False) -> Rule:
    q = tx.strip(c)
    n = F.length(q)
    closed = q.rlike(r"[.?!]$") | q.rlike(r"^'.*'$|^'$") | q.rlike(r'^".*"$|^"$')
    tests = [
        (n < 10, _filled("question_short", n)),
        (n > 500, _filled("question_long", n)),
        (~closed, MSG["question_end"]),
        (q.rlike(_TAG), MSG["question_html"]),
        (q.rlike(_GAPS), MSG["question_gaps"])]
    if strict:
        marks = n - F.length(F.replace(q, F.lit("?"), F.lit("")))
        tests += [(marks > 1, MSG["question_marks"]),
                  (~q.rlike(r"(?Ui)\b(?:this|these|it|he|she)\b"),
                   MSG["question_style"])]
    return Rule(tests, (_empty(c), MSG["question_empty"]))


def answer_rule(c: Column, strict: bool = False) -> Rule:
    a = tx.strip(c)
    n = F.length(a)
    tests = [
        (n < 1, MSG["answer_blank"]),
        (n > 200, _filled("answer_long", n)),
        (a.rlike(_TAG), MSG["answer_html"]),
        (a.rlike(_GAPS), MSG["answer_gaps"])]
    if strict:
        low = F.lower(a)
        tests.append((low.rlike("what is|who is|where is|when is")
                      & ~low.rlike("^(what|who|where|when|how) (is|are|was|were)"),
                      MSG["answer_style"]))
    return Rule(tests, (_empty(c), MSG["answer_empty"]))


def category_rule(c: Column, strict: bool = False, allow_custom: bool = True) -> Rule:
    k = tx.strip(c)
    n = F.length(k)
    tests = [
        (n < 2, _filled("category_short", n)),
        (n > 50, _filled("category_long", n)),
        (~k.rlike(r"""^[A-Za-z0-9\s&\-.!?'"]+$"""), MSG["category_chars"])]
    if strict and not allow_custom:
        tests.append((~F.upper(k).isin(fv.KNOWN_CATEGORIES),
                      _filled("category_unknown", k)))
    return Rule(tests, (_empty(c), MSG["category_empty"]))


def value_rule(c: Column, strict: bool = False, era: str = "all") -> Rule:
    shown = c.cast("string")
    v = F.trim(shown).try_cast("bigint")
    allowed = fv.ERA_VALUES.get(era, fv.ERA_VALUES["all"])
    tests = [
        (v <= 0, _filled("value_low", v)),
        (v > 10000, _filled("value_high", v))]
    if strict:
        tests.append((~v.isin(allowed), F.concat(
            F.lit("Value "), v.cast("string"), F.lit(f" not in valid set for era '{era}': {allowed}"))))
    return Rule(tests, (v.isNull(), _filled("value_type", shown)), c.isNull())


def date_rule(c: Column, as_of: str) -> Rule:
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(tx.strip(c.cast("string")), F.lit(f)))
                       for f in ["yyyy-M-d", "yyyy-M-d H:m:s", "M/d/yyyy", "MMMM d, yyyy"]])
    shown = day.cast("string")
    tests = [(day < F.lit(fv.EARLIEST_AIR_DATE).cast("date"), _filled("date_early", shown)),
             (day > F.lit(as_of).cast("date"), _filled("date_late", shown))]
    return Rule(tests, (day.isNull(), MSG["date_format"]), c.isNull())


def difficulty_rule(c: Column) -> Rule:
    return Rule([(~c.isin(fv.DIFFICULTY_LEVELS), F.concat(F.lit("Difficulty '"), c, F.lit(f"' not in valid levels: {fv.DIFFICULTY_LEVELS}")))], absent=c.isNull())


def question_issues(c: Column, strict: bool = False) -> Column:
    return question_rule(c, strict).issues()


def answer_issues(c: Column, strict: bool = False) -> Column:
    return answer_rule(c, strict).issues()


def category_issues(c: Column, strict: bool = False, allow_custom: bool = True) -> Column:
    return category_rule(c, strict, allow_custom).issues()


def value_issues(c: Column, strict: bool = False, era: str = "all") -> Column:
    return value_rule(c, strict, era).issues()


def date_issues(c: Column, as_of: str) -> Column:
    return date_rule(c, as_of).issues()


def difficulty_issues(c: Column) -> Column:
    return difficulty_rule(c).issues()


def _rules(df: DataFrame, as_of: str, strict: bool) -> tuple[dict[str, Rule], list[str]]:
    """The rule of each present field, and the fields whose issues make a question invalid."""
    of = {"question": lambda c: question_rule(c, strict), "answer": lambda c: answer_rule(c, strict),
          "category": lambda c: category_rule(c, strict), "value": lambda c: value_rule(c, strict),
          "air_date": lambda c: date_rule(c, as_of), "difficulty_level": difficulty_rule}
    rules = {f: of[f](F.col(f)) for f in FIELDS if f in df.columns}
    return rules, [f for f in rules if f in ("question", "answer") or (strict and f in ("category", "value"))]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def with_issues(df: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Add one ``<field>_issues`` list per present field and ``is_valid``.

    Category and value issues are fatal in strict mode only; date and difficulty issues never are.
    """
    rules, fatal = _rules(df, as_of, strict)
    out = df.withColumns({f"{f}_issues": rule.issues() for f, rule in rules.items()})
    return out.withColumn("is_valid", _all([F.size(f"{f}_issues") == 0 for f in fatal]))


def field_report(df: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """Valid and invalid rows per field, with the total and the number of valid questions."""
    rules, fatal = _rules(df, as_of, strict)
    present = list(rules)
    checked = df.select(*[rule.broken().alias(f) for f, rule in rules.items()])
    counts = checked.agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if(_all([~F.col(f) for f in fatal])).alias("valid_questions"),
        *[F.count_if(~F.col(f)).alias(f) for f in present])
    return counts.unpivot(["total_questions", "valid_questions"], present, "field", "valid").select(
        "field", "valid", (F.col("total_questions") - F.col("valid")).alias("invalid"),
        "total_questions", "valid_questions")


def issue_rows(df: DataFrame, as_of: str, id_col: str = "question_id", strict: bool = False) -> DataFrame:
    """One row per fatal issue of an invalid question."""
    checked = with_issues(df, as_of, strict).where(~F.col("is_valid"))
    fields = [f for f in FIELDS[:4] if f in df.columns][: 4 if strict else 2]

    def labelled(field: str) -> Column:
        return F.transform(f"{field}_issues", lambda x: F.struct(F.lit(field).alias("field"), x.alias("issue")))
    listed = F.concat(*[labelled(f) for f in fields])
    return checked.select(id_col, F.explode(listed).alias("i")).select(id_col, "i.field", "i.issue")


def flag_duplicates(df: DataFrame, text_col: str = "question", id_col: str = "question_id") -> DataFrame:
    """Mark every row whose text already occurs under a smaller id; blank texts are never duplicates.

    Texts are counted by a 64-bit hash first. Only rows whose hash occurs twice are digested; the first id per digest is a map-side minimum, written with one row per
    repeated hash. Rows look theirs up by hash, so a table without repeats passes in the scan, and texts are shuffled only where repeats are too many to broadcast.
    ``first_id`` is the smallest id of the text, NULL for blank texts; NULL ids are first to none.
    """
    text = F.col(text_col)
    filled = df.where(~_empty(text))
    again = filled.groupBy(F.xxhash64(text).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_hash")
    again = written(again, "repeated-texts")
    first = (filled.select(text.alias("_text"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash")).join(again, "_hash")
             .groupBy("_hash", F.sha2("_text", 256).alias("_digest")).agg(F.min("_id").alias("_id"))
             .groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct("_digest", "_id"))).alias("_first")))
    first = written(first, "first-ids")
    hashed = df.withColumn("_hash", F.when(~_empty(text), F.xxhash64(text)))
    first_id = F.when(F.col("_first").isNotNull(), F.try_element_at("_first", F.sha2(text, 256))).when(F.col("_hash").isNotNull(), F.col(id_col))
    return (hashed.join(first, "_hash", "left").withColumn("first_id", first_id)
            .withColumn("is_duplicate", F.coalesce(F.col(id_col) != F.col("first_id"), F.lit(False))).drop("_hash", "_first"))


def audit(df: DataFrame) -> DataFrame:
    """Five checks with the number of issues and passes: missing data, format, category, value,
    duplicates. One aggregation over the rows plus a count of distinct text digests."""
    q, a, c, v = (F.col(x) for x in ("question", "answer", "category", "value"))
    missing = _empty(q) | _empty(a) | _empty(c)
    qi, ai = question_rule(q).broken(), answer_rule(a).broken()
    ci, vi = category_rule(c).broken(), value_rule(v).broken()
    has_q, has_a, has_c, has_v = ~_empty(q), ~_empty(a), ~_empty(c), v.isNotNull()

    def n(test: Column) -> Column:
        return F.count_if(test)
    row = df.agg(
        n(missing).alias("m_bad"), n(~missing).alias("m_ok"),
        (n(has_q & qi) + n(has_a & ai)).alias("f_bad"), (n(has_q & ~qi) + n(has_a & ~ai)).alias("f_ok"),
        n(has_c & ci).alias("c_bad"), n(has_c & ~ci).alias("c_ok"),
        n(has_v & vi).alias("v_bad"), n(has_v & ~vi).alias("v_ok"), n(has_q).alias("texts"))
    distinct = (df.where(has_q).select(F.sha2(q, 256).alias("d")).distinct()
                .agg(F.count(F.lit(1)).alias("d")))
    checks = [("missing_data", "m_bad", "m_ok"), ("format_validation", "f_bad", "f_ok"),
              ("category_consistency", "c_bad", "c_ok"), ("value_range_validation", "v_bad", "v_ok")]
    structs = [F.struct(F.lit(name).alias("check_name"), F.col(bad).alias("issues"), F.col(ok).alias("passed_count"))
               for name, bad, ok in checks]
    unique = distinct.select("d").scalar()
    structs.append(F.struct(F.lit("duplicate_detection").alias("check_name"),
                            (F.col("texts") - unique).alias("issues"), unique.alias("passed_count")))
    return (row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
            .withColumn("passed", F.col("issues") == 0))


def auto_fix(df: DataFrame) -> DataFrame:
    """Rows that trimming, closing wide gaps and upper-casing the category would change, fixed."""
    def tidy(name: str) -> Column:
        c = F.col(name)
        return F.when(_empty(c), c).otherwise(F.regexp_replace(tx.strip(c), _GAPS, " "))
    fixed = {"question": tidy("question"), "answer": tidy("answer"),
             "category": F.when(_empty(F.col("category")), F.col("category"))
             .otherwise(F.upper(tx.strip(F.col("category"))))}
    changed = F.lit(False)
    for name, c in fixed.items():
        changed = changed | ~c.eqNullSafe(F.col(name))
    return df.where(changed).withColumns(fixed)


def schema_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with trimmed texts, rejected rows with a reason) under the strict schema.

    Raises when there is no valid row, also for an empty table.
    """
    gone = [c for c in ("question", "answer") if c not in df.columns]
    if gone:
        raise ValidationError(f"missing required columns: {gone}")
    q, a = tx.strip(F.col("question")), tx.strip(F.col("answer"))
    tests = [(F.coalesce(F.length(q) < 10, F.lit(True)), "question: must be at least 10 characters long"),
             (F.coalesce(F.length(a) < 1, F.lit(True)), "answer: cannot be empty")]
    if "value" in df.columns:
        whole = F.trim(F.col("value").cast("string")).try_cast("bigint")
        tests += [(F.col("value").isNotNull() & whole.isNull(), "value: not a whole number"),
                  (whole < 0, "value: must be non-negative")]
    if "difficulty_level" in df.columns:
        tests.append((~F.col("difficulty_level").isin(fv.DIFFICULTY_LEVELS), "difficulty_level: unknown level"))
    judged = df.withColumn("rejected_because", F.array_join(_issues(*tests), "; "))
    good = (judged.where(F.col("rejected_because") == "").drop("rejected_because")
            .withColumn("question", q).withColumn("answer", a))
    if good.isEmpty():
        raise ValidationError("no row is valid")
    return good, judged.where(F.col("rejected_because") != "")


def require_quality(df: DataFrame, as_of: str, strict: bool = True, minimum: float = 80.0) -> DataFrame:
    """Raise when fewer than ``minimum`` percent of the rows are valid in strict mode."""
    rules, fatal = _rules(df, as_of, strict)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(_all([~rules[f].broken() for f in fatal])).alias("ok")).first()
    rate = row["ok"] * 100.0 / row["n"] if row["n"] else 0.0
    if strict and rate < minimum:
        raise ValidationError(f"only {rate:.1f}% of the questions are valid, {minimum:.0f}% are required")
    return df
