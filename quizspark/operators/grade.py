"""Grading responses: parse, match, decide, score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quizspark import fixed_values as fv
from quizspark.functions.labels import signed_score
from quizspark.functions.match import match_answers, match_any
from quizspark.functions.parse import parse_responses

MODES = ("strict", "lenient", "jeopardy", "adaptive")


def adaptive_thresholds(df: DataFrame) -> DataFrame:
    """Confidence and fuzzy thresholds from category, difficulty and value."""
    cat = F.lower(F.coalesce("category", F.lit("")))
    level = F.lower(F.coalesce("difficulty_level", F.lit("")))
    value = F.coalesce("value", F.lit(0))
    factual = cat.contains("science") | cat.contains("history")
    wordplay = cat.contains("wordplay") | cat.contains("language")
    base = F.when(factual, 0.65).when(wordplay, 0.80).otherwise(fv.CONFIDENCE_THRESHOLD)
    factor = (F.when((level == "hard") | (value > 1000), 0.9)
              .when((level == "easy") | (value < 400), 1.1).otherwise(1.0))
    return (df.withColumn("confidence_threshold", base * factor)
            .withColumn("fuzzy_threshold", F.when(factual, 0.75).when(wordplay, 0.85)
                        .otherwise(fv.FUZZY_THRESHOLD)))


def form_required(mode: str, category: Column | None, required: bool = False,
                  format_flag: Column | None = None) -> Column:
    """Whether an answer must be a question: by mode, or by the question's category or format."""
    base = F.lit(True) if mode == "jeopardy" else F.lit(False if mode == "strict" else required)
    if category is not None:
        base = base | F.coalesce(F.contains(F.lower(category), F.lit("jeopardy")), F.lit(False))
    if format_flag is not None:
        base = base | F.coalesce(format_flag == "jeopardy", F.lit(False))
    return base


def partial_credit(confidence: Column, is_match: Column, enabled: bool = True) -> Column:
    if not enabled:
        return F.when(is_match, 1.0).otherwise(0.0)
    (top, full), *rest = fv.CREDIT_TIERS
    tiers = F.when(confidence >= top, F.lit(full))
    for at, credit in rest:
        tiers = tiers.when(confidence >= at, F.lit(credit))
    return tiers.otherwise(0.0)


def decide(mode: str, match: Column, parsed: Column, threshold: Column) -> tuple[Column, Column]:
    """(is_correct, score) of a matched, answerable response."""
    hit, conf = match["is_match"], match["confidence"]
    in_form = parsed["response_type"] == fv.QUESTION_TYPE
    if mode == "strict":
        right = hit & (match["match_type"] == "exact")
        return right, F.when(right, 1.0).otherwise(0.0)
    if mode == "lenient":
        right = hit & (conf >= threshold)
        return right, F.when(right, conf).otherwise(0.0)
    if mode == "jeopardy":
        return hit & in_form & (conf >= threshold), conf * F.when(in_form, 1.0).otherwise(0.5)
    if mode == "adaptive":
        eased = F.when(F.size(parsed["confidence_indicators"]) > 0, threshold * 0.9).otherwise(threshold)
        return hit & (conf >= eased), conf
    raise ValueError(f"unknown mode {mode!r}; choose from {MODES}")


def grade(df: DataFrame, response: str, expected: str, mode: str = "lenient", fuzzy: bool = True,
          required: bool = False, partial: bool = True, threshold: Column | float | None = None,
          fuzzy_threshold: Column | float | None = None, error: str | None = None,
          unanswered: Column | None = None, with_reasoning: bool = False, acceptable: str | None = None,
          synonym_score: str | None = None) -> DataFrame:
    """Add ``parsed``, ``match`` and ``graded`` structs to rows of response and expected answer.

    ``acceptable`` names a column with a list of further right answers, the best of which counts; ``matched_against`` tells which.
    ``synonym_score`` names a column with the similarity of meaning that ``match.synonym_similarity`` computes.

    Refusals, errors and rows with an ``error`` are wrong with score 0. Rows where ``unanswered``
    holds (a rate limit, for example) have ``is_correct`` NULL. In adaptive mode the thresholds come
    from category, difficulty and value unless given. One projection, unless there are lists of answers.
    """
    out = parse_responses(df, response, with_reasoning)
    columns = set(df.columns)
    if mode == "adaptive" and threshold is None and {"category", "difficulty_level", "value"} <= columns:
        out = adaptive_thresholds(out)
        threshold, fuzzy_threshold = F.col("confidence_threshold"), F.col("fuzzy_threshold")
    limit = F.lit(fv.CONFIDENCE_THRESHOLD) if threshold is None else (
        threshold if isinstance(threshold, Column) else F.lit(threshold))
    needs_form = form_required(mode, F.col("category") if "category" in columns else None, required,
                               F.col("format") if "format" in columns else None)
    out = out.withColumn("_answer", F.col("parsed.extracted_answer"))
    options = {"form_required": needs_form, "fuzzy": fuzzy, "synonym_score": synonym_score,
               "fuzzy_threshold": fv.FUZZY_THRESHOLD if fuzzy_threshold is None else fuzzy_threshold}
    out = (match_answers(out, "_answer", expected, **options) if acceptable is None
           else match_any(out, "_answer", expected, acceptable, **options))
    parsed, match = F.col("parsed"), F.col("match")
    right, score = decide(mode, match, parsed, limit)
    failed = parsed["response_type"].isin("refusal", "error")
    if error is not None:
        failed = failed | F.col(error).isNotNull()
    skipped = F.lit(False) if unanswered is None else F.coalesce(unanswered, F.lit(False))
    off = failed | skipped
    graded = F.struct(
        F.when(skipped, F.lit(None).cast("boolean")).when(failed, F.lit(False)).otherwise(right)
        .alias("is_correct"),
        F.when(off, 0.0).otherwise(score).alias("score"),
        F.when(off, 0.0).otherwise(match["confidence"]).alias("confidence"),
        F.when(off, 0.0).otherwise(partial_credit(match["confidence"], match["is_match"], partial))
        .alias("partial_credit"),
        F.when(off, "exact").otherwise(match["match_type"]).alias("match_type"),
        parsed["response_type"].alias("response_type"), F.lit(mode).alias("grading_mode"),
        limit.alias("confidence_threshold"), F.lit(partial).alias("partial_credit_enabled"),
        parsed["quality_score"].alias("response_quality_score"),
        parsed["reasoning"].isNotNull().alias("has_reasoning"),
        F.when(skipped, "unanswered").when(failed, F.concat(F.lit("failed: "), parsed["response_type"]))
        .alias("failure_reason"))
    return out.withColumn("graded", graded).drop("_answer", "confidence_threshold", "fuzzy_threshold")


def grade_batch(responses: DataFrame, questions: DataFrame, mode: str = "lenient", **options) -> DataFrame:
    """Join responses to their questions by id and grade them; one shuffle at most."""
    joined = responses.join(questions, "question_id")
    return grade(joined, "response_text", "answer", mode, **options)


def to_results(graded: DataFrame) -> DataFrame:
    """benchmark_results rows from graded rows: signed score, latency, tokens, cost."""
    g = F.col("graded")
    return graded.select(
        "run_id", "question_id", "model_name", "response_text", g["is_correct"].alias("is_correct"),
        g["confidence"].cast("decimal(3,2)").alias("confidence_score"),
        signed_score(g["is_correct"], F.coalesce("value", F.lit(fv.DEFAULT_QUESTION_VALUE)))
        .alias("signed_score"),
        F.coalesce("latency_ms", F.lit(0)).alias("response_time_ms"),
        F.coalesce("tokens_output", F.lit(0)).alias("tokens_generated"),
        F.coalesce(F.col("cost_usd").cast("decimal(10,6)"), F.lit(0).cast("decimal(10,6)")).alias("cost_usd"))


RESPONSE_SCHEMA = ("question_id bigint, prompt string, response_text string, latency_ms double, "
                   "tokens_used bigint, cost_usd double, error string")


def apply_model(prompts: DataFrame, ask: Callable[[str], dict], schema: str = RESPONSE_SCHEMA) -> DataFrame:
    """One response row per prompt row, from a callable run inside the tasks.

    ``ask(prompt)`` returns a dict with response_text, latency_ms, tokens_used, cost_usd. A failed call
    becomes an empty response with the error text; no row is lost. The callable must be safe to
    repeat, because tasks may be.
    """
    def one(question_id, prompt) -> tuple:
        try:
            r = ask(prompt)
            return (question_id, prompt, r.get("response_text", ""), float(r.get("latency_ms", 0.0)),
                    int(r.get("tokens_used", 0)), float(r.get("cost_usd", 0.0)), None)
        except Exception as e:  # noqa: BLE001 - any failure of a user's model is data here
            return question_id, prompt, "", 0.0, 0, 0.0, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["question_id", "prompt", "response_text", "latency_ms", "tokens_used", "cost_usd", "error"]
        for batch in batches:
            yield pd.DataFrame([one(i, p) for i, p in zip(batch["question_id"], batch["prompt"])],
                               columns=names)
    return prompts.select("question_id", "prompt").mapInPandas(run, schema)
