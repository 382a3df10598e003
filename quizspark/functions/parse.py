"""Reading free-text model responses: type, answer, reasoning and quality, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quizspark import fixed_values as fv
from quizspark.functions import text as tx

WORDS_ALT = "|".join(fv.QUESTION_WORDS)
VERBS_ALT = "|".join(fv.QUESTION_VERBS)
FORM_ANYWHERE = rf"(?i)(?:{WORDS_ALT})\s+(?:{VERBS_ALT})\s+"


def clean_response(c: Column) -> Column:
    """Collapse white space and drop lead-ins such as "Answer:"."""
    return without_prefixes(tx.collapse(c))


def without_prefixes(flat: Column) -> Column:
    """Collapsed text without lead-ins; a text that none of them fits is not gone through one by one."""
    cut = reduce(lambda acc, p: F.regexp_replace(acc, "(?i)" + p, ""), fv.ANSWER_PREFIXES, flat)
    fits = flat.contains(":") & flat.rlike("(?i)" + "|".join(f"(?:{p})" for p in fv.ANSWER_PREFIXES))  # every lead-in has a colon
    return F.trim(F.when(fits, cut).otherwise(flat))


def is_blank(c: Column) -> Column:
    return c.isNull() | tx.is_empty(c)


def has_question_form(low: Column) -> Column:
    """Whether cleaned lower-case text has "what is", "who was" and so on anywhere."""
    return _any_phrase(low, fv.QUESTION_WORDS) & low.rlike(rf"(?:{WORDS_ALT})\s+(?:{VERBS_ALT})\s+")


def phrases_found(low: Column, phrases: list[str]) -> Column:
    """The listed phrases that occur in lower-case text, in list order."""
    return F.array_except(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]), F.array(F.lit(None).cast("string")))


def _any_phrase(low: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def has_reasoning_words(low: Column) -> Column:
    """Whether a reasoning pattern occurs. Cleaned text has single blanks, so all but the pattern with
    a gap are plain substrings."""
    plain = [p.replace(r"\s+", " ") for p in fv.REASONING_PATTERNS if ".*" not in p]
    gapped = [low.rlike(p) for p in fv.REASONING_PATTERNS if ".*" in p]
    return reduce(lambda a, b: a | b, gapped, _any_phrase(low, plain))


def response_type(blank: Column, in_form: Column, low: Column, unsure: Column) -> Column:
    """First rule that applies wins: error, refusal, question form, explanation, uncertain.

    ``low`` is the cleaned text in lower case, ``unsure`` whether it has a phrase of uncertainty.
    """
    return (F.when(blank, "error")
            .when(_any_phrase(low, fv.REFUSAL_PHRASES), "refusal")
            .when(in_form, fv.QUESTION_TYPE)
            .when(has_reasoning_words(low), "explanation")
            .when(unsure, "uncertain")
            .otherwise("direct_answer"))


def reasoning(clean: Column) -> Column:
    """Sentences after reasoning words; the whole text when it is long and has none."""
    # The look-ahead leaves the sentence unconsumed, so several words may share one sentence.
    parts = [F.regexp_extract_all(clean, F.lit(rf"(?i){p}(?=([^.?!\n]*[.?!\n]?))"), F.lit(1))
             for p in fv.REASONING_PATTERNS]
    kept = F.filter(F.transform(F.concat(*parts), tx.strip), lambda s: F.length(s) > 10)
    return (F.when(F.size(kept) > 0, F.array_join(kept, ". "))
            .when(tx.words_in(clean) > 20, clean))


def starters(clean: Column) -> Column:
    """The starters, wherever they stand, each with the rest of its sentence."""
    return F.regexp_extract_all(clean, F.lit(rf"(?i)(?=((?:{WORDS_ALT})\s+(?:{VERBS_ALT})\s+[^?.!]*[?.!]?))"), F.lit(1))


def question_hit(clean: Column) -> Column:
    """The first starter in list order with the rest of its sentence; NULL when there is none."""
    return first_starter(starters(clean))


def first_starter(found: Column) -> Column:
    """The first of the starters in list order."""
    words, verbs = (F.array(*[F.lit(x) for x in listed]) for listed in (fv.QUESTION_WORDS, fv.QUESTION_VERBS))

    def placed(hit: Column, i: Column) -> Column:
        start = F.split(F.lower(hit), r"\s+", 3)
        return F.struct(F.array_position(verbs, F.get(start, F.lit(1))).alias("verb"), F.array_position(words, F.get(start, F.lit(0))).alias("word"),
                        i.alias("at"), hit.alias("hit"))
    return F.trim(F.array_min(F.transform(found, placed))["hit"])


def as_question(hit: Column) -> Column:
    """End with a question mark."""
    return F.when(F.endswith(hit, F.lit("?")), hit).otherwise(F.concat(hit, F.lit("?")))


def direct_answer(clean: Column) -> Column:
    """Head of the text before the first delimiter that leaves more than two characters."""
    def head(delimiter: str) -> Column:
        first = F.trim(tx.first_piece(clean, delimiter))
        bare = F.trim(F.regexp_replace(first, "(?i)" + fv.DIRECT_PREFIX, ""))
        return F.when(F.length(first) > 2, F.nullif(bare, F.lit("")))
    return F.coalesce(*[head(d) for d in [".", "\n", "!", "?"]], F.trim(clean))


def adapter_answer(raw: Column) -> Column:
    """The simpler extraction: cut at the first sentence end, keep question form."""
    text = tx.strip(raw)
    form = text.rlike(r"(?i)^(?:what|who|where|when|why|how) (?:is|are|was|were)")
    mark = F.when(F.endswith(text, F.lit("?")), F.lit("")).otherwise(F.lit("?"))
    asked = reduce(
        lambda acc, d: F.when(text.contains(d), F.concat(tx.first_piece(text, d), mark)).otherwise(acc),
        ["\n", "?", "."], text)
    plain = (F.when(text.contains("."), tx.first_piece(text, "."))
             .when(text.contains("\n"), tx.first_piece(text, "\n")).otherwise(text))
    return tx.strip(F.when(form, asked).otherwise(plain))


def quality_score(rtype: Column, indicators: Column, answer: Column) -> Column:
    score = (F.lit(1.0)
             + F.when(rtype == fv.QUESTION_TYPE, 0.2).otherwise(0.0)
             - F.size(indicators) * F.lit(0.1)
             - F.when(F.length(answer) < 5, 0.3).otherwise(0.0)
             - F.when(tx.words_in(answer) > 50, 0.2).otherwise(0.0))
    return F.when(rtype.isin("refusal", "error"), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def parse_responses(df: DataFrame, text_col: str, with_reasoning: bool = True) -> DataFrame:
    """Add a ``parsed`` struct; one projection, no shuffle."""
    raw = F.col(text_col)
    clean = F.col("_clean")
    staged = (df.withColumn("_blank", is_blank(raw))
              .withColumn("_flat", tx.collapse(raw))
              .withColumn("_clean", F.when(F.col("_blank"), F.lit("")).otherwise(without_prefixes(F.col("_flat"))))
              .withColumn("_low", F.lower(clean))
              .withColumn("_form", has_question_form(F.col("_low")))
              .withColumn("_unsure", _any_phrase(F.col("_low"), fv.UNCERTAINTY_PHRASES))
              .withColumn("_type", response_type(F.col("_blank"), F.col("_form"), F.col("_low"), F.col("_unsure"))))
    rtype = F.col("_type")
    # Stages, so that the search for a starter runs once per row.
    found, nothing = F.col("_found"), F.array().cast("array<string>")
    staged = (staged.withColumn("_found", F.when(rtype == fv.QUESTION_TYPE, starters(clean)))
              .withColumn("_hit", F.when(F.size(found) == 1, F.trim(found[0])).when(F.size(found) > 1, first_starter(found)))
              .withColumn("_asked", as_question(F.col("_hit")))
              .withColumn("_hints", F.when((rtype == "error") | ~F.col("_unsure"), nothing)
                          .otherwise(phrases_found(F.col("_low"), fv.UNCERTAINTY_PHRASES)))
              .withColumn("_answer", F.when(rtype.isin("error", "refusal"), F.lit(""))
                          .when(rtype == fv.QUESTION_TYPE, F.coalesce(tx.capitalize(F.col("_asked")), F.trim(clean)))
                          .otherwise(direct_answer(clean))))
    why = F.when(rtype != "error", F.when(has_reasoning_words(F.col("_low")), reasoning(clean)).when(
        tx.words_in(clean) > 20, clean)) if with_reasoning else F.lit(None).cast("string")
    staged = staged.withColumn("_why", why)
    parsed = F.struct(
        rtype.alias("response_type"), F.col("_answer").alias("extracted_answer"),
        F.col("_hints").alias("confidence_indicators"), F.col("_why").alias("reasoning"),
        clean.alias("cleaned_text"), F.col("_form").alias("has_question_form"),
        tx.words_in(clean).alias("word_count"),
        quality_score(rtype, F.col("_hints"), F.col("_answer")).alias("quality_score"))
    return staged.withColumn("parsed", parsed).drop(
        "_blank", "_flat", "_clean", "_low", "_form", "_unsure", "_found", "_hit", "_asked", "_type", "_hints", "_answer", "_why")
