"""Small classification expressions over question values and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quizspark import fixed_values as fv


def difficulty_level(value: Column) -> Column:
    return (F.when(value.isNull(), "Unknown").when(value <= 600, "Easy")
            .when(value <= 1200, "Medium").otherwise("Hard"))


def value_bucket(value: Column) -> Column:
    low, medium, high = fv.VALUE_BUCKETS
    v = F.coalesce(value, F.lit(0))
    return F.when(v < 400, low).when(v < 800, medium).otherwise(high)


def signed_score(is_correct: Column, value: Column) -> Column:
    """+value when right, -value when wrong, 0 when unanswered."""
    v = F.coalesce(value, F.lit(0))
    return F.when(is_correct.isNull(), F.lit(0)).when(is_correct, v).otherwise(-v).cast("bigint")


def score_label(is_correct: Column, value: Column) -> Column:
    """Key of the score distribution: +$v, -$v, $0 or Unanswered."""
    score = signed_score(is_correct, value)
    return (F.when(is_correct.isNull(), "Unanswered")
            .when(score > 0, F.concat(F.lit("+$"), score.cast("string")))
            .when(score < 0, F.concat(F.lit("-$"), F.abs(score).cast("string")))
            .otherwise("$0"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def per_million(price: Column) -> Column:
    """Prices below the per-token limit are per token; others are per million tokens already."""
    return F.when((price > 0) & (price < fv.PER_TOKEN_PRICE_LIMIT), price * 1_000_000.0).otherwise(price)
