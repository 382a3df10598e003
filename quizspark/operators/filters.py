"""Predicates on questions, runs, usage records and catalogs. All reach the scan as filters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quizspark import fixed_values as fv
from quizspark.operators.clean import parse_models_tested
from quizspark.plans.ranking import with_position

#: Rows that a page may gather at one place.
GATHERED = 10_000


def by_category(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    if "category" not in df.columns:
        return df
    return df.where(F.lower("category").isin([c.lower() for c in categories]))


def by_difficulty(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.where(F.col("difficulty_level").isin(list(levels))) if "difficulty_level" in df.columns else df


def by_value_range(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if "value" not in df.columns:
        return df
    out = df if low is None else df.where(F.col("value") >= low)
    return out if high is None else out.where(F.col("value") <= high)


def by_date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive range; text that is no date fails the test."""
    if "air_date" not in df.columns:
        return df
    is_text = isinstance(df.schema["air_date"].dataType, T.StringType)
    day = F.expr("try_cast(air_date as date)") if is_text else F.col("air_date")
    out = df if not start else df.where(day >= F.lit(start).cast("date"))
    return out if not end else out.where(day <= F.lit(end).cast("date"))


def by_round(df: DataFrame, rounds: Sequence[str]) -> DataFrame:
    if "round" not in df.columns:
        return df
    return df.where(F.col("round").isin([fv.ROUND_ALIASES.get(r.lower(), r) for r in rounds]))


def apply_filters(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """All given conditions together; a condition on a missing column does nothing."""
    if spec.get("categories"):
        df = by_category(df, spec["categories"])
    if spec.get("difficulty_levels"):
        df = by_difficulty(df, spec["difficulty_levels"])
    df = by_value_range(df, spec.get("min_value"), spec.get("max_value"))
    df = by_date_range(df, spec.get("start_date"), spec.get("end_date"))
    return by_round(df, spec["rounds"]) if spec.get("rounds") else df


def get_questions(df: DataFrame, filters: dict[str, Any] | None = None, limit: int | None = None,
                  offset: int | None = None, id_col: str = "question_id", gathered: int = GATHERED) -> DataFrame:
    """Exact-match filters with a page of the result, ordered by id; ids are unique.

    A page that ends within the first ``gathered`` rows is kept from the first rows of each task. Rows of any other page are found by their
    position in a distributed order, and no task holds more than a range of it.
    """
    filters = filters or {}
    for name in ("category", "difficulty_level", "value", "round"):
        if filters.get(name) is not None:
            df = df.where(F.col(name) == filters[name])
    df = by_value_range(df, filters.get("min_value"), filters.get("max_value"))
    if limit is None and not offset:
        return df
    if limit is None or limit + (offset or 0) > gathered:
        placed = with_position(df, id_col, "_position").where(F.col("_position") > (offset or 0))
        return (placed if limit is None else placed.where(F.col("_position") <= (offset or 0) + limit)).drop("_position")
    page = df.orderBy(id_col)
    page = page.offset(offset) if offset else page
    return page.limit(limit)


def contains_text(df: DataFrame, col: str, part: str) -> DataFrame:
    """Case-insensitive substring test; wildcard characters have no special meaning."""
    return df.where(F.contains(F.lower(F.col(col)), F.lit(part.lower())))


def runs_with(df: DataFrame, status: str | None = None, model: str | None = None) -> DataFrame:
    """Runs by status and by a member of the tested-models list; plain text matches by substring."""
    if status is not None:
        df = df.where(F.col("status") == status)
    if model is not None:
        raw = F.col("models_tested")
        is_list = F.trim(raw).startswith("[")
        df = df.where(F.when(is_list, F.array_contains(parse_models_tested(raw), model))
                      .otherwise(F.contains(raw, F.lit(model))))
    return df


def usage_between(df: DataFrame, start: str | None = None, end: str | None = None,
                  model_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """Usage records by inclusive time range, model and session."""
    kind = df.schema["ts"].dataType.simpleString()
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast(kind))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast(kind))
    if model_id:
        df = df.where(F.col("model_id") == model_id)
    return df.where(F.col("session_id") == session_id) if session_id else df


def by_id(df: DataFrame, id_col: str, value: Any) -> DataFrame:
    return df.where(F.col(id_col) == value).limit(1)


def by_provider(df: DataFrame, provider: str) -> DataFrame:
    return df.where(F.lower("provider") == provider.lower())


def with_capability(df: DataFrame, capability: str) -> DataFrame:
    return df.where(F.array_contains("capabilities", capability))


def with_context(df: DataFrame, minimum: int = 32_000) -> DataFrame:
    return df.where(F.col("context_length") >= minimum)


def search_catalog(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive search in id, name, provider and capabilities."""
    if not query:
        return df
    part = F.lit(query.lower())

    def has(c: Column) -> Column:
        return F.coalesce(F.contains(F.lower(c), part), F.lit(False))
    return df.where(has(F.col("model_id")) | has(F.col("name")) | has(F.col("provider"))
                    | F.coalesce(F.exists("capabilities", has), F.lit(False)))


def errors_only(df: DataFrame) -> DataFrame:
    """Log entries that are not correct or carry an error."""
    return df.where(~F.coalesce(F.col("is_correct"), F.lit(False)) | F.col("error").isNotNull())
