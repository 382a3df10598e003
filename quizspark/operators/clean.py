"""Cleaning raw question sets: names, text, values, dates, derived columns. No step shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quizspark import fixed_values as fv
from quizspark.functions import labels, text as tx


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename synonym columns; for each standard name the first matching source column wins."""
    renames = {}
    for standard, names in fv.COLUMN_SYNONYMS.items():
        source = next((c for c in df.columns if c.lower().strip() in names), None)
        if source is not None and source != standard:
            renames[source] = standard
    return df.withColumnsRenamed(renames)


def clean_text(c: Column) -> Column:
    """Drop tags, collapse white space, then decode entities once each, in order."""
    bare = tx.collapse(F.regexp_replace(c, "<[^>]+>", ""))
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), fv.HTML_ENTITIES, bare)


def parse_value(c: Column) -> Column:
    """Whole numbers with optional $ and commas; anything else is NULL."""
    digits = F.regexp_replace(tx.strip(c.cast("string")), "[$,]", "")
    return F.when(digits.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(digits).try_cast("int"))


def parse_date(c: Column) -> Column:
    """First of five formats that fits: Y-m-d, m/d/Y, d/m/Y, Y-m-d H:M:S, Month d, Y."""
    flat = tx.strip(c.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(flat, F.lit(f))) for f in fv.DATE_FORMATS])


def filter_invalid(df: DataFrame) -> DataFrame:
    """Keep rows with a question of 10 characters or more and a non-empty answer."""
    keep = F.lit(True)
    if "question" in df.columns:
        keep = keep & (F.length("question") >= 10)
    if "answer" in df.columns:
        keep = keep & (F.length("answer") >= 1)
    return df.where(keep)


def add_metadata(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Content-based id, lengths and processing time."""
    out = df
    if "id" not in df.columns:
        out = out.withColumn("id", F.md5(F.concat_ws("|", *[F.col(c) for c in ("question", "answer")
                                                            if c in df.columns])))
    if "question_id" not in df.columns:
        out = out.withColumn("question_id", F.col("id"))
    out = out.withColumn("processed_at", F.current_timestamp() if processed_at is None else processed_at)
    for c in ("question", "answer"):
        if c in df.columns:
            out = out.withColumn(f"{c}_length", F.length(c))
    return out


def preprocess(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """The whole cleaning chain as one projection and one filter."""
    out = standardize_columns(df)
    for c in ("question", "answer", "category"):
        if c in out.columns:
            out = out.withColumn(c, clean_text(F.col(c).cast("string")))
    if "value" in out.columns:
        numeric = isinstance(out.schema["value"].dataType, T.NumericType)
        out = out.withColumn("value", F.col("value").cast("int") if numeric else parse_value(F.col("value")))
    if "air_date" in out.columns and not isinstance(out.schema["air_date"].dataType, T.DateType):
        out = out.withColumn("air_date", parse_date(F.col("air_date")))
    out = filter_invalid(out)
    if "value" in out.columns:
        out = out.withColumn("difficulty_level", labels.difficulty_level(F.col("value")))
    return add_metadata(out, processed_at)


def sampling_defaults(df: DataFrame) -> DataFrame:
    """Fill value NULL or 0 with 400 and missing difficulty with Medium."""
    return (df.withColumn("value", F.coalesce(F.nullif(F.col("value"), F.lit(0)),
                                              F.lit(fv.DEFAULT_QUESTION_VALUE)))
            .withColumn("difficulty_level", F.coalesce(
                F.nullif(F.col("difficulty_level"), F.lit("")), F.lit("Medium"))))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs become parent_child columns, lists become ', '-joined text."""
    def walk(schema: T.StructType, path: str, name: str):
        for field in schema.fields:
            at = f"{path}.`{field.name}`" if path else f"`{field.name}`"
            label = f"{name}{sep}{field.name}" if name else field.name
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, at, label)
            elif isinstance(field.dataType, T.ArrayType):
                yield F.array_join(F.col(at).cast("array<string>"), ", ", "None").alias(label)
            else:
                yield F.col(at).alias(label)
    return df.select(*walk(df.schema, "", ""))


def parse_models_tested(c: Column) -> Column:
    """A JSON list of names, or any other text as a single-element list."""
    flat = F.trim(c)
    parsed = F.when(flat.startswith("["), F.from_json(flat, "array<string>"))
    return F.coalesce(parsed, F.array(c))
