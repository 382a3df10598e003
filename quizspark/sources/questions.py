"""Reading and writing question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quizspark import fixed_values as fv


class IngestionError(ValueError):
    """The source lacks what a question set must have."""


def _text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def field_names(records: DataFrame, column: str = "_record") -> list[str]:
    """Names of all fields of JSON objects held as text, in order of the alphabet: a distributed pass that returns names only."""
    names = records.select(F.explode(F.json_object_keys(column)).alias("name")).distinct()
    return sorted(r["name"] for r in names.collect())


def read_questions_json(spark: SparkSession, path: str, columns: list[str] | None = None,
                        multi_line: bool = True) -> DataFrame:
    """Question rows as text columns from JSON, with every field that any record has.

    Multi-line documents may be an array, {"data": [...]}, {"questions": [...]}, or one object. A file
    of that kind is read by one task; for large sets use JSON lines (``multi_line=False``), which
    split. Field names come from the data in a pass of their own unless given in ``columns``. Nested values come back as JSON text. Lines
    that are no JSON object give a row of NULLs.
    """
    if multi_line:
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("_doc"))
        listed = F.coalesce(F.get_json_object("_doc", "$.data"), F.get_json_object("_doc", "$.questions"),
                            F.when(F.col("_doc").startswith("["), F.col("_doc")), F.concat(F.lit("["), F.col("_doc"), F.lit("]")))
        records = whole.select(F.explode(F.from_json(listed, "array<string>")).alias("_record"))
    else:
        records = spark.read.text(path).select(F.col("value").alias("_record")).where(F.length(F.trim("_record")) > 0)
    row = _text_schema(columns or field_names(records))
    return records.select(F.from_json("_record", row).alias("q")).select("q.*")


def read_questions_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Question rows as text columns from CSV with a header; quoted quotes are doubled.

    ``multi_line=True`` allows line breaks inside quotes but reads each file in one task.
    """
    return spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)


def present_only(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (one aggregate row)."""
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c]])


def require_columns(df: DataFrame) -> DataFrame:
    """Apply the ingest aliases and fail unless category, question and answer are there."""
    low = [c.lower() for c in df.columns]
    renames = {}
    for old, new in fv.INGEST_ALIASES.items():
        if old in low and new not in low and new not in renames.values():
            renames[df.columns[low.index(old)]] = new
    out = df.withColumnsRenamed(renames)
    missing = [c for c in fv.REQUIRED_COLUMNS if c not in [x.lower() for x in out.columns]]
    if missing:
        raise IngestionError(f"missing required columns {missing}; available: {df.columns}")
    return out


def write_questions(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_sample_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
