"""Usage logs, interaction logs, checkpoints and session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

USAGE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("model_id", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("cost", T.DoubleType()), T.StructField("session_id", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])

INTERACTION_SCHEMA = T.StructType([
    T.StructField(n, t) for n, t in [
        ("timestamp", T.TimestampType()), ("benchmark_id", T.LongType()), ("question_id", T.StringType()),
        ("model_name", T.StringType()), ("category", T.StringType()), ("value", T.LongType()),
        ("question_text", T.StringType()), ("correct_answer", T.StringType()),
        ("formatted_prompt", T.StringType()), ("raw_response", T.StringType()),
        ("parsed_answer", T.StringType()), ("is_correct", T.BooleanType()), ("match_score", T.DoubleType()),
        ("match_type", T.StringType()), ("confidence_score", T.DoubleType()),
        ("response_time_ms", T.DoubleType()), ("cost_usd", T.DoubleType()), ("tokens_input", T.LongType()),
        ("tokens_output", T.LongType()), ("grading_details", T.MapType(T.StringType(), T.StringType())),
        ("error", T.StringType())]])

CHECKPOINT_SCHEMA = T.StructType([
    T.StructField("checkpoint_id", T.StringType()), T.StructField("benchmark_run_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("progress_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("partial_results", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def write_usage(usage: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines, or CSV with the metadata as a JSON text."""
    if kind == "json":
        usage.write.mode("overwrite").json(path, timestampFormat=_TIME)
    elif kind == "csv":
        flat = usage.withColumn("metadata", F.when(F.size("metadata") > 0, F.to_json("metadata")))
        flat.write.mode("overwrite").csv(path, header=True, escape='"',
                                         timestampFormat=_TIME)
    else:
        raise ValueError(f"unsupported format {kind!r}")


def _read(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False, csv: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records of one line each, or of one file each, with ``file_path``; what could not be read, as text in ``line`` with its file)."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path, wholetext=whole).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"))
    lines = lines.where(F.length(F.trim("line")) > 0)
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    if csv:
        as_text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked)
        lines = lines.where(F.col("line") != ",".join(schema.names))
        parsed = F.from_csv("line", F.lit(as_text), {**options, "escape": '"', "timestampFormat": _TIME})
    else:
        parsed = F.from_json("line", marked, options)
    parsed = lines.withColumn("_e", parsed)
    bad = F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull()
    return parsed.where(~bad).select("_e.*", "file_path").drop("_corrupt_record"), parsed.where(bad).select("line", "file_path")


def read_usage(spark: SparkSession, path: str, kind: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows of a usage log, lines that could not be read).

    A line that is no record, or has a field of the wrong kind, is among the second.
    """
    if kind == "json":
        rows, rejects = _read(spark, path, USAGE_SCHEMA)
        return rows.drop("file_path"), rejects
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name == "metadata" else f.dataType)
                         for f in USAGE_SCHEMA])
    rows, rejects = _read(spark, path, flat, csv=True)
    return rows.drop("file_path").withColumn("metadata", F.from_json("metadata", "map<string,string>")), rejects


def read_interactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries of the JSON-lines interaction log, lines that could not be read).

    A line that is no JSON, or has a field of the wrong kind, is among the second, as text in ``line`` with its file.
    """
    rows, rejects = _read(spark, path, INTERACTION_SCHEMA)
    return rows.drop("file_path"), rejects


def stream_interactions(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(INTERACTION_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
            .json(path))


def scan_checkpoints(spark: SparkSession, path: str, run_id: int | None = None,
                     multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one row per readable checkpoint document with its file, newest first; documents that could not be read).

    Documents are one file each, or lines of larger files with ``multi_line=False``. One without an id, or with a field of the wrong kind, is among the second, as
    text in ``line`` with its file.
    """
    docs, rejects = _read(spark, path, CHECKPOINT_SCHEMA, whole=multi_line)
    named = F.get_json_object("line", "$.checkpoint_id")
    lines = spark.read.text(path, wholetext=multi_line).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"))
    unnamed = lines.where((F.length(F.trim("line")) > 0) & named.isNull())
    rejects = rejects.unionByName(unnamed).distinct()
    docs = docs.where(F.col("checkpoint_id").isNotNull())
    docs = docs if run_id is None else docs.where(F.col("benchmark_run_id") == run_id)
    return docs.orderBy(F.desc("timestamp"), "checkpoint_id"), rejects
