"""Running counters as Structured Streaming jobs.

Each job is a plain streaming DataFrame. ``run_to_table`` drains the available input and returns what
the stream wrote, so a batch caller, a test and a scheduled job use the same code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quizspark.plans.storage import new_path


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType | None = None,
                        files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream. Without a schema the files' own is used."""
    return (spark.readStream.schema(schema or spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def run_to_table(stream: DataFrame, mode: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Process all available input, then return the written rows.

    Append mode writes Parquet directly, exactly once. Complete mode replaces the table with each
    batch; update mode keeps each batch in a folder of its own, so a repeated batch overwrites itself, and returns the newest version
    of each key, one row per ``keys``.
    """
    if (mode == "update") != bool(keys):
        raise ValueError("update mode, and it alone, needs the keys of the running rows")
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema)
    if mode != "update":
        return rows.parquet(out)
    versions = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(out)
    newest = versions.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_row"))
    return newest.select("_row.*")


def grading_statistics(results: DataFrame) -> DataFrame:
    """Running counts and mean confidence per model and response type (complete mode)."""
    right = F.coalesce(F.col("is_correct"), F.lit(False))
    return results.groupBy("model_name", "response_type").agg(
        F.count(F.lit(1)).alias("total_graded"), F.count_if(right).alias("correct_count"),
        F.count_if(~right).alias("incorrect_count"), F.avg("confidence").alias("avg_confidence"))


def usage_windows(usage: DataFrame, size: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Cost and requests per tumbling window and model; later rows than ``lateness`` are dropped."""
    return (usage.withWatermark("ts", lateness).groupBy(F.window("ts", size).alias("w"), "model_id")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum("cost").alias("cost"))
            .select(F.col("w.start").alias("window_start"), "model_id", "requests", "cost"))


def request_rates(log: DataFrame, per_minute: int, size: str = "1 minute", slide: str = "10 seconds",
                  lateness: str = "1 minute") -> DataFrame:
    """Sliding windows in which a model had at least ``per_minute`` requests."""
    return (log.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide).alias("w"), "model_id")
            .agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") >= per_minute)
            .select(F.col("w.start").alias("window_start"), "model_id", "requests"))


def session_activity(log: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity of a session between idle gaps: duration, requests, errors, cost."""
    return (log.withWatermark("ts", lateness)
            .groupBy(F.session_window("ts", gap).alias("w"), "session_id")
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"),
                 F.sum("cost").alias("cost"))
            .select("session_id", F.col("w.start").alias("session_start"),
                    F.col("w.end").alias("session_end"), "requests", "errors", "cost"))


def first_seen(rows: DataFrame, keys: list[str], ts: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """The first row of each key within a horizon; repeats inside it are dropped."""
    return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def _progress_counts() -> list:
    return [F.count(F.lit(1)).alias("completed"), F.count_if(F.col("is_correct")).alias("successful"),
            F.count_if(~F.col("is_correct")).alias("failed"), F.max("ts").alias("last_seen")]


def run_progress(results: DataFrame, period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Running counts of each run and period of event time as result rows arrive (update mode); ``run_totals`` adds the periods of a run.

    The state of a period is dropped once the watermark has passed its end, so finished runs leave none; rows later than ``lateness`` are not counted then.
    A run with most of the rows is merged map-side.
    """
    timed = results.withWatermark("ts", lateness).groupBy("run_id", F.window("ts", period).alias("w"))
    return timed.agg(*_progress_counts()).select("run_id", F.col("w.start").alias("period_start"), "completed", "successful", "failed", "last_seen")


def run_totals(progress: DataFrame) -> DataFrame:
    """One row per run from the newest rows of its periods."""
    sums = [F.sum(c).alias(c) for c in ("completed", "successful", "failed")]
    return progress.groupBy("run_id").agg(*sums, F.max("last_seen").alias("last_seen"))


def stalled_runs(results: DataFrame, stalled_after: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Stretches of activity that ended in silence (append mode).

    A stretch is a session of rows at most ``stalled_after`` apart. It is reported once the watermark has passed its last row by that time; its
    state is dropped then. Counts of a session are merged map-side, so a run with most of the rows stays cheap.
    """
    sessions = results.withWatermark("ts", lateness).groupBy("run_id", F.session_window("ts", stalled_after).alias("w"))
    return sessions.agg(*_progress_counts()).select(
        "run_id", "completed", "successful", "failed", F.col("w.start").alias("started"), "last_seen")


def enrich_with_prices(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Streaming usage with the price list (stream-static join) and the cost at list price."""
    return usage.join(prices.select("model_id", "input_cost", "output_cost"), "model_id", "left").withColumn(
        "list_cost", (F.col("input_tokens") * F.coalesce("input_cost", F.lit(0.0))
                      + F.col("output_tokens") * F.coalesce("output_cost", F.lit(0.0))) / 1_000_000.0)
