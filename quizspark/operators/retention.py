"""What to keep of runs, snapshots and logs, and audits of request rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_last(df: DataFrame, key: str, n: int, ts: str = "created_at", tie: str = "run_id") -> DataFrame:
    """The newest n rows of each key. The rank limit applies per task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, key: str, ts: str = "created_at", tie: str = "run_id") -> DataFrame:
    """The newest row of each key, as a map-side ``max_by``."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r"))
    return best.select(key, "_r.*")


def _expired(df: DataFrame, as_of: str, days: int, ts: str, states: Sequence[str] | None) -> Column:
    cutoff = F.lit(as_of).cast(df.schema[ts].dataType) - F.expr(f"interval {days} days")
    old = F.col(ts) < cutoff
    return F.coalesce(old if states is None else old & F.col("status").isin(list(states)), F.lit(False))


def expire(df: DataFrame, as_of: str, days: int = 30, ts: str = "created_at",
           states: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, expired): rows older than ``days`` before ``as_of``, optionally of finished states only."""
    gone = _expired(df, as_of, days, ts, states)
    return df.where(~gone), df.where(gone)


def rate_audit(log: DataFrame, per_minute: int, key: str = "model_id", ts: str = "ts",
               id_col: str = "event_id", window_seconds: int = 60, chunk_seconds: int = 3600) -> DataFrame:
    """Requests of the same key in the trailing window, violations and the wait that was due.

    Time is cut into chunks of whole windows, ``chunk_seconds`` or a little more, and the last ``window_seconds`` of a chunk are copied to the next one, so
    a key with a third of all requests is spread over its chunks. Requests at the same instant do not
    count against each other.
    """
    micros, span = 1_000_000, window_seconds * 1_000_000
    chunk = -(-max(chunk_seconds, window_seconds) // window_seconds) * span
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(F.col("_at") / F.lit(chunk)).cast("bigint")
    next_start = (own + 1) * chunk
    rows = log.withColumn("_at", at).withColumn("_chunks", F.when(
        F.col("_at") >= next_start - span, F.array(own, own + 1)).otherwise(F.array(own)))
    copies = rows.select("*", F.posexplode("_chunks").alias("_copy", "_chunk")).drop("_chunks")
    trailing = (Window.partitionBy(key, "_chunk").orderBy("_at").rangeBetween(-(span - 1), -1))
    seen = (copies.withColumn("recent_requests", F.count(F.lit(1)).over(trailing))
            .withColumn("_oldest", F.min("_at").over(trailing)).where(F.col("_copy") == 0))
    over = F.col("recent_requests") >= per_minute
    return (seen.withColumn("is_violation", over)
            .withColumn("wait_seconds", F.when(over, F.greatest(
                F.lit(0.0), (F.lit(span) - (F.col("_at") - F.col("_oldest"))) / F.lit(float(micros))))
                .otherwise(0.0))
            .drop("_at", "_copy", "_chunk", "_oldest"))
