"""Exporting, snapshotting and restoring whole tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quizspark.plans.storage import written

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
RESTORE_ORDER = ("questions", "benchmark_runs", "benchmark_results", "model_performance")


def export_csv(tables: dict[str, DataFrame], path: str, only: Iterable[str] | None = None) -> list[str]:
    """One CSV folder per table; nested columns must be flattened first."""
    names = [n for n in tables if only is None or n in set(only)]
    for name in names:
        tables[name].write.mode("overwrite").csv(f"{path}/{name}", header=True, escape='"')
    return names


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Record count per table."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("record_count"))
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts).select("table_name", "record_count")


def snapshot(tables: dict[str, DataFrame], path: str, taken_at: str, version: str = "1.0",
             compress: bool = True) -> DataFrame:
    """Write every table as JSON lines plus a manifest with the counts of what was written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").options(
            compression="gzip" if compress else "none", timestampFormat=_TIME, timestampNTZFormat=_TIME,
        ).json(f"{path}/data/{name}")
    written = {n: spark.read.schema(df.schema).json(f"{path}/data/{n}") for n, df in tables.items()}
    out = manifest(written).withColumn("taken_at", F.lit(taken_at)).withColumn("version", F.lit(version))
    out.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(out.schema).json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    return {n: spark.read.schema(s).options(timestampNTZFormat=_TIME).json(f"{path}/data/{n}")
            for n, s in schemas.items()}


def last_per_key(rows: DataFrame, key: list[str], sequence: str | None = None) -> DataFrame:
    """One row per key, the last: that with the greatest ``sequence``, or the last as read. NULL is a key like any other."""
    order = F.struct(*([F.col(sequence)] if sequence else []), F.col("_at"))
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    last = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return last.select("_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], sequence: str | None = None) -> DataFrame:
    """Existing rows whose key is not incoming, and the last incoming row of each key. Keys compare null-safe."""
    incoming = last_per_key(incoming, key, sequence)
    same = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key])
    kept = existing.alias("e").join(incoming.select(*key).alias("i"), same, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def merge_partitions(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], partition_by: list[str], sequence: str | None = None) -> None:
    """Merge rows into a Parquet table, rewriting only the partitions that have incoming keys.

    ``partition_by`` must be part of the key, so that no row changes its partition. The merged rows are written to the shared folder before they replace
    anything; files of all other partitions stay as they are.
    """
    if not set(partition_by) <= set(key):
        raise ValueError(f"{partition_by} must be among the key columns {key}")
    incoming = written(last_per_key(incoming, key, sequence), "merge-incoming")
    touched = written(incoming.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition_by)]).distinct(), "merge-partitions")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p{i}")) for i, c in enumerate(partition_by)])
    existing = spark.read.parquet(path).join(touched, same, "left_semi")
    merged = written(upsert(existing, incoming, key), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def restore(existing: dict[str, DataFrame], incoming: dict[str, DataFrame], keys: dict[str, list[str]],
            path: str, drop_existing: bool = False, sequence: str | None = None) -> list[str]:
    """Write merged tables to a new path, parents before children. Of incoming rows with the same key the last one stays (see ``last_per_key``)."""
    ordered = [n for n in RESTORE_ORDER if n in incoming] + [n for n in incoming if n not in RESTORE_ORDER]
    for name in ordered:
        base = None if drop_existing else existing.get(name)
        if base is not None:
            merged = upsert(base, incoming[name], keys[name], sequence)
        else:
            merged = last_per_key(incoming[name], keys[name], sequence) if name in keys else incoming[name]
        merged.write.mode("errorifexists").parquet(f"{path}/{name}")
    return ordered
