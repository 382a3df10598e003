"""Where jobs keep intermediate tables and stream checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present. Only a local session without it gets a folder of its
    own, because there every task sees the driver's disk; that folder goes when the program ends.
    """
    path = spark.conf.get(_SETTING, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    path = tempfile.mkdtemp(prefix="quizspark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set(_SETTING, path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
