"""Dealing a small table to all cores before long work on each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, pieces: int | None = None) -> DataFrame:
    """The rows of a scan over as many tasks as there are cores, where the scan has fewer pieces than that.

    A scan is cut into pieces of ``spark.sql.files.maxPartitionBytes`` at most, so one with fewer pieces than cores is small and moving it costs
    little; often it is one file with one row group, which one task would read and work through alone. A larger table is left as it is. ``scan`` should be a
    plain scan: asking for its pieces starts no job.
    """
    pieces = pieces or scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= pieces else scan.repartition(pieces)
