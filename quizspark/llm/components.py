"""Connected components of a link table, by turns of large and small stars.

Every round is joins and map-side sums on the links; its result is written to the shared folder, so neither lineage nor a lost
executor matters, and the driver sees one count a round. The rounds end when all components are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quizspark.plans.storage import written


def _stars(links: DataFrame) -> bool:
    """Whether every component is one star: each larger node has one link, and no centre is a larger node."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
    loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 OR up = 1 AND centre = 1")
    return loose.agg(F.count(F.lit(1))).first()[0] == 0


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """``node, root`` for each node with a link; ``root`` is the smallest node that can be reached.

    ``links`` has columns ``a, b``; nulls, repeated links and links of a node with itself are left out.
    """
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "links")
    while not _stars(now):
        now = written(_small_star(_large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
