"""Exact order statistics per group without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark.plans.keys import join_by
from quizspark.plans.storage import written

CELLS, ACCURACY = 1024, 5120
SLACK = 2  # cells on each side, ten times the error of the sketch
SMALL = 4 * CELLS  # groups of fewer values are ordered whole


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     ranks: dict[str, Column]) -> DataFrame:
    """Values at exact 1-based ranks of ``value`` within each group, one row per group.

    ``ranks`` maps an output name to a rank expression over ``n``, the number of non-null values.
    The first scan makes one mergeable quantile sketch per group, map-side; its rank bounds give each wanted rank an interval of ``2 * SLACK + 1`` of ``CELLS`` parts.
    These, one row per group, are written, so Spark broadcasts them only when they are few. The second scan counts what lies below each interval, map-side, and only values inside one
    are counted by value, shuffled and ordered, an interval in one task. NULL is a group key like any other.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    steps = F.percentile_approx("_v", [i / CELLS for i in range(1, CELLS)], F.lit(ACCURACY))
    span = rows.groupBy(*keys).agg(steps.alias("_bounds"), F.count(F.lit(1)).alias("n"))

    def interval(name: str, rank: Column) -> Column:
        cell = F.floor((rank - 1) * F.lit(float(CELLS)) / F.col("n")).cast("int")

        def bound(i: Column) -> Column:
            """The ``i``-th of the sketch's bounds, counted from 1; NULL, for no bound, beyond them and in small groups."""
            return F.when((F.col("n") >= SMALL) & (i >= 1) & (i < CELLS), F.get("_bounds", i - 1))
        return F.struct(F.lit(name).alias("stat"), rank.cast("bigint").alias("rank"), bound(cell - SLACK).alias("low"), bound(cell + 1 + SLACK).alias("high"))

    wanted = span.select(*keys, F.array(*[interval(name, rank) for name, rank in ranks.items()]).alias("_wanted"))
    met = join_by(rows, written(wanted, "rank-intervals"), keys)
    names = list(ranks)

    def below(i: int) -> Column:
        return F.coalesce(F.col("_v") < F.col("_wanted")[i]["low"], F.lit(False))

    def inside(i: int) -> Column:
        return ~below(i) & F.coalesce(F.col("_v") <= F.col("_wanted")[i]["high"], F.lit(True))
    # One group per value of an interval, and one per place between intervals for all other values.
    places = [F.when(below(i), 0).when(inside(i), 1).otherwise(2).alias(f"_p{i}") for i in range(len(names))]
    any_inside = F.greatest(*[F.when(inside(i), 1).otherwise(0) for i in range(len(names))], F.lit(0)) == 1
    counted = (met.select(*keys, "_wanted", F.when(any_inside, F.col("_v")).alias("_v"), *places)
               .groupBy(*keys, "_v", *[f"_p{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("_c"), F.first("_wanted").alias("_wanted")))
    each = counted.select(*keys, "_v", "_c", F.posexplode(F.array(*[
        F.struct(F.col(f"_p{i}").alias("place"), F.col("_wanted")[i]["rank"].alias("rank")) for i in range(len(names))])).alias("_i", "_h")).where("_h.place < 2")
    # What lies below an interval comes to its window as one row.
    each = each.groupBy(*keys, "_i", "_h", F.when(F.col("_h.place") == 1, F.col("_v")).alias("_v")).agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy("_h.place", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = each.withColumn("_upto", upto).where((F.col("_h.place") == 1) & (F.col("_h.rank") <= F.col("_upto")) & (F.col("_h.rank") > F.col("_upto") - F.col("_c")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(name) for i, name in enumerate(names)])


def lower_median_rank(n: Column) -> Column:
    return F.floor((n + 1) / F.lit(2.0))


def upper_median_rank(n: Column) -> Column:
    return F.floor(n / F.lit(2.0)) + 1


def floor_index_rank(p: float, n: Column) -> Column:
    """Rank of ``sorted[min(int(p * n), n - 1)]``."""
    return F.least(F.floor(F.lit(p) * n), n - 1) + 1
