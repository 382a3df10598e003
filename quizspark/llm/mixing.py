"""Mixing sources to target weights: tokens per source, repetition rates, hash-seeded whole copies.

The sources' totals are one aggregation; targets are filled like water by windows over that table of one row
per source, which the join back to the documents can broadcast when it is small. A document is taken floor(rate) times plus
once more with probability of the fraction, drawn from a hash of its id, so that a rerun takes the same.

Null text has no words and is never short of its target; a null source is a source of its own and sorts last. Documents without an id draw from
their text. Repeated rows are taken each, with the same draw. Sources without words have target 0. Columns of the
input with the names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark.llm.common import n_words, text_or_empty, without
from quizspark.plans.storage import written

ADDED = ["size", "source_size", "target", "copies"]
SEED = "mix-1"


def cyclic_weights(rank: Column, cycle: int = 3) -> Column:
    """Weights 1, 2, ... ``cycle``, again and again, by the rank of a source from 1."""
    return (F.pmod(rank - 1, F.lit(cycle)) + 1).cast("long")


def source_targets(sizes: DataFrame, cap: int, weight=cyclic_weights) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Shares of the total by weight; no target above ``cap`` times its source, what is cut off is shared again by
    weight. With sources ordered by cap over weight the capped ones come first, so running sums find the level
    at which the rest is filled. The windows see one row per source, never documents.
    """
    everything, by_ratio = Window.partitionBy(), Window.orderBy("__ratio", "__rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    t = t.withColumns({"__w": weight(F.col("__rank")), "__cap": F.col("source_size") * cap})
    t = t.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    t = t.withColumns({
        "__left": F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)),
        "__weights": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0))})
    t = t.withColumn("__level", F.col("__left") / F.col("__weights"))
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__rank", "__level"))).over(everything)
    return t.select("source", "source_size",
                    F.least(F.col("__cap").cast("double"), level["__level"] * F.col("__w")).alias("target"))


def uniform(seed: str) -> Column:
    """A number in [0, 1) from 48 bits of a digest of the id, or of the text where there is no id."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), text_or_empty()))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def plan_mix(docs: DataFrame, cap: int = 3, seed: str = SEED, weight=cyclic_weights) -> DataFrame:
    """Every row with ``size, source_size, target`` and the number of ``copies`` the mix takes of it."""
    sized = without(docs, ADDED).withColumns({"size": n_words(text_or_empty()), "__u": uniform(seed)})
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap, weight)
    targets = written(targets.withColumnRenamed("source", "__source"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("__u") < rate - F.floor(rate), 1).otherwise(0)
    return (sized.join(targets, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
            .withColumn("copies", copies.cast("long")).drop("__u"))


def mix(docs: DataFrame, cap: int = 3, seed: str = SEED, weight=cyclic_weights) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the mix takes it."""
    columns = docs.columns
    taken = plan_mix(docs, cap, seed, weight).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)
