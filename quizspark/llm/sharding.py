"""A uniform shuffle with exact shard sizes from a hypergeometric communication matrix.

How many rows of each partition a uniform shuffle sends to each shard is a random matrix with the partitions' sizes as row sums
and the shards' sizes as column sums. It is drawn first, exactly, from counts alone. Then every partition orders its rows at random where they are, hands the
first run to shard 0, the next to shard 1 and so on, and every shard orders what it got at random again. No
partition or shard has to be seen whole: a shard is cut into cells by a random hash, whose counts give each cell its first slot.

The input is written once with partition and place of every row, so counts and rows agree whatever is computed twice. The driver holds the matrix, one number per
partition and shard, never rows. Random numbers are hashes of the seed and the row's place.

Any column may be null and rows may repeat; a row is told from another by its place. An empty table gives an empty result.
Columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quizspark.llm.common import without
from quizspark.plans.storage import written

ADDED = ["shard", "slot"]
_PLACE = 1 << 33  # monotonically_increasing_id counts a partition's rows below this bit


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items taken from good and bad ones are good. numpy draws up to a billion items, beyond it the
    distribution is walked outwards from its mode, which takes steps in proportion to the standard deviation."""
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    u, up, down, p_up, p_down = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(row_sums: list[int], column_sums: list[int], seed: int) -> np.ndarray:
    """A random matrix with these sums, distributed as the counts of a uniform shuffle. Groups of partitions are halved, so
    one draw of a count never depends on all draws before it."""
    if sum(row_sums) != sum(column_sums):
        raise ValueError("rows and columns have different totals")
    rng = np.random.Generator(np.random.Philox(seed))
    out = np.zeros((len(row_sums), len(column_sums)), np.int64)
    todo = [(0, len(row_sums), list(column_sums))] if row_sums else []
    while todo:
        first, last, columns = todo.pop()
        if last - first == 1:
            out[first] = columns
            continue
        half = (first + last) // 2
        wanted, rest, left = sum(row_sums[first:half]), sum(columns), []
        for c in columns:
            rest -= c
            left.append(hypergeometric(rng, c, rest, wanted))
            wanted -= left[-1]
        todo += [(first, half, left), (half, last, [c - x for c, x in zip(columns, left)])]
    return out


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 8, cell_rows: int = 100_000) -> DataFrame:
    """Every row with ``shard`` (int) and ``slot`` (its place there, gapless from 0), in uniformly random order."""
    docs = without(docs, ADDED)
    spark, columns = docs.sparkSession, docs.columns
    order = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    local = (docs.withColumns({"__at": F.monotonically_increasing_id(), "__r": order}).sortWithinPartitions("__r", "__at")
             .withColumn("__id", F.monotonically_increasing_id()).drop("__at", "__r"))
    local = (written(local, "shards").withColumns({"__part": F.shiftright("__id", 33), "__rank": F.col("__id").bitwiseAND(F.lit(_PLACE - 1))}))

    counts = {r["__part"]: r["n"] for r in local.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    sizes = shard_sizes(sum(counts.values()), shards)
    matrix = communication_matrix([counts[p] for p in parts], sizes, seed)
    bounds = [(p, np.cumsum(m).tolist()) for p, m in zip(parts, matrix)]
    bounds = spark.createDataFrame(bounds, "__part long, __ends array<long>")

    cells = max(1, -(-max(sizes, default=0) // cell_rows))
    mixed = F.xxhash64(F.lit(seed + 1), F.col("__id"))
    dealt = local.join(bounds, "__part").withColumns({
        "shard": F.size(F.filter("__ends", lambda end: end <= F.col("__rank"))),
        "__cell": F.pmod(mixed, F.lit(cells)), "__mixed": F.xxhash64(F.lit(seed + 2), F.col("__id"))}).drop("__ends")
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
               .select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    ranked = dealt.withColumn("__in_cell", F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__mixed", "__id")) - 1)
    return ranked.join(offsets, ["shard", "__cell"]).select(*columns, "shard", (F.col("__offset") + F.col("__in_cell")).cast("long").alias("slot"))
