"""Exact ranking that never gathers a whole group, or the whole table, in one task.

A plain ``row_number`` over a hot group sorts that group in a single task. The functions here cut groups or the
order into parts first, count the parts with map-side aggregation, and only sort inside a part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark.plans.storage import written

ROWS_PER_CELL = 50_000
KEY_DIGITS = 32
CELLS_PER_RANK, SPLIT = 64, 64
_PLACE = 1 << 33  # monotonically_increasing_id counts a partition's rows below this bit


def seeded_key(seed: int, id_col: str) -> Column:
    """Reproducible pseudo-random order: the same for a seed on every engine and cluster size."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def smallest_by_hash(df: DataFrame, group_cols: Sequence[str], key: Column, tie: str,
                     quota: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Rows of each group with the smallest ``quota`` hash keys, found by radix selection.

    ``quota`` has the group columns and ``n_take``. Rows are counted by group and the first two digits of the key, which are at most 256 cells a group; one of
    them holds the last row to be taken. Its rows alone are counted by the next two digits, and so on, until no group's last cell has more than
    ``rows_per_cell`` rows. A round counts with map-side sums and sees one row per cell; four rounds serve 1e14 rows a group. Then rows
    in cells before the last pass in the scan, without a shuffle; only rows of the last cells are ranked. The cuts, one row per
    group, are written, so Spark knows their size and broadcasts them only when they are small. Group columns compare null-safe.
    """
    groups = list(group_cols)
    keyed = df.withColumn("_key", key)
    cuts = quota.where("n_take > 0").select(*groups, F.lit("").alias("_prefix"), F.col("n_take").cast("bigint").alias("_need"))
    digits = 0
    while True:
        inside = _met(keyed.select(*groups, "_key"), cuts, groups).where(F.substring("_key", 1, digits) == F.col("_prefix") if digits else F.lit(True))
        cells = (inside.groupBy(*groups, "_prefix", "_need", F.substring("_key", digits + 1, 2).alias("_next"))
                 .agg(F.count(F.lit(1)).alias("_rows")))
        # At most 256 cells per group reach this window.
        running = Window.partitionBy(*groups, "_prefix", "_need").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = F.col("_need") - (F.sum("_rows").over(running) - F.col("_rows"))
        last = F.max(F.struct("_next", F.col("_left").alias("left"), F.col("_rows").alias("rows"))).alias("_last")
        cuts = written(cells.withColumn("_left", left).where("_left > 0").groupBy(*groups, "_prefix").agg(last).select(
            *groups, F.concat("_prefix", "_last._next").alias("_prefix"), F.col("_last.left").alias("_need"),
            F.col("_last.rows").alias("_rows")), "cuts")
        digits += 2
        largest = cuts.where("_need < _rows").agg(F.max("_rows")).first()[0]
        if largest is None or largest <= rows_per_cell or digits == KEY_DIGITS:
            break
    found = _met(keyed, cuts, groups).withColumn("_cell", F.substring("_key", 1, digits))
    all_of_last = F.col("_need") >= F.col("_rows")
    whole = (F.col("_cell") < F.col("_prefix")) | ((F.col("_cell") == F.col("_prefix")) & all_of_last)
    rank = F.row_number().over(Window.partitionBy(*groups, "_prefix").orderBy("_key", tie))
    ranked = (found.where((F.col("_cell") == F.col("_prefix")) & ~all_of_last)
              .withColumn("_rank", rank).where(F.col("_rank") <= F.col("_need")))
    return found.where(whole).select(*df.columns).unionByName(ranked.select(*df.columns))


def _met(rows: DataFrame, cuts: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with the cut of their group. Without groups there is one cut, or none, and its values become literals."""
    own = [c for c in cuts.columns if c not in groups]
    if groups:
        same = [F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}")) for g in groups]
        return rows.alias("r").join(cuts.alias("t"), same).select("r.*", *[f"t.{c}" for c in own])
    cut = cuts.first()
    return rows.withColumns({c: F.lit(cut[c]) for c in own}) if cut else rows.limit(0).withColumns({c: F.lit(None).cast(cuts.schema[c].dataType) for c in own})


def rows_at_ranks(df: DataFrame, id_col: str, start: int, step: int, n: int, low: int, high: int,
                  rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """The rows at the 0-based ranks ``start``, ``start + step``, ... (``n`` of them) in the order of a whole-number id, found by multi-rank selection.

    Ids from ``low`` to ``high`` fall into ``CELLS_PER_RANK * n`` ranges of equal width, which are counted; ranges that hold a wanted rank and more than
    ``rows_per_cell`` rows are cut into ``SPLIT`` narrower ones, as often as needed. Only the rows of ranges that hold a wanted rank, about one in ``CELLS_PER_RANK`` where ids lie
    evenly, leave the scan and are sorted. The windows see one row per range.
    """
    width = 1 << max(0, -(-(high - low + 1) // (CELLS_PER_RANK * n)) - 1).bit_length()  # a power of two, so that narrower ranges end where wide ones do

    def cell(w: int) -> Column:
        return F.floor((F.col(id_col) - low) / F.lit(w)) if w > 1 else F.col(id_col) - low

    def wanted(cells: DataFrame) -> DataFrame:
        first = F.greatest(F.lit(0), F.ceil((F.col("_before") - start) / F.lit(step)))
        rank = start + first * step
        return cells.where((first < n) & (rank < F.col("_before") + F.col("_rows")))

    counted = df.groupBy(cell(width).cast("bigint").alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(wanted(counted.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))), "ranges")
    parts = []
    while True:
        heavy = cells.where(F.col("_rows") > rows_per_cell) if width > 1 else cells.limit(0)
        split = width > 1 and not heavy.isEmpty()
        light = cells.where(F.col("_rows") <= rows_per_cell) if split else cells
        rows = df.withColumn("_cell", cell(width).cast("bigint")).join(light, "_cell")
        place = F.row_number().over(Window.partitionBy("_cell").orderBy(id_col)) - 1 + F.col("_before")
        rows = rows.withColumn("_rank", place)
        parts.append(rows.where((F.pmod(F.col("_rank") - start, F.lit(step)) == 0) & (F.col("_rank") >= start) & (F.col("_rank") < start + step * n)).select(*df.columns))
        if not split:
            break
        parent, width = width, max(1, width // SPLIT)
        inside = df.select(id_col).withColumn("_parent", cell(parent).cast("bigint")).join(heavy.select(F.col("_cell").alias("_parent"), F.col("_before").alias("_base")), "_parent")
        counted = inside.groupBy("_parent", "_base", cell(width).cast("bigint").alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy("_parent").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        cells = written(wanted(counted.select("_cell", "_rows", "_before")), "ranges")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_position(df: DataFrame, order_col: str | Sequence[str], name: str = "position") -> DataFrame:
    """Exact 1-based position in the order of one or more columns, over the whole table.

    One shuffle deals the rows to as many ranges as there are shuffle partitions and each range is sorted. The ranges are written with
    range and place of every row, so their counts give each range its offset. At most one row per range reaches the window.
    """
    columns = [order_col] if isinstance(order_col, str) else list(order_col)
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    return (placed.join(offsets, "_part")
            .withColumn(name, F.col("_offset") + F.col("_place").bitwiseAND(F.lit(_PLACE - 1)) + 1)
            .drop("_part", "_place", "_offset"))
