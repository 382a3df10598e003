"""Reproducible samples.

The random order is ``md5(seed | id)``: the same rows for the same seed on every cluster. Exact
sizes come from counting hash cells (see ``plans.ranking``), so no group and no table is sorted in
one task, whatever the sample size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark import fixed_values as fv
from quizspark.plans.ranking import rows_at_ranks, seeded_key, smallest_by_hash, with_position
from quizspark.plans.storage import written


class SamplingError(ValueError):
    """The input cannot be sampled."""


def sample_size(confidence: float = 0.95, margin: float = 0.05) -> int:
    """Rows needed for a margin of error at the widest variance, at least 30."""
    z = fv.Z_SCORES.get(confidence, fv.DEFAULT_Z)
    return max(math.ceil((z ** 2) * 0.5 * 0.5 / margin ** 2), fv.MIN_SAMPLE)


def sample_size_fpc(population: Column, confidence: float = 0.95, margin: float = 0.05,
                    proportion: float = 0.5, population_limit: int | None = None) -> Column:
    """Sample size with finite population correction, as a column over a population count.

    The correction vanishes as the population grows. ``population_limit`` leaves it out from that population on.
    """
    z = fv.Z_SCORES.get(confidence, fv.DEFAULT_Z)
    base = F.lit((z ** 2) * proportion * (1 - proportion) / margin ** 2)
    size = F.try_divide(base, 1 + F.try_divide(base - 1, population))
    if population_limit is not None:
        size = F.when(population < population_limit, size).otherwise(base)
    return F.least(F.greatest(F.ceil(size), F.lit(fv.MIN_SAMPLE)), population)


def _population(df: DataFrame) -> int:
    n = df.count()
    if n == 0:
        raise SamplingError("cannot sample from an empty table")
    return n


def default_size(df: DataFrame) -> int:
    """Corrected sample size of a table (one count)."""
    n = _population(df)
    return df.sparkSession.range(1).select(sample_size_fpc(F.lit(n)).alias("n")).first()["n"]


def random_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "question_id") -> DataFrame:
    """Exactly n rows, or all rows when there are fewer."""
    quota = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n_take"))
    return smallest_by_hash(df, [], seeded_key(seed, id_col), id_col, quota)


def default_strata(df: DataFrame) -> list[str]:
    """Difficulty and category, as far as they are there."""
    return [c for c in ("difficulty_level", "category") if c in df.columns]


def allocation(df: DataFrame, strata: Sequence[str], n: int, exact: bool = False) -> DataFrame:
    """Rows to take per stratum: proportional, at least 1, at most the stratum.

    Missing rows go one each to the largest strata, as many as rows are missing, if they have room.
    With ``exact`` surplus rows are taken away the same way, never below 1.
    """
    strata = list(strata)
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("t")).select("t").scalar()
    share = F.floor(F.lit(n) * (F.col("n_rows") / total))
    base = counts.withColumn("_a", F.least(F.greatest(F.lit(1), share), F.col("n_rows")))
    if exact:
        base = base.where(" AND ".join(f"`{s}` IS NOT NULL" for s in strata))
    gap = F.lit(n) - base.agg(F.sum("_a").alias("s")).select("s").scalar()
    # The |gap| largest strata are adjusted. Counts of strata per size tell which sizes are adjusted as a whole and
    # where the last one starts; the window over sizes sees one row per distinct size.
    # The |gap| largest strata are adjusted, as far as they have room, which strata of one size have or lack together. Strata with
    # room are fewer than n, whatever the number of strata. Sizes are adjusted as a whole but for the last, of which the first strata in order are.
    ranked = base.withColumn("_gap", gap).where(F.abs("_gap") > 0 if exact else F.col("_gap") > 0)
    room = F.when(F.col("_gap") > 0, F.col("_a") < F.col("n_rows")).otherwise(F.col("_a") > 1)
    larger = Window.orderBy(F.desc("n_rows")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (ranked.groupBy("n_rows", "_a", "_gap").agg(F.count(F.lit(1)).alias("_k"))
             .withColumn("_before", F.coalesce(F.sum("_k").over(larger), F.lit(0))).where((F.col("_before") < F.abs("_gap")) & room)
             .select(F.col("n_rows").alias("_size"), "_k", (F.abs("_gap") - F.col("_before")).alias("_some")))
    sizes = written(sizes, "sizes")
    adjusted = ranked.join(sizes.where("_k <= _some"), F.col("n_rows") == F.col("_size")).select(*strata, "_gap")
    cut = sizes.where("_k > _some").first()
    if cut:
        in_order = ranked.where(F.col("n_rows") == cut["_size"]).orderBy(*[F.col(s).asc_nulls_first() for s in strata])
        adjusted = adjusted.unionByName(in_order.limit(cut["_some"]).select(*strata, "_gap"))
    adjusted = adjusted.select(*strata, F.signum("_gap").cast("bigint").alias("_d"))
    same = [F.col(f"b.{s}").eqNullSafe(F.col(f"d.{s}")) for s in strata]
    return (base.alias("b").join(adjusted.alias("d"), same, "left")
            .select(*[F.col(f"b.{s}").alias(s) for s in strata], F.col("b.n_rows").alias("n_rows"),
                    (F.col("b._a") + F.coalesce(F.col("d._d"), F.lit(0))).cast("bigint").alias("n_take")))


def stratified_sample(df: DataFrame, n: int | None = None, strata: Sequence[str] | None = None,
                      seed: int = 42, id_col: str = "question_id", exact: bool = False) -> DataFrame:
    """Proportional sample over any number of strata columns and strata. NULL is a stratum of its own.

    ``exact=True`` leaves NULL strata out and removes surplus rows.
    """
    size = default_size(df) if n is None else n
    cols = default_strata(df) if strata is None else list(strata)
    if not cols:
        return random_sample(df, size, seed, id_col)
    quota = allocation(df, cols, size, exact).select(*cols, "n_take")
    return smallest_by_hash(df, cols, seeded_key(seed, id_col), id_col, quota)


def time_bins(df: DataFrame, date_col: str, periods: int = 5, seed: int = 42,
              id_col: str = "question_id", name: str = "time_period") -> DataFrame:
    """Equal-width bins over the rank by time; among equal times the seeded order decides.

    Ranks come from counts per day. Only days that a bin boundary cuts, fewer than ``periods``, need
    positions of single rows.
    """
    rows = df.where(F.col(date_col).isNotNull()).withColumn("_day", F.to_date(date_col))
    days = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = days.agg(F.sum("_n").alias("t")).select("t").scalar()

    def bin_of(index: Column) -> Column:
        """Bin of a 0-based rank among ``_t`` rows."""
        span = F.greatest(F.col("_t") - 1, F.lit(1))
        return F.greatest(F.lit(0), F.ceil(index * F.lit(periods) / span) - 1).cast("int")
    # One row per calendar day reaches these windows.
    placed = (days.withColumn("_end", F.sum("_n").over(upto)).withColumn("_t", total)
              .withColumn("_start", F.col("_end") - F.col("_n"))
              .withColumn("_b0", bin_of(F.col("_start"))).withColumn("_b1", bin_of(F.col("_end") - 1))
              .withColumn("_cut", F.when(F.col("_b0") != F.col("_b1"), F.col("_n")).otherwise(0))
              .withColumn("_skipped", F.col("_start") - (F.sum("_cut").over(upto) - F.col("_cut")))
              .select("_day", "_skipped", "_t", "_b0", "_b1"))
    marked = rows.join(written(placed, "days"), "_day")
    whole = marked.where(F.col("_b0") == F.col("_b1")).withColumn(name, F.col("_b0"))
    cut = marked.where(F.col("_b0") != F.col("_b1")).withColumn("_key", seeded_key(seed, id_col))
    # A position among the rows of cut days, plus the rows of whole days before, is the rank.
    split = (with_position(cut, [date_col, "_key", id_col], "_position")
             .withColumn(name, bin_of(F.col("_skipped") + F.col("_position") - 1)))
    helpers = ["_day", "_skipped", "_t", "_b0", "_b1"]
    return whole.drop(*helpers).unionByName(split.drop(*helpers, "_key", "_position"))


def temporal_sample(df: DataFrame, n: int | None = None, date_col: str = "air_date", periods: int = 5,
                    seed: int = 42, id_col: str = "question_id") -> DataFrame:
    """Stratified sample over time bins and difficulty; rows without a date are left out.

    Without any date it is the plain stratified sample.
    """
    if date_col not in df.columns or df.where(F.col(date_col).isNotNull()).isEmpty():
        return stratified_sample(df, n, None, seed, id_col)
    binned = time_bins(df, date_col, periods, seed, id_col)
    size = default_size(binned) if n is None else n
    strata = ["time_period"] + (["difficulty_level"] if "difficulty_level" in df.columns else [])
    return stratified_sample(binned, size, strata, seed, id_col).drop("time_period")


def balanced_sample(df: DataFrame, n: int | None = None, shares: dict[str, float] | None = None,
                    seed: int = 42, id_col: str = "question_id") -> DataFrame:
    """Fixed shares per difficulty; short levels are not refilled, other levels are dropped."""
    if "difficulty_level" not in df.columns:
        return stratified_sample(df, n, None, seed, id_col)
    size = default_size(df) if n is None else n
    shares = fv.BALANCED_DIFFICULTY if shares is None else shares
    quota = df.sparkSession.createDataFrame(
        [(level, int(size * share)) for level, share in shares.items()],
        "difficulty_level string, n_take bigint")
    return smallest_by_hash(df, ["difficulty_level"], seeded_key(seed, id_col), id_col, quota)


def systematic_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "question_id") -> DataFrame:
    """Every k-th row in id order, k = rows div n, from a start that the seed fixes; n rows at most.

    Whole-number ids are found by multi-rank selection, which leaves the table where it is; ids of other types, and tables with NULL ids, are put in order.
    """
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"), F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    if seen["n"] == 0:
        raise SamplingError("cannot sample from an empty table")
    step = max(1, seen["n"] // n)
    start = seed % step
    if whole and seen["ids"] == seen["n"]:
        return rows_at_ranks(df, id_col, start, step, n, seen["low"], seen["high"])
    index = F.col("_position") - 1
    return (with_position(df, id_col, "_position")
            .where((F.pmod(index, F.lit(step)) == start) & (index < start + step * n)).drop("_position"))


def outcome_sample(results: DataFrame, count: int = 10, correct: int | None = None,
                   incorrect: int | None = None, seed: int = 42, id_col: str = "result_id") -> DataFrame:
    """Correct and other results in equal parts, or in given numbers; a shortage of others is filled
    with correct ones."""
    rows = results.withColumn("_right", F.coalesce(F.col("is_correct"), F.lit(False)))
    have = rows.agg(F.count_if("_right").alias("c"), F.count_if(~F.col("_right")).alias("i"))
    c, i = F.col("c"), F.col("i")
    half = count // 2
    if correct is not None and incorrect is not None:
        take_c, take_i = F.least(F.lit(correct), c), F.least(F.lit(incorrect), i)
    elif correct is not None:
        take_c = F.least(F.lit(correct), c)
        take_i = F.least(F.lit(count) - take_c, i)
    elif incorrect is not None:
        take_i = F.least(F.lit(incorrect), i)
        take_c = F.least(F.lit(count) - take_i, c)
    else:
        first = F.least(F.lit(half), c)
        take_i = F.least(F.lit(count) - first, i)
        take_c = F.when((take_i < half) & (c > first), F.least(F.lit(count) - take_i, c)).otherwise(first)
    quota = have.select(F.explode(F.array(
        F.struct(F.lit(True).alias("_right"), F.greatest(take_c, F.lit(0)).cast("bigint").alias("n_take")),
        F.struct(F.lit(False).alias("_right"), F.greatest(take_i, F.lit(0)).cast("bigint").alias("n_take"))
    )).alias("q")).select("q.*")
    return smallest_by_hash(rows, ["_right"], seeded_key(seed, id_col), id_col, quota).drop("_right")


def preset_sample(df: DataFrame, mode: str = "standard", id_col: str = "question_id") -> DataFrame:
    """Sample of a run mode: quick 50, standard 200, comprehensive 1000 questions."""
    return stratified_sample(df, fv.MODE_PRESETS[mode], fv.PRESET_STRATA, fv.PRESET_SEED, id_col)


def draw(df: DataFrame, method: str, n: int | None = None, seed: int = 42, id_col: str = "question_id",
         strata: Sequence[str] | None = None) -> DataFrame:
    """Sample by method name: random, stratified, balanced, temporal or systematic."""
    methods = {
        "random": lambda: random_sample(df, default_size(df) if n is None else n, seed, id_col),
        "stratified": lambda: stratified_sample(df, n, strata, seed, id_col),
        "balanced": lambda: balanced_sample(df, n, None, seed, id_col),
        "temporal": lambda: temporal_sample(df, n, "air_date", 5, seed, id_col),
        "systematic": lambda: systematic_sample(df, default_size(df) if n is None else n, seed, id_col),
    }
    if method not in methods:
        raise SamplingError(f"unknown method {method!r}; choose from {sorted(methods)}")
    return methods[method]()


def representativeness(original: DataFrame, sample: DataFrame,
                       columns: Sequence[str] = ("category", "difficulty_level", "round")) -> DataFrame:
    """Per column: mean and largest difference of value shares, distinct values, sampling ratio.

    Both tables are counted per column and value in one pass each.
    """
    columns = [c for c in columns if c in original.columns and c in sample.columns]

    def shares(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        long = combos.select("_n", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
        ])).alias("d")).where(F.col("d.value").isNotNull())
        counts = long.groupBy("d.column_name", "d.value").agg(F.sum("_n").alias(f"{name}_n"))
        totals = counts.groupBy("column_name").agg(
            F.sum(f"{name}_n").alias(f"{name}_total"), F.count(F.lit(1)).alias(f"{name}_unique"))
        return counts, totals
    o, o_tot = shares(original, "original")
    s, s_tot = shares(sample, "sample")
    sizes = (original.agg(F.count(F.lit(1)).alias("n")), sample.agg(F.count(F.lit(1)).alias("n")))
    diff = F.abs(F.col("original_n") / F.col("original_total") - F.col("sample_n") / F.col("sample_total"))
    return (o.join(s, ["column_name", "value"]).join(o_tot, "column_name").join(s_tot, "column_name")
            .groupBy("column_name").agg(
                F.avg(diff).alias("mean_difference"), F.max(diff).alias("max_difference"),
                F.max("original_unique").alias("original_unique"), F.max("sample_unique").alias("sample_unique"))
            .withColumn("sampling_ratio", F.coalesce(F.try_divide(
                sizes[1].select("n").scalar().cast("double"), sizes[0].select("n").scalar()), F.lit(0.0))))


def value_overlap(original: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """Each distinct value of the original with whether the sample has it."""
    seen = sample.select(F.col(column)).distinct().withColumn("in_sample", F.lit(True))
    return (original.select(column).where(F.col(column).isNotNull()).distinct()
            .join(seen, column, "left").withColumn("in_sample", F.coalesce("in_sample", F.lit(False))))
