"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then the full digest.

Length and prefix hash come from one narrow scan, grouped with map-side sums. Only rows whose pair of
both occurs twice are read in full and hashed; every other row is its own group. The repeated pairs are written before they are joined back, so that
Spark knows their size and broadcasts them only when they are small. The rows that reach the last step are written once, so that one row tag
holds for everything after.

Null text counts as empty. Empty texts form one group. Of rows with the same smallest id (repeated rows) exactly one stays. A
null id sorts after all others. Columns of the input with the names of added columns are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import SPACE, text_or_empty, without
from quizspark.plans.storage import written

ADDED = ["keep_id", "group_size", "kept"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def mark_duplicates(docs: DataFrame, carry: list[str] | None = None, prefix_chars: int = 128) -> DataFrame:
    """Every row with ``keep_id`` (id of the row of its group that stays), ``group_size`` and ``kept``.

    ``carry`` names the columns to return besides; all by default. ``prefix_chars`` is how much the second step hashes.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    norm = normalised(text_or_empty())
    sized = without(docs, ["__len", "__pre"]).withColumns(
        {"__len": F.octet_length(norm), "__pre": F.xxhash64(F.substring(norm, 1, prefix_chars))})
    repeated = (sized.groupBy("__len", "__pre").agg(F.count(F.lit(1)).alias("__n"))
                .where("__n > 1").select("__len", "__pre"))
    repeated = written(repeated, "repeated-pairs")

    alone = (sized.join(repeated, ["__len", "__pre"], "left_anti").select(*carry)
             .withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}))

    full = (sized.join(repeated, ["__len", "__pre"], "left_semi")
            .select(*carry, "__len", digest(text_or_empty()).alias("__sha")))
    full = written(full.withColumn("__row", F.monotonically_increasing_id()), "exact-dedup")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    groups = (full.groupBy("__len", "__sha").agg(F.min(first).alias("__first"), F.count(F.lit(1)).alias("__size")))
    more = full.join(groups, ["__len", "__sha"]).select(
        *carry, F.col("__first.id").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__row") == F.col("__first.row")).alias("kept"))
    return alone.unionByName(more)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    columns = docs.columns
    return mark_duplicates(docs).where("kept").select(*columns)
