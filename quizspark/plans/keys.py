"""Joins on group keys in which NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables by key columns, comparing null-safe; the keys appear once.

    Without keys both are one row each.
    """
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.lit(True))
    return left.join(right, same, how).drop(*[f"_key_{k}" for k in keys])
