"""Registered queries: a name, the Spark query over the test tables, and the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quizspark.registry.entities import CTES

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None = None


class Registry:
    """Collects queries; ``add`` is used as a decorator on the Spark side."""

    def __init__(self) -> None:
        self.queries: list[Query] = []

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            self.queries.append(Query(name, build, with_entities(sql) if sql else None))
            return build
        return keep


def with_entities(sql: str) -> str:
    """Prefix the entity definitions a statement uses, directly or through another entity."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(body)
    if not used:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in used)
    body = sql.strip()
    return f"WITH {head},\n{body[4:].lstrip()}" if body.upper().startswith("WITH") else f"WITH {head}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals and doubles as doubles with a fixed number of digits, small counts as bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)
