"""A chain of steps inside a row.

A step gets a function that names what earlier steps made, and returns new named expressions. Each step is bound by an array of one element, so
every value is computed once, however often later steps use it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession, functions as F

Step = Callable[[Callable[[str], Column]], dict[str, Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside another function's body."""
    return F.transform(F.array(value), body)[0]


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def small_methods(spark: SparkSession) -> None:
    """Let long stages run as projections, whose methods are cut small, unless the session says otherwise: the JVM only interprets generated methods of
    more than 8000 bytes, which long chains exceed."""
    if spark.conf.get(_METHOD_LIMIT, None) is None:
        spark.conf.set(_METHOD_LIMIT, "8000")


def _kept(steps: list[Step], result: str) -> list[list[str]]:
    """After each step, the names that later steps still read, and the result."""
    read, made = [], []
    for step in steps:
        seen: set[str] = set()

        def look(n: str, seen: set[str] = seen) -> Column:
            seen.add(n)
            return F.col(n)
        made.append(set(step(look)))
        read.append(seen)
    needed, out = {result}, []
    for seen, new in zip(reversed(read), reversed(made)):
        out.append(sorted(needed))
        needed = (needed - new) | seen
    return out[::-1]


def in_row(first: dict[str, Column], steps: Iterable[Step], result: str) -> Column:
    """One value that the steps make from ``first``, as an expression; a step carries on only what later steps read."""
    steps = list(steps)
    bound = F.array(F.struct(*[value.alias(name) for name, value in first.items()]))
    for step, names in zip(steps, _kept(steps, result)):
        def body(s: Column) -> Column:  # runs at once, so it may use the names of the loop
            made = step(lambda n: s[n])
            return F.struct(*[made.get(n, s[n]).alias(n) for n in names])
        bound = F.transform(bound, body)
    return bound[0][result]
