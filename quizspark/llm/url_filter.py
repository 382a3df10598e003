"""Temporal list join: dated list entries become validity intervals, captures meet those active when they were fetched.

A list is a log of dated entries: an action for a pattern from a time on, until the next entry for the same pattern. A pattern is a
host, with all hosts below it, or a host with the beginning of a path, whole segments. A capture looks for its host, each parent of it, and each
beginning of its path on its own host; that is a few keys, joined by equality, with the interval as a further condition. The most specific active entry
decides: the longest path, then the longest host. There is at most one active entry per pattern and time, so the join makes no more rows than keys.

Several entries for a pattern at the same time: the stricter action (block) holds. Null pattern, time or action: the entry is ignored. A null url or one
without a host, and a null fetch time, meet no entry and are kept. Repeated captures are judged each. Columns of the input with the names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quizspark.llm.common import without

ADDED = ["pattern", "action", "listed_from", "kept"]
BLOCK, ALLOW = "block", "allow"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without trailing dots; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, listed_from, listed_to`` (null: open) from ``pattern, action, listed_at``."""
    one = (entries.where("pattern is not null and action is not null and listed_at is not null")
           .groupBy(F.lower("pattern").alias("pattern"), F.col("listed_at").alias("listed_from"))
           .agg(F.max("action").alias("action")))
    following = F.lead("listed_from").over(Window.partitionBy("pattern").orderBy("listed_from"))
    return one.select("pattern", "action", "listed_from", following.alias("listed_to"))


def patterns_of(url: Column) -> Column:
    """All patterns that can list a url: parents of the host by labels, and beginnings of the path on the host by segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
                        lambda i: F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, paths)))


def apply_list(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (``url``, ``fetched_at``) with the deciding ``pattern``, its ``action`` and ``listed_from``, and ``kept``."""
    captures = without(captures, ADDED)
    row = F.struct(*captures.columns)
    tagged = captures.select(row.alias("__capture"), F.monotonically_increasing_id().alias("__row"))
    keyed = tagged.select("__row", "__capture", F.col("__capture.fetched_at").alias("__at"),
                          F.explode_outer(patterns_of(F.col("__capture.url"))).alias("__key"))
    active = intervals(entries)
    met = keyed.join(active, (F.col("__key") == F.col("pattern")) & (F.col("__at") >= F.col("listed_from"))
                     & (F.col("listed_to").isNull() | (F.col("__at") < F.col("listed_to"))), "left")
    weight = F.struct(F.instr("pattern", "/") > 0, F.length("pattern"), "pattern", "action", "listed_from")
    weight = F.when(F.col("pattern").isNotNull(), weight)
    decided = met.groupBy("__row").agg(F.first("__capture").alias("__capture"), F.max(weight).alias("__best"))
    return decided.select("__capture.*", F.col("__best.pattern").alias("pattern"), F.col("__best.action").alias("action"),
                          F.col("__best.listed_from").alias("listed_from"),
                          (F.coalesce(F.col("__best.action"), F.lit(ALLOW)) != BLOCK).alias("kept"))
