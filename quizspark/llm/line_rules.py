"""Quality rules: base measures of each text, and lines that many documents of a host share.

Lines are lower-cased, runs of white space inside them become one space, and are hashed. For every host the distinct documents of each line are counted, equal
texts once, so that a copied document does not make its own lines frequent. A line above the limit is removed: in more than ``share`` of the
host's documents and in more than ``least`` of them, or in more than ``most`` of them whatever their share (None: no such limit). A document left with less than ``keep_share`` of its words or with fewer than ``min_words``
is depleted and rejected. The base rule rejects texts with fewer than ``min_words`` words and those with more than a fifth of their words in repeated 5-word windows.

Line hashes of a document are written once, narrow, with a tag per row; counting, removal and verdict read that table. The counts are map-side
sums keyed by host, line and text before they are keyed by host and line, which spreads a line that every document has. Frequent lines are
written before they are joined, so that Spark knows their size and broadcasts them only when they are few.

Everything is SQL functions on the executors. Hashes have 64 bits; a chance meeting of two lines of a host can matter only if their sum exceeds the limit. Null text counts as
empty (no words, base rule fails). A null host is a host of its own. Repeated rows are judged each and count as one document. Columns of the input with
the names of added columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import WORD, text_or_empty
from quizspark.plans.storage import written

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = [*BASE, "base_failed", "kept", "removed_lines", "removed_words", "clean_text"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, also where body uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of five words that occur twice or more in the text, the first occurrence included."""
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.size(h) - WINDOW + 1),
                           lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("at"))))
        again = let(placed, lambda z: F.filter(F.transform(z, lambda x, i: F.when(
            F.coalesce(x["g"] == F.get(z, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(z, i + 1)["g"], F.lit(False)), x["at"])),
            lambda at: at.isNotNull()))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.array_sort(again), start, lambda s, at: F.struct(
            (s["n"] + WINDOW - F.greatest(F.lit(0), s["end"] - at)).alias("n"), (at + WINDOW).alias("end")), lambda s: s["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: let(windows(h), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted).cast("long")


def base_measures(text: Column) -> dict[str, Column]:
    """The measures of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": let(words, F.size).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, repeated_words),
    }


def normal_lines(text: Column) -> Column:
    """Normalised lines of a text, one for each line of it; blank ones are empty."""
    return F.split(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), " ?\n ?")


def judge(docs: DataFrame, carry: list[str] | None = None, host: str = "source", share: float = 0.05, least: int = 5,
          keep_share: float = 0.5, min_words: int = 10, max_repeat: int = 20, most: int | None = 1000) -> DataFrame:
    """Every row with the base measures, ``base_failed``, ``removed_lines``, ``removed_words`` and ``kept``.

    ``carry`` names the columns to return besides; all by default. With ``text`` among them, ``clean_text`` is the text without its frequent lines.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    text = text_or_empty()
    lines = F.filter(F.transform(normal_lines(text), lambda x: F.struct(
        F.xxhash64(F.trim(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"))), lambda s: s["n"] > 0)
    kept = [F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)]
    rows = docs.select(*kept, F.col(host).alias("__host"), F.xxhash64(text).alias("__text"), lines.alias("__lines"),
                       *[c.alias(n) for n, c in base_measures(text).items()], F.monotonically_increasing_id().alias("__row"))
    rows = written(rows, "line-rules")

    per_host = rows.groupBy("__host").agg(F.count_distinct("__text").alias("__docs"))
    in_docs = (rows.select("__host", "__text", F.explode(F.array_distinct(F.transform("__lines", lambda s: s["h"]))).alias("__h"))
               .groupBy("__host", "__h").agg(F.count_distinct("__text").alias("__n")).where(F.col("__n") > (least if most is None else min(least, most))))
    above = (F.col("__n") > least) & (F.col("__n") > F.col("__docs") * share)
    if most is not None:
        above = above | (F.col("__n") > most)
    frequent = in_docs.withColumnRenamed("__host", "__of").join(per_host, F.col("__of").eqNullSafe(F.col("__host"))).where(
        above).select(F.col("__of"), F.col("__h").alias("__frequent"))
    frequent = written(frequent, "frequent-lines")

    found = (rows.select("__row", "__host", F.explode("__lines").alias("__l"))
             .join(frequent, (F.col("__l.h") == F.col("__frequent")) & F.col("__host").eqNullSafe(F.col("__of"))))
    gone = [F.count(F.lit(1)).alias("removed_lines"), F.sum("__l.n").alias("removed_words")]
    if "text" in carry:
        gone.append(F.collect_set("__frequent").alias("__gone"))
    found = found.groupBy(F.col("__row").alias("__found")).agg(*gone)
    out = rows.join(found, F.col("__row") == F.col("__found"), "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("removed_lines", "removed_words")})
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    left = F.col("n_words") - F.col("removed_words")
    out = out.withColumns({"base_failed": failed, "kept": ~failed & (left >= min_words) & (left >= F.col("n_words") * keep_share)})
    names = [F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)]
    more = []
    if "text" in carry:
        text = F.coalesce(F.col(f"c_{carry.index('text')}"), F.lit(""))
        pairs = F.arrays_zip(F.split(text, "\n").alias("raw"), normal_lines(text).alias("norm"))
        stay = F.filter(pairs, lambda p: ~F.coalesce(F.array_contains("__gone", F.xxhash64(F.trim(p["norm"]))), F.lit(False)))
        more = [F.array_join(F.transform(stay, lambda p: p["raw"]), "\n").alias("clean_text")]
    return out.select(*names, *BASE, "base_failed", "kept", "removed_lines", "removed_words", *more)
