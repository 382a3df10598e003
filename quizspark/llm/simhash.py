"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified Hamming distance, components.

A fingerprint is cut into seven blocks. Two that differ in at most four bits agree in at least three blocks, so every pair of links
shares one of the 35 keys made of three blocks; each key has 27 bits or more, which keeps chance meetings rare. Equal fingerprints are merged before, so a
group of copies costs one row. The fingerprints of a key are compared where they meet, but only links of a
spanning forest leave the task, never all pairs. A key with more than ``bucket`` fingerprints is not compared there: its rows pass
through, and two fingerprints are linked exactly when they share a point at two bits' distance from both, which
takes rows in proportion to the fingerprints and spreads them by that point.

Null text counts as empty; texts without words have fingerprint zero and are linked like any other. Texts with fewer words than a
shingle are one shingle. Of repeated rows exactly one stays. A null id sorts after all others. Columns of the input with the names of added
columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import python_words, text_or_empty, without
from quizspark.llm.components import component_roots
from quizspark.plans.storage import written

MAX_BITS = 4
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
ADDED = ["fingerprint", "component_id", "kept"]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key_masks() -> list[int]:
    """All unions of as many blocks as a linked pair must share."""
    ends = np.cumsum(BLOCKS).tolist()
    blocks = [((1 << size) - 1) << (end - size) for size, end in zip(BLOCKS, ends)]
    return [sum(c) for c in combinations(blocks, len(BLOCKS) - MAX_BITS)]


KEY_MASKS = _key_masks()


def shingle_spans(w: list[bytes], words: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined, and where each of their shingles starts and stops."""
    k = min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    return b" ".join(w), np.concatenate([[0], ends[:-1]])[:len(w) - k + 1].tolist(), (ends[k - 1:] - 1).tolist()


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """A bit is set if it is in more than half of the hashes of all shingles, repeats included."""
    w = python_words(text)
    if not w:
        return 0
    joined, starts, stops = shingle_spans(w, words)
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 14):
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i:i + (1 << 14)], stops[i:i + (1 << 14)])], "<u8")
        total += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, words)) for t in texts], dtype="int64")
    return of(text)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of at most MAX_BITS bits that span what all such links connect."""
    left, links = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= MAX_BITS
            if near.any():
                found = left[near]
                links += [(at, x) for x in found]
                todo += list(found)
                left = left[~near]
    return links


_LINKS = pa.schema({"key": pa.int32(), "a": pa.int64(), "b": pa.int64()})


def _linker(bucket: int):
    """Rows sorted by key, then fingerprint, to links (key -1), or the rows themselves where a key has too many."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key, a, b):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(a.view("i8"), pa.int64()), pa.array(b.view("i8"), pa.int64())], schema=_LINKS)

        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        large = None  # the key whose rows are passing through
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cols[2] = cols[2].view("u8")
            if large is not None:
                same = (cols[0] == large[0]) & (cols[1] == large[1])
                n = int(same.sum())
                if n:
                    yield out(cols[0][:n], cols[2][:n], cols[2][:n])
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                large = None
            cols = [np.concatenate(x) for x in zip(held, cols)]
            yield from _runs(cols, out)
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1:].sum() + 1) if (
                (cols[0][0], cols[1][0]) != (cols[0][-1], cols[1][-1])) else 0
            held = [c[last:] for c in cols]
            if len(held[0]) > bucket:
                large = held[0][0], held[1][0]
                yield out(held[0], held[2], held[2])
                held = [c[:0] for c in held]
        if len(held[0]):
            yield from _runs(held, out, end=True)

    def _runs(cols, out, end=False):
        """Links of all runs of a key but the last, which may go on, or of all at the end."""
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        starts = np.concatenate([[0], new])
        stops = np.concatenate([new, [len(cols[0])]])
        if not end:
            starts, stops = starts[:-1], stops[:-1]
        size = stops - starts
        two = starts[size == 2]
        a, b = cols[2][two], cols[2][two + 1]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        links = [np.column_stack([a[near], b[near]])]
        for i, j in zip(starts[size > 2].tolist(), stops[size > 2].tolist()):
            if j - i > bucket:
                yield out(cols[0][i:j], cols[2][i:j], cols[2][i:j])
            elif found := forest(cols[2][i:j]):
                links.append(np.array(found, np.uint64))
        links = np.concatenate(links)
        if len(links):
            yield out(np.full(len(links), -1, np.int32), links[:, 0].copy(), links[:, 1].copy())

    return link


def _through_midpoints(crowded: DataFrame) -> DataFrame:
    """Links among the fingerprints of large keys: those that share a point at half the distance from both.

    The table of bit flips has a fixed number of rows, below 25 000.
    """
    flips = [(k, _signed(sum(1 << i for i in c))) for k, mask in enumerate(KEY_MASKS)
             for r in range(MAX_BITS // 2 + 1) for c in combinations([i for i in range(64) if not mask >> i & 1], r)]
    flips = crowded.sparkSession.createDataFrame(flips, "key int, flip long")
    points = (crowded.join(F.broadcast(flips), "key")
              .select(F.col("a").bitwiseXOR(F.col("flip")).alias("point"), F.col("a").alias("b")).distinct())
    first = points.groupBy("point").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a != z").select("point", "a")
    return points.join(first, "point").where("a != b").select("a", "b").distinct()


def fingerprint_links(fps: DataFrame, bucket: int = 2000) -> DataFrame:
    """``a, b``: links that connect whatever links of at most MAX_BITS bits connect; ``fps`` has distinct ``fp``."""
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in KEY_MASKS]))
    keyed = (fps.select("fp", keys.alias("key", "bits")).select("key", "bits", "fp")
             .repartition("key", "bits").sortWithinPartitions("key", "bits", "fp"))
    found = written(keyed.mapInArrow(_linker(bucket), "key int, a long, b long"), "simhash-links")
    direct = found.where("key = -1").select("a", "b").distinct()
    crowded = found.where("key >= 0").select("key", "a").distinct()
    return direct.unionByName(_through_midpoints(crowded)) if crowded.limit(1).count() else direct


def _tagged(docs: DataFrame, carry: list[str], words: int) -> DataFrame:
    """The columns to keep, with fingerprint and a tag per row, written once."""
    rows = without(docs, ["__fp", "__row"]).withColumn("__fp", fingerprint_column(text_or_empty(), words))
    return written(rows.select(*carry, "__fp", F.monotonically_increasing_id().alias("__row")), "simhash")


def firsts(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each fingerprint ``__least``: id and tag of the first row of its component; ``links`` makes the links of distinct ``fp``."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    of_fp = rows.groupBy("__fp").agg(F.min(first).alias("__first"))
    roots = component_roots(links(of_fp.select(F.col("__fp").alias("fp"))))
    of_fp = (of_fp.join(roots, F.col("__fp") == F.col("node"), "left")
             .select("__fp", "__first", F.coalesce("root", "__fp").alias("__root")))
    of_root = of_fp.groupBy("__root").agg(F.min("__first").alias("__least"))
    return of_fp.select("__fp", "__root").join(of_root, "__root").select("__fp", "__least")


def link_documents(docs: DataFrame, carry: list[str] | None = None, words: int = 4, bucket: int = 2000) -> DataFrame:
    """Every row with ``fingerprint`` (long), ``component_id`` (smallest id reachable) and ``kept`` (one row a component).

    ``carry`` names the columns to return besides; all by default.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    rows = _tagged(docs, carry, words)
    return rows.join(firsts(rows, lambda fps: fingerprint_links(fps, bucket)), "__fp").select(
        *carry, F.col("__fp").alias("fingerprint"), F.col("__least.id").alias("component_id"),
        (F.col("__row") == F.col("__least.row")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, bucket: int = 2000) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    What goes is found on tags and fingerprints alone; the tags are written before the rows meet them, so Spark broadcasts them when they are few.
    """
    rows = _tagged(docs, docs.columns, words)
    gone = rows.select("__row", "__fp").join(firsts(rows, lambda fps: fingerprint_links(fps, bucket)), "__fp").where(F.col("__row") != F.col("__least.row")).select("__row")
    return rows.join(written(gone, "near-duplicates"), "__row", "left_anti").select(*docs.columns)
