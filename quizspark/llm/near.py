"""Near-duplicates by word-shingle similarity: SimHash links, then MinHash bands for what they don't reach, every candidate confirmed on its shingle sets, components.

A text stands for the set of its distinct shingles; two are near copies when the sets share ``least`` of their union or more. The links of the
64-bit SimHash of op5 (its fingerprints, blocks and verified distance) come first. They can't reach 0.8, where a pair differs in about ten bits, so texts still apart
are also met in MinHash bands: a pair shares one of 25 keys of five minima each with a chance of 0.99995 at 0.8, and more above. Equal sets are merged before.

First each key's set of smallest hash is compared with the others of the key, so a group of near copies is linked by one comparison a member. Sets of a key that are still apart
are compared with each other where at most ``LIMIT`` share the key. Keys that more share stand for a common passage. Their sets go through an exact prefix filter: with a set's
shingles ordered from the rarest among these sets to the most frequent, two near copies share one of the first fifth, so those are the keys, and a place that leaves too few
shingles behind it, or sizes too unlike, rule a pair out before anything is read. A passage's shingles come last, so texts that have only the passage in common share no key.
Shingles of one set alone are no keys and are counted only. Keys that many share even so go the same way, ``GROWTH`` times as many sets a round, and no key is left out.
Candidates and links are ids alone; shingles are written once, for texts with a candidate, and met by ordinary joins. Texts are not written again: rows are known by id and text hash until the end.
Before texts or shingles meet a table of ids they go through its sieve, two bits an id of at most ``SIEVE_BITS``, so that those without a partner aren't shuffled; the join decides.

Null text counts as empty; texts without words are equal sets. Texts with fewer words than a shingle are one shingle. Of repeated rows
exactly one stays. A null id sorts after all others. Columns of the input may have any names. An empty table gives an empty result. Hashes of shingles, sets and texts have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import python_words, text_or_empty
from quizspark.llm.components import component_roots
from quizspark.llm.simhash import fingerprint_column, fingerprint_links, shingle_spans
from quizspark.plans.storage import written

BANDS, ROWS = 25, 5
LIMIT, GROWTH = 32, 32
SIEVE_BITS, SIEVE_BLOCK = 1 << 27, 1 << 15


class Bands:
    """Keys of a set: one per band, from the minima of its permutations."""

    def __init__(self, bands: int, rows: int, seed: int) -> None:
        odd = np.random.default_rng(seed).integers(0, 1 << 64, bands * rows + rows + 1, np.uint64) | np.uint64(1)
        self.shape = (bands, rows)
        self.permute, self.join, self.mix = odd[:bands * rows, None], odd[bands * rows:-1], odd[-1]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.shape[0] * self.shape[1], np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(least, (shingles[None, i:i + 1024] * self.permute).min(1), out=least)
        keys = (least.reshape(self.shape) * self.join).sum(1, dtype=np.uint64) + np.arange(self.shape[0], dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(32))) * self.mix
        return (keys ^ (keys >> np.uint64(29))).view(np.int64)


FIRST = Bands(BANDS, ROWS, 42)


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    w = python_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    joined, starts, stops = shingle_spans(w, words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def _sketch(text: Column, words: int) -> Column:
    @F.pandas_udf("fp long, n int, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, words)
            rows.append((np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64), len(s), FIRST.keys(s) if len(s) else s.view(np.int64)))
        return pd.DataFrame(rows, columns=["fp", "n", "keys"])
    return of(text)


def _shingles(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts], dtype=object)
    return of(text)


def _candidates(each: DataFrame) -> DataFrame:
    """``key, fp, n, at, size, low, u`` of every key that several sets share, from ``key, fp, n, at``; ``u`` orders the sets, from 0 to 1, ``low`` is its least in the key.

    ``at`` is the number of the set's shingles that stand before the key, 0 where keys have no order.
    """
    u = F.xxhash64("fp").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(u).alias("low")).where("size > 1")
    return written(each.join(written(shared, "near-keys"), "key").select("key", "fp", "n", "at", "size", "low", u.alias("u")), "near-candidates")


def _sieve(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes that all of ``ids`` (one column of them) pass, and about one in seventy of others; more of them where ``SIEVE_BITS`` are few for the ids."""
    size = min(SIEVE_BITS, max(SIEVE_BLOCK, 1 << (16 * ids.count()).bit_length()))
    first = F.col(ids.columns[0])
    places = F.array(first.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(first, 32).bitwiseAND(F.lit(size - 1)))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        of = np.zeros(SIEVE_BLOCK, bool)
        of[frame["place"].to_numpy() % SIEVE_BLOCK] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(of, bitorder="little").tobytes()]})

    blocks = ids.select(F.explode(places).alias("place")).distinct().groupBy(F.floor(F.col("place") / SIEVE_BLOCK).alias("block")).applyInPandas(packed, "block long, bits binary")
    bits = np.zeros((size // SIEVE_BLOCK, SIEVE_BLOCK // 8), np.uint8)
    for r in blocks.collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    send = ids.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def may(hashes: pd.Series) -> pd.Series:
        h, both = hashes.to_numpy().view("u8"), np.ones(len(hashes), np.uint8)
        for place in (h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)):
            both &= send.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)
        return pd.Series((both & 1) == 1)
    return may


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``key, fp, n, at`` for the shingles that a set shares with others among its first ``n - ceil(least * n) + 1``, rarest first, from ``fp, h``."""
    n = F.size("h").alias("n")
    each = sets.select("fp", n, F.explode("h").alias("key"))
    often = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-often")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    by_set = each.join(often, "key").groupBy("fp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("shared"))
    by_set = by_set.withColumn("alone", F.col("n") - F.size("shared")).where(F.col("alone") < first)
    keys = F.slice("shared", F.lit(1), (first - F.col("alone")).cast("int"))
    return by_set.select("fp", "n", "alone", F.posexplode(keys)).select(F.col("col.key").alias("key"), "fp", "n", (F.col("alone") + F.col("pos")).alias("at"))


def _taken(turn: int) -> Column:
    """Sets that are compared with all others of their narrow key by the end of a round."""
    some = (F.col("u") == F.col("low")) | (F.col("size") <= LIMIT)
    return some if turn == 0 else some | (F.col("u") * F.col("size") < LIMIT * GROWTH ** (turn - 1))


def _rooted(held: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The sets with the ``root`` of their component."""
    if roots is None:
        return held.withColumn("root", F.col("fp"))
    return held.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def _apart(held: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """The sets, with their ``root``, of keys whose sets are not in one component; None where there are none."""
    now = _rooted(held, roots)
    keys = now.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    now = written(now.join(keys, "key", "left_semi"), "near-open")
    return None if now.isEmpty() else now


def _pairs(now: DataFrame, before: Column, taken: Column, least: float) -> DataFrame:
    """Pairs ``a, b`` of a key, in two components, of a set that is ``taken`` and was not ``before`` and another; sizes and places must allow the similarity."""
    fresh = taken & ~before
    heads = now.where(fresh).select("key", F.col("fp").alias("a"), F.col("n").alias("a_n"), F.col("root").alias("a_root"), F.col("at").alias("a_at"))
    others = now.where(~before).select("key", F.col("fp").alias("b"), "n", "root", "at", fresh.alias("both"))
    fits = F.least(F.col("n") - F.col("at"), F.col("a_n") - F.col("a_at")) >= (F.col("n") + F.col("a_n")) * F.lit(least / (1 + least)) - 1e-6
    fits = fits & (F.least("n", "a_n") >= F.greatest("n", "a_n") * F.lit(least - 1e-9))
    met = others.join(heads, "key").where((F.col("a_root") != F.col("root")) & fits & (F.col("a") != F.col("b")) & (~F.col("both") | (F.col("a") < F.col("b"))))
    return met.select("a", "b")


def _joined(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None, least: float) -> DataFrame | None:
    """Components after the pairs were confirmed on their shingle sets; earlier links are kept as one star a component."""
    pairs = written(pairs.distinct(), "near-pairs")
    sets = sets.where(_sieve(pairs.select("a").union(pairs.select("b")).distinct())(F.col("fp")))
    met = pairs.join(sets.select(F.col("fp").alias("b"), F.col("h").alias("b_h")), "b").join(sets.select(F.col("fp").alias("a"), F.col("h").alias("a_h")), "a")
    met = met.select("a", "b", F.size(F.array_intersect("b_h", "a_h")).alias("both"), (F.size("a_h") + F.size("b_h")).alias("sum"))
    found = written(met.where(F.col("both") / (F.col("sum") - F.col("both")) >= least).select("a", "b"), "near-links")
    if found.isEmpty():
        return roots
    return component_roots(found if roots is None else found.unionByName(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _simhash_pairs(known: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets whose fingerprints the links of op5 connect; of the sets with one fingerprint the smallest stands for all."""
    of_bits = written(known.groupBy("bits").agg(F.min("fp").alias("a")), "near-fingerprints")
    equal = known.select("bits", F.col("fp").alias("b")).distinct().join(of_bits, "bits").where("a != b").select("a", "b")
    links = written(fingerprint_links(of_bits.select(F.col("bits").alias("fp"))).select(F.col("a").alias("x"), F.col("b").alias("y")), "near-simhash")
    links = links.join(of_bits.withColumnRenamed("bits", "x"), "x").join(of_bits.select(F.col("bits").alias("y"), F.col("a").alias("b")), "y").where("a != b")
    return written(equal.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "near-simhash-pairs")


def similar_components(known: DataFrame, of_fp: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame | None:
    """``node, root`` of the components that candidates of similarity ``least`` make.

    ``known`` has ``fp, bits`` of the rows of ``docs``, ``of_fp`` the ``fp, n, keys`` of each set and the ``id, hash`` of one of its rows as ``least``.
    """
    linked = _simhash_pairs(known)
    held = _candidates(of_fp.select(F.explode(F.array_distinct("keys")).alias("key"), "fp", "n", F.lit(0).alias("at")))
    ids = held.select("fp").union(linked.select("a")).union(linked.select("b")).distinct()
    one = written(of_fp.select("fp", "least.id", "least.hash").join(ids, "fp").select(_who(F.col("id")).alias("who"), "hash", "fp"), "near-ids")
    texts = docs.select(F.col("doc_id").alias("__id"), text_or_empty().alias("text")).select(_who(F.col("__id")).alias("who"), F.xxhash64("text").alias("hash"), "text")
    texts = texts.where(_sieve(one.select(F.xxhash64("who", "hash")))(F.xxhash64("who", "hash")))
    texts = texts.join(one, ["who", "hash"]).dropDuplicates(["who", "hash"])
    sets = written(texts.select("fp", _shingles(F.col("text"), words).alias("h")), "near-shingles")
    roots = _joined(linked, sets, None, least)
    head = F.col("u") == F.col("low")
    roots = _joined(_pairs(_rooted(held, roots), F.lit(False), head, least), sets, roots, least)
    now = _apart(held.where("size > 2"), roots)
    if now is None:
        return roots
    pairs, crowd = _pairs(now.where(F.col("size") <= LIMIT), head, F.lit(True), least), now.where(F.col("size") > LIMIT)
    if crowd.isEmpty():
        return _joined(pairs, sets, roots, least)
    narrow = _candidates(_prefixes(written(sets.join(crowd.select("fp").distinct(), "fp", "left_semi"), "near-crowd"), least))
    roots = _joined(pairs.unionByName(_pairs(_rooted(narrow, roots), F.lit(False), _taken(0), least)), sets, roots, least)
    turn = 1
    while (now := _apart(narrow.where(F.col("size") > LIMIT * GROWTH ** max(0, turn - 2)), roots)) is not None:
        roots = _joined(_pairs(now, _taken(turn - 1), _taken(turn), least), sets, roots, least)
        turn += 1
    return roots


def _who(id: Column) -> Column:
    """An id as text, that of null too."""
    return F.coalesce(F.concat(F.lit("#"), id.cast("string")), F.lit(""))


def _found(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Documents (``__id, __text``) that are, or are not, among the rows (``id, hash``)."""
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.xxhash64("__text") == F.col("hash"))
    return docs.join(rows, same, how)


def drop_near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row, that of the smallest id, of each group of near-duplicates, with the columns of ``docs``.

    What goes is found on ids and hashes; only rows that pass the sieve of those that go or repeat meet them, so the other texts aren't shuffled.
    """
    text = text_or_empty()
    sketched = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), _sketch(text, words).alias("s"), fingerprint_column(text, words).alias("bits"))
    known = written(sketched.select("id", "hash", "s.fp", "s.n", "s.keys", "bits"), "near")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    of_fp = written(known.groupBy("fp").agg(F.min(first).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-sets")
    roots = similar_components(known, of_fp, docs, words, least)
    if roots is None:
        of_fp = of_fp.withColumn("root", F.col("fp"))
    else:
        of_fp = of_fp.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    keep = of_fp.select("fp", "root").join(of_fp.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")
    judged = known.select("id", "hash", "fp").join(keep, "fp").withColumn("stays", F.struct(F.col("id").isNull().alias("none"), "id", "hash") == F.col("least"))
    fate = judged.groupBy("id", "hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies")).where("not stays or copies > 1")
    fate = written(fate, "near-duplicates")
    named = [F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*named, F.col("doc_id").alias("__id"), text.alias("__text"))
    may = _sieve(fate.select(F.xxhash64("id", "hash")))(F.xxhash64("__id", F.xxhash64("__text")))
    some = rows.where(may)
    out = rows.where(~may).unionByName(_found(some, fate, "left_anti"))
    again = _found(some, fate.where("stays").select("id", "hash"), "inner")
    out = out.select(*[f"c_{i}" for i in range(len(docs.columns))])
    if fate.where("stays").limit(1).count():
        out = out.unionByName(again.dropDuplicates(["__id", "hash"]).select(*out.columns))
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
