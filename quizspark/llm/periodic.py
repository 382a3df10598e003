"""Periodic runs of words: branching tandem repeats over an enhanced suffix array, rotated and merged into runs.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that can't be extended
to either side. Each text is treated on its own, by whoever reads it; nothing is shuffled. Many texts of a batch share one suffix array: words are numbered
per stretch of text, and each stretch ends with a number of its own, so no common prefix reaches past a stretch.

1. A word of a run stands in it ``times`` times or more. Rarer words cut a text into stretches, twice; what is left is exact, not a sample.
2. Prefix doubling sorts the suffixes; the ranks of each step are kept, and give the LCP array, and later extensions, by halving steps.
3. An LCP value d between two neighbours in the suffix array joins the part left of it with the part right of it, up to the next smaller values: the children of an
   LCP interval, two by two, without nodes of a tree. For each suffix i of the smaller part, ISA[i+d] or ISA[i-d] in the other part is a
   square of period d that the next word ends. The smaller parts have n log n suffixes together at most.
4. A square of the wanted length has its two left neighbours in the same part. What passes is rotated to the left as far as the words allow;
   squares that make the same stretch are one run, of the least of their periods.

Memory follows the longest text or a batch of ``CHARS`` characters: some 60 bytes a word that step 1 leaves, and four more for each doubling, of
which there are log2 of the longest repeat. Null and empty texts have no words and no runs. Ties don't occur: stretch and period identify a run. Repeated rows
are treated each. Columns of the input with the names of added columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import without
from quizspark.llm.tokens import chunks, ranges

ADDED = ["runs", "collapsed"]
CHARS = 1_000_000
AT_ONCE = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])
SQL_TYPE = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def numbered(words: list[bytes], of: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words of the same text only."""
    fresh = count()
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, next(fresh)) for w in words), np.int64, len(words))
    return np.unique(of * (len(words) + 1) + codes, return_inverse=True)[1]


def frequent_stretches(codes: np.ndarray, of: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that occur often enough in their stretch, and the stretch of each; short stretches are left out."""
    at = np.arange(len(codes))
    for _ in range(2):
        if not len(at):
            break
        often = np.bincount(codes)[codes] >= times
        at, of = at[often], of[often]
        if not len(at):
            break
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(of) != 0)])
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch)[stretch] >= least
        at, stretch, codes = at[long], stretch[long], codes[often][long]
        of = stretch
        if len(at):
            codes = np.unique(stretch * (codes.max() + 1) + codes, return_inverse=True)[1]
    return at, of


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, and for each step s ranks that are equal where the next 2**s numbers are. The last number must be unique."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    held = codes[order]
    first = np.concatenate([[True], held[1:] != held[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        key = rank[open_] * n + rank[open_ + step]
        by_key = np.argsort(key, kind="stable")
        open_, key = open_[by_key], key[by_key]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        place = old + at - np.maximum.accumulate(np.where(group, at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[open_] = place[np.maximum.accumulate(np.where(new, at, 0))]
        levels.append(rank.astype(np.int32))
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa, rank, levels


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at ``a`` and ``b``, pairwise."""
    length = np.zeros(len(a), np.int64)
    some = np.flatnonzero(levels[0][a] == levels[0][b])
    for s in range(len(levels) - 1, -1, -1):
        x, y = a[some] + length[some], b[some] + length[some]
        length[some] += (levels[s][x] == levels[s][y]).astype(np.int64) << s
    return length


def parts(lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each neighbouring pair, where the part left of it begins and where the part right of it ends."""
    left, right = [0] * len(lcp), [0] * len(lcp)
    waiting: list[int] = []
    for j, d in enumerate(lcp):
        while waiting and lcp[waiting[-1]] >= d:
            right[waiting.pop()] = j
        left[j] = waiting[-1] if waiting else 0
        waiting.append(j)
    for j in waiting:
        right[j] = len(lcp)
    return left, right


def squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares ended by the next word, with ``times - 2`` more periods before them."""
    n = len(sa)
    left, right = (np.array(x, np.int64) for x in parts(lcp.tolist()))
    j = np.flatnonzero((lcp > 0) & (right - left >= times))
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, high, d = left[j], right[j], lcp[j]
    small_left = j - low <= high - j
    begin, size = np.where(small_left, low, j), np.where(small_left, j - low, high - j)
    other, other_end = np.where(small_left, j, low), np.where(small_left, high, j)
    done = np.cumsum(size)
    at = 0
    while at < len(j):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, "right")))
        cut = slice(at, to)
        i = sa[ranges(begin[cut], size[cut])]
        p, lo, hi = (np.repeat(x[cut], size[cut]) for x in (d, other, other_end))
        whole_lo, whole_hi = (np.repeat(x[cut], size[cut]) for x in (low, high))
        for begin_at, partner in ((i, i + p), (i - p, i - p)):
            met = isa[np.clip(partner, 0, n - 1)]
            ok = (begin_at >= 0) & (partner >= 0) & (partner < n) & (met >= lo) & (met < hi)
            for k in range(1, times - 1):
                before = begin_at - k * p
                met = isa[np.maximum(before, 0)]
                ok &= (before >= 0) & (met >= whole_lo) & (met < whole_hi)
            starts.append(begin_at[ok])
            periods.append(p[ok])
        at = to
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(words: list[bytes], of: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of texts laid one after the other, in order of start; ``of`` is the text of each word."""
    none = np.zeros(0, np.int64)
    if not words:
        return none, none, none
    codes = numbered(words, of)
    at, stretch = frequent_stretches(codes, of, times, least)
    if not len(at):
        return none, none, none
    ends = np.flatnonzero(np.diff(stretch, append=stretch[-1] + 1))
    own = np.unique(stretch * (codes.max() + 1) + codes[at], return_inverse=True)[1]
    laid = np.insert(own, ends + 1, own.max() + 1 + np.arange(len(ends)))
    place = np.insert(at, ends + 1, -1)
    sa, isa, levels = suffix_array(laid)
    lcp = np.concatenate([[0], common_prefixes(sa[:-1], sa[1:], levels)])
    start, period = squares(sa, isa, lcp, times)
    end = start + 2 * period
    for s in range(len(levels) - 1, -1, -1):
        to = start - (1 << s)
        ok = to >= 0
        ok[ok] = levels[s][to[ok]] == levels[s][to[ok] + period[ok]]
        start = np.where(ok, to, start)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) if len(start) else np.zeros(0, bool)
    one &= end - start >= np.maximum(least, times * period)
    start, length, period = start[one], (end - start)[one], period[one]
    return place[start], length, period


def _treated(texts: list[str | None], times: int, least: int) -> tuple[list[int], list[tuple], list[str]]:
    """For each text the number of its runs and what is left of it; and all runs, in order."""
    cut = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(cut)), sizes)
    words = [w for ws in cut for w in ws]
    start, length, period = find_runs(words, of, times, least)
    rest = length - period
    owner = of[start] if len(start) else start
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + period + rest, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    per_text = np.bincount(owner, minlength=len(cut)).tolist()
    left = []
    for k, ws in enumerate(cut):
        if per_text[k]:
            gone = dropped[firsts[k]:firsts[k + 1]]
            ws = [ws[i] for i in np.flatnonzero(~gone).tolist()]
        left.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
    return per_text, list(zip((start - firsts[owner]).tolist(), length.tolist(), period.tolist())), left


def treated(texts: pa.Array, times: int = 4, least: int = 6) -> pa.Array:
    """Struct of ``runs`` and ``collapsed`` for each text."""
    rows = texts.to_pylist()
    sizes, runs, left = [], [], []
    for first, last in chunks(rows, CHARS):
        n, found, rest = _treated(rows[first:last], times, least)
        sizes += n
        runs += found
        left += rest
    flat = pa.StructArray.from_arrays([pa.array([r[k] for r in runs], pa.int64()) for k in range(3)], fields=list(RUN))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array(left, pa.string())], fields=list(FOUND))


def mark_runs(docs: DataFrame, text: Column | str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """Every row with ``runs`` (array of start, length and period in words, by start and period) and ``collapsed``: its words without those that
    follow the first period of a run, joined by single spaces."""
    @F.arrow_udf(SQL_TYPE)
    def of(texts: pa.Array) -> pa.Array:
        return treated(texts, times, least)

    text = F.col(text) if isinstance(text, str) else text
    rows = docs.withColumn("__found", of(text))
    return without(rows, ADDED).select("*", "__found.runs", "__found.collapsed").drop("__found")
