"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays, mapped into memory to score.

1. Words are counted. Each range of word hashes is one shard of the vocabulary, a sorted array; a word's number is its place in all shards.
2. Word pairs are counted by their two numbers in one 64-bit key. A shard holds a range of first words, sorted. First words with
   so many tokens that a shard would grow out of bounds are divided further by their second word.
3. How many different words precede a word is added up by the second word.
4. Workers map the arrays and score whole texts: discounted pair counts, what they leave over spread by the discounted
   number of predecessors, and what that leaves spread evenly over all words and the unknown one.

Tasks sum what they meet in arrays of bounded size before they pass it on as packed rows of a shard. A shard is written under a name of the task's own
and renamed, so a repeated task replaces it by the same bytes. The driver sees one row per shard. The files lie in the
shared folder, which must be mounted on all executors.

Tokens are the words of a text, A-Z in lower case, and one end sign. Null text counts as empty. Rows without an id are used for training. Repeated rows count each time.
Without any training token all words are the unknown word. Columns of the input with the names of added columns are replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import shared_path, text_or_empty, without
from quizspark.llm.tokens import chunks
from quizspark.plans.storage import written

ADDED = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
HELD_PAIRS = 3_000_000
PAYLOAD = pa.schema({"shard": pa.int32(), "a": pa.binary(), "b": pa.binary(), "n": pa.binary()})
PAYLOAD_SQL = "shard int, a binary, b binary, n binary"


def _texts(batch: pa.RecordBatch) -> Iterator[list[str]]:
    texts = batch.column("text").to_numpy(zero_copy_only=False).tolist()
    for first, last in chunks(texts):
        yield [t or "" for t in texts[first:last]]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's place among the distinct words, the distinct words' hashes, and where each text's words start."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    words = cut.flatten().dictionary_encode()
    each = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))
    codes, starts = words.indices.to_numpy(zero_copy_only=False), cut.offsets.to_numpy()
    real = np.array([w != b"" for w in each], bool)  # Arrow's cut leaves an empty word beside outer white space
    if not real.all():
        stay = real[codes]
        codes, starts = (np.cumsum(real) - 1)[codes[stay]], np.concatenate([[0], np.cumsum(stay)])[starts]
    return codes, hashes[real], starts


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def save(folder: str, name: str, values: np.ndarray) -> None:
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    values.tofile(own)
    os.replace(own, f"{folder}/{name}")


def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


class Maps(OrderedDict):
    """Arrays mapped by this process, the latest ``MOST`` of them; not sent with what holds it."""

    MOST = 512

    def get_map(self, folder: str, name: str, kind: str) -> np.ndarray:
        if name in self:
            self.move_to_end(name)
        else:
            self[name] = mapped(folder, name, kind)
            if len(self) > self.MOST:
                self.popitem(last=False)
        return self[name]

    def __reduce__(self):
        return Maps, ()


def packed(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, its width first."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns cut by shard; order within a shard is kept."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    cuts = [np.split(c[order], starts[1:]) for c in columns]
    for i, s in enumerate(starts):
        yield int(shard[s]), *[c[i] for c in cuts]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PAYLOAD.types)], schema=PAYLOAD)


@dataclass
class Layout:
    """Where things are: sizes of the vocabulary's shards, numbers of words with shards of their own, and how many each has."""
    folder: str
    shards: int
    sizes: np.ndarray
    tokens: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.n_words = int(self.starts[-1])
        self.maps = Maps()
        if self.n_words >= (1 << 32) - 1:
            raise ValueError("more words than 32 bits can number")

    @staticmethod
    def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for those not in the vocabulary."""
        out = np.full(len(hashes), -1, np.int64)
        for s, part, at in by_shard(self.word_shard(hashes, self.shards), hashes, np.arange(len(hashes))):
            if not self.sizes[s]:
                continue
            words = self.maps.get_map(self.folder, f"words-{s}", "<u8")
            found = np.minimum(np.searchsorted(words, part), self.sizes[s] - 1)
            known = words[found] == part
            out[at[known]] = self.starts[s] + found[known]
        return out

    def range_of(self, shard: int) -> tuple[int, int]:
        """Numbers of first words in a shard that is not a hot word's; the begin sign is number ``n_words``."""
        n = self.n_words + 1
        return -(-shard * n // self.shards), -(-(shard + 1) * n // self.shards)

    def pair_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shard = a * self.shards // (self.n_words + 1)
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
            own = self.hot[i] == a
            first = self.shards + np.concatenate([[0], np.cumsum(self.parts)[:-1]])
            shard[own] = first[i[own]] + b[own] * self.parts[i[own]] // max(1, self.n_words)
        return shard

    def end(self) -> int:
        return int(self.numbers(np.array([END], np.uint64))[0])

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all tokens, of the token before each, and the text each belongs to."""
        codes, hashes, starts = coded(texts)
        numbers = self.numbers(hashes)[codes] if len(codes) else np.zeros(0, np.int64)
        sizes = np.diff(starts)
        text = np.repeat(np.arange(len(texts)), sizes + 1)
        token = np.full(len(text), self.end(), np.int64)
        at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), sizes)
        token[at] = numbers
        before = np.concatenate([[self.n_words], token[:-1]])[:len(token)]
        before[np.flatnonzero(np.diff(text, prepend=-1))] = self.n_words
        return token, before, text


def _count_words(shards: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            return keys, counts

        def out(keys, counts):
            return _rows([(s, b"", k.tobytes(), packed(c)) for s, k, c in by_shard(Layout.word_shard(keys, shards), keys, counts)])

        for batch in batches:
            for texts in _texts(batch):
                codes, hashes, _ = coded(texts)
                held.append((np.append(hashes, np.uint64(END)), np.append(np.bincount(codes, minlength=len(hashes)), len(texts))))
                if sum(len(k) for k, _ in held) > HELD_PAIRS:
                    held.append(flush())
                    if len(held[0][0]) > HELD_PAIRS // 2:
                        yield out(*held.pop())
        if held:
            yield out(*flush())
    return count


def _write_words(folder: str):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, counts = summed(np.concatenate([np.frombuffer(b, "<u8") for b in rows["b"]]), np.concatenate([unpacked(n) for n in rows["n"]]))
        save(folder, f"words-{key[0]}", words)
        save(folder, f"counts-{key[0]}", counts.astype("<u8"))
        return pd.DataFrame({"shard": [key[0]], "size": [len(words)], "tokens": [int(counts.sum())]})
    return write


def _hot_words(layout: Layout, quota: float):
    """Words with more tokens than ``quota``; there are fewer than tokens / quota of them."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["id"]:
                if layout.sizes[s]:
                    counts = mapped(layout.folder, f"counts-{s}", "<u8")
                    at = np.flatnonzero(counts > quota)
                    yield pd.DataFrame({"number": layout.starts[s] + at, "n": counts[at].astype(np.int64)})
    return find


def _count_pairs(layout: Layout):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            a, b = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            rows = []
            for s, a, b, n in by_shard(layout.pair_shard(a, b), a, b, counts):
                firsts, runs = np.unique(a, return_counts=True)
                rows.append((s, np.uint64(len(firsts)).tobytes() + firsts.astype("<u4").tobytes() + packed(runs), b.astype("<u4").tobytes(), packed(n)))
            return _rows(rows)

        for batch in batches:
            for texts in _texts(batch):
                token, before, _ = layout.sequences(texts)
                held.append(before.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64))
                if sum(map(len, held)) > HELD_PAIRS:
                    yield flush()
        if held:
            yield flush()
    return count


def _keys(a: bytes, b: bytes) -> np.ndarray:
    n = int(np.frombuffer(a, "<u8", 1)[0])
    firsts = np.repeat(np.frombuffer(a, "<u4", n, 8), unpacked(a[8 + 4 * n:]))
    return firsts.astype(np.uint64) << np.uint64(32) | np.frombuffer(b, "<u4").astype(np.uint64)


def _spectrum(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, and how many are 3 or more."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)
    return [*n[1:5].tolist(), int(n[3:].sum())]


SPECTRUM = "n1 long, n2 long, n3 long, n4 long, more long"


def _write_pairs(layout: Layout):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        keys, counts = summed(np.concatenate([_keys(a, b) for a, b in zip(rows["a"], rows["b"])]), np.concatenate([unpacked(n) for n in rows["n"]]))
        save(layout.folder, f"pairs-{shard}", keys)
        save(layout.folder, f"pair-counts-{shard}", counts.astype("<u4"))
        first = (keys >> np.uint64(32)).astype(np.int64)
        low, high = (int(first[0]), int(first[0]) + 1) if shard >= layout.shards else layout.range_of(shard)
        stats = np.stack([np.bincount(first - low, w, high - low) for w in (counts, counts == 1, counts == 2, counts >= 3)], 1)
        save(layout.folder, f"contexts-{shard}", stats.astype("<f8"))
        seen, n = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        parts = [(s, seen.astype("<u4").tobytes(), packed(n)) for s, seen, n in
                 by_shard(seen.astype(np.int64) * layout.shards // (layout.n_words + 1), seen, n)]
        out = pd.DataFrame(parts, columns=["to", "b", "n"])
        head = pd.DataFrame([(-1, b"", b"")], columns=["to", "b", "n"])
        out = pd.concat([head, out], ignore_index=True)
        out["shard"], out["first"] = shard, low
        for name, v in zip(("n1", "n2", "n3", "n4", "more"), _spectrum(counts)):
            out[name] = v
        return out[["shard", "to", "b", "n", "first", "n1", "n2", "n3", "n4", "more"]]
    return write


def _write_preceding(layout: Layout):
    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = layout.range_of(int(key[0]))
        counts = np.zeros(high - low, np.int64)
        for b, n in zip(rows["b"], rows["n"]):
            counts[np.frombuffer(b, "<u4").astype(np.int64) - low] += unpacked(n)
        save(layout.folder, f"preceding-{key[0]}", counts.astype("<u4"))
        return pd.DataFrame([(int(key[0]), int(counts.sum()), *_spectrum(counts))], columns=["shard", "total", "n1", "n2", "n3", "n4", "more"])
    return write


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more; a half where the counts of counts are too few to estimate one."""
    out = [0.0]
    y = n1 / (n1 + 2 * n2) if n1 else 0
    for k, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * high / low if low and high else 0.5
        out.append(d if 0 < d < k else 0.5)
    return np.array(out)


@dataclass
class Model:
    layout: Layout
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pairs: int  # distinct pairs
    word_rest: float  # what the discounts of the words leave over
    hot_stats: np.ndarray  # of words with shards of their own: tokens, followers seen once, twice, more often
    shards: frozenset
    preceding: frozenset

    def _file(self, name: str, shard: int, kind: str) -> np.ndarray:
        return self.layout.maps.get_map(self.layout.folder, f"{name}-{shard}", kind)

    def _dense(self, name: str, kind: str, numbers: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of a table kept in shards by ranges of words; zeros where a shard has none."""
        out = np.zeros((len(numbers), width))
        have = self.shards if name == "contexts" else self.preceding
        for s, n, at in by_shard(numbers * self.layout.shards // (self.layout.n_words + 1), numbers, np.arange(len(numbers))):
            if s in have:
                out[at] = self._file(name, s, kind).reshape(-1, width)[n - self.layout.range_of(s)[0]]
        return out

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers))
        starts = self.layout.starts
        for s, n, at in by_shard(np.searchsorted(starts, numbers, "right") - 1, numbers, np.arange(len(numbers))):
            out[at] = self._file("counts", s, "<u8")[n - starts[s]]
        return out

    def word_probability(self, numbers: np.ndarray) -> np.ndarray:
        """From the number of different words before each; -1 is the unknown word."""
        even = self.word_rest / (self.layout.n_words + 1)
        if not self.pairs:
            return np.full(len(numbers), 1 / (self.layout.n_words + 1))
        known = numbers >= 0
        n = np.zeros(len(numbers))
        n[known] = self._dense("preceding", "<u4", numbers[known])[:, 0]
        return (n - self.word_discounts[np.minimum(n, 3).astype(int)] + even) / self.pairs

    def pair_counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts of pairs of known words, given in ascending order of both."""
        out = np.zeros(len(a))
        for s, key, at in by_shard(self.layout.pair_shard(a, b), a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), np.arange(len(a))):
            if s in self.shards:
                keys = self._file("pairs", s, "<u8")
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = keys[found] == key
                out[at[same]] = self._file("pair-counts", s, "<u4")[found[same]]
        return out

    def contexts(self, a: np.ndarray) -> np.ndarray:
        out = self._dense("contexts", "<f8", a, 4)
        hot = self.layout.hot
        if len(hot):
            i = np.minimum(np.searchsorted(hot, a), len(hot) - 1)
            own = hot[i] == a
            out[own] = self.hot_stats[i[own]]
        return out

    def log10(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log probability of each token after the one before it."""
        keys, back = np.unique((before + 1).astype(np.uint64) << np.uint64(33) | (token + 1).astype(np.uint64), return_inverse=True)
        a, b = (keys >> np.uint64(33)).astype(np.int64) - 1, (keys & np.uint64((1 << 33) - 1)).astype(np.int64) - 1
        words, at = np.unique(b, return_inverse=True)
        p = self.word_probability(words)[at]
        firsts, at = np.unique(a[a >= 0], return_inverse=True)
        stats = np.zeros((len(a), 4))
        stats[a >= 0] = self.contexts(firsts)[at]
        count = np.zeros(len(a))
        both = (a >= 0) & (b >= 0)
        count[both] = self.pair_counts(a[both], b[both])
        seen = stats[:, 0] > 0
        left = stats[seen, 1:] @ self.pair_discounts[1:]
        p[seen] = (count[seen] - self.pair_discounts[np.minimum(count[seen], 3).astype(int)] + left * p[seen]) / stats[seen, 0]
        return np.log10(p)[back]


def train(texts: DataFrame, shards: int | None = None) -> Model:
    """A model of the column ``text``; its files lie in a new folder of the shared folder.

    There are as many shards as shuffle partitions, unless given; one task holds one shard.
    """
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_path(spark, "ngram")
    os.makedirs(folder, exist_ok=True)
    texts = texts.select("text")

    sizes, tokens = np.zeros(shards, np.int64), 0
    counted = texts.mapInArrow(_count_words(shards), PAYLOAD_SQL).groupBy("shard")
    for r in counted.applyInPandas(_write_words(folder), "shard int, size long, tokens long").collect():
        sizes[r["shard"]] = r["size"]
        tokens += r["tokens"]
    layout = Layout(folder, shards, sizes, tokens)
    quota = max(1.0, tokens / (4 * shards))
    hot = sorted((r["number"], r["n"]) for r in spark.range(shards).mapInPandas(_hot_words(layout, quota), "number long, n long").collect())
    layout.hot = np.array([h for h, _ in hot], np.int64)
    layout.parts = np.array([int(n // quota) + 1 for _, n in hot], np.int64)

    pairs = (texts.mapInArrow(_count_pairs(layout), PAYLOAD_SQL).groupBy("shard")
             .applyInPandas(_write_pairs(layout), f"shard int, to int, b binary, n binary, first long, {SPECTRUM}"))
    pairs = written(pairs, "ngram-pairs")
    found = pairs.where("to < 0").drop("b", "n").collect()
    preceding = (pairs.where("to >= 0").select("to", "b", "n").groupBy("to")
                 .applyInPandas(_write_preceding(layout), f"shard int, total long, {SPECTRUM}").collect())

    def spectrum(rows) -> list[int]:
        return [sum(r[n] for r in rows) for n in ("n1", "n2", "n3", "n4", "more")]

    of_pairs, of_words = spectrum(found), spectrum(preceding)
    d = discounts(*of_words[:4])
    hot_stats = np.zeros((len(hot), 4))
    for r in found:
        if r["shard"] >= shards:
            hot_stats[np.searchsorted(layout.hot, r["first"])] += mapped(folder, f"contexts-{r['shard']}", "<f8")
    return Model(layout, discounts(*of_pairs[:4]), d, sum(r["total"] for r in preceding), float(d[1] * of_words[0] + d[2] * of_words[1] + d[3] * of_words[4]),
                 hot_stats, frozenset(r["shard"] for r in found), frozenset(r["shard"] for r in preceding))


def scored(model: Model, texts: list[str]) -> pd.DataFrame:
    layout = model.layout
    token, before, text = layout.sequences(texts)
    words, at = np.unique(token, return_inverse=True)
    known = words >= 0
    counts = np.zeros(len(words))
    counts[known] = model.word_counts(words[known])
    base = np.log10((counts + 0.5) / (layout.tokens + 0.5 * (layout.n_words + 1)))[at]
    n = len(texts)
    return pd.DataFrame({"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, known[at], n).astype(np.int64),
                         "base_score": np.bincount(text, base, n), "score": np.bincount(text, model.log10(before, token), n)})


def held_out(doc_id: Column) -> Column:
    """One of five rows by the checksum of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Every row with the model's ``score`` and ``base_score``, learned from the rows that are not ``held_out``.

    Scores are sums of log10 probabilities over a text's tokens; the perplexity is 10 to the power of -score / n_tokens.
    """
    docs = without(docs, ADDED)
    model = train(docs.where(~held_out(F.col("doc_id"))))

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            items = series.tolist()
            yield pd.concat([scored(model, items[i:j]) for i, j in chunks(items)] or [scored(model, [])], ignore_index=True)

    return docs.withColumn("__s", scores(text_or_empty())).select(
        *docs.columns, held_out(F.col("doc_id")).alias("held_out"), F.col("__s.n_tokens"), F.col("__s.n_known"),
        F.lit(model.layout.tokens).cast("long").alias("train_tokens"), F.col("__s.base_score"), F.col("__s.score"))
