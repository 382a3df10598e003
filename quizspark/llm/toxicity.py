"""Convolutional text classifier for toxicity: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

A word is lower-cased, keeps its letters alone, and has the sum of the vectors of its hashed parts: the word itself and its first ``STEMS`` letters. Filters over one,
two and three words run along the whole text; each keeps its greatest value, so a single passage shows in a text of any length, and a logistic layer weighs them. Only the words at the greatest values
get a gradient, which makes a step of training cheap.

Every labelled row outside the held-out fold is learnt from, its whole text. The rows are dealt by a hash to groups of about ``GROUP_ROWS`` and written once, as the buckets of
their words. In a round each group goes once through its rows, from the same network, and what the groups changed is averaged, each number over the groups that changed it, so
a word of one group alone learns as fast as others. The changes are summed in slices, so the driver gets one network a round. A
fifth of the rows is set apart: it stops the training, scales the scores to probabilities, and gives each language the threshold with
the best F1 (languages with fewer than ``LEAST_POSITIVE`` toxic rows there share that of all); for both, all its scores are counted in ``BINS`` bins. Every text is scored, by whoever
reads it, without a shuffle.

``score`` and ``predicted`` (from a half on) know nothing of the language; ``threshold`` and ``flagged`` hold the language's own cut. Null and empty texts have no words and get
the score of an empty text. Rows with the same id share the label, repeated labels count as their mean (from a half on: toxic); null labels and labels without a document have no
effect; rows without an id never train. Ties of the hash go by id and text. Without labels, or with one class only, every score is the mean label (0.5 without
any). Columns of the input with the names of added columns are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.tokens import chunks
from quizspark.plans.storage import written

ADDED = ["held_out", "score", "predicted", "threshold", "flagged"]
GROUP_ROWS, SLICES, BLOCK_WORDS = 32_768, 32, 1_000_000
LEAST_POSITIVE = 20
BUCKETS, SIZE = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 16
STEMS = (5, 7)
EPOCHS, PATIENCE, BATCH, RATE = 12, 2, 32, 0.05
CHARS = 1_000_000
BINS, MOST = 1 << 14, 30.0
FEW_LABELS = 1_000_000
LEAST_GAIN = 0.01
_NOT_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
_GAP = max(WIDTHS) - 1


class Words:
    """Buckets of the parts of words met so far; row 0 stands for what has no letters and for the gap between texts."""

    BLOCK = 20_000

    def __init__(self, limit: int | None = 400_000) -> None:
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.parts = np.full((1, 1 + len(STEMS)), BUCKETS, np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        if self.limit and len(self.known) + len(words) > self.limit:
            self.clear()
        new = [w for w in words if w not in self.known]
        found = [self.parts]
        size = len(self.parts)
        for at in range(0, len(new), self.BLOCK):
            block = new[at:at + self.BLOCK]
            letters = _NOT_LETTERS.sub("", "\n".join(block).lower()).split("\n")  # no word has a line's end
            some = list(filter(None, letters))
            parts = np.empty((len(some), 1 + len(STEMS)), np.int32)
            for k, stems in enumerate((some, *([w[:n] for w in some] for n in STEMS))):
                parts[:, k] = np.fromiter(map(xxhash.xxh64_intdigest, stems, repeat(k)), np.uint64, len(some)) % np.uint64(BUCKETS)
            places = np.zeros(len(block), np.int64)
            places[np.fromiter(map(len, letters), np.int64, len(block)) > 0] = np.arange(size, size + len(some))
            self.known.update(zip(block, places.tolist()))
            found.append(parts)
            size += len(some)
        if new:
            self.parts = np.vstack(found)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def laid(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words, first those of the gap; the words of all texts with a gap after each; and where each text starts."""
    cut = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    flat = cut.flatten().dictionary_encode()
    rows = np.append(0, words.rows(flat.dictionary.to_pylist()))
    offsets = cut.offsets.to_numpy()
    starts = offsets[:-1] - offsets[0] + np.arange(len(texts)) * _GAP
    out = np.zeros(len(flat) + len(texts) * _GAP, np.int64)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)) * _GAP, np.diff(offsets))] = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return words.parts[rows], out, starts


def _seen(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct of some numbers below ``n``, in order, and the place of each number among them."""
    seen = np.flatnonzero(np.bincount(words, minlength=n))
    place = np.empty(n, np.int64)
    place[seen] = np.arange(len(seen))
    return seen, place[words]


@dataclass
class Network:
    vectors: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float

    @classmethod
    def start(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.05, (BUCKETS + 1, SIZE)).astype(np.float32)
        vectors[BUCKETS] = 0
        filters = [rng.normal(0, (w * SIZE) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(vectors, filters, np.zeros(n, np.float32), rng.normal(0, n ** -0.5, n).astype(np.float32), 0.0)

    def copy(self) -> "Network":
        return Network(self.vectors.copy(), [f.copy() for f in self.filters], self.bias.copy(), self.out.copy(), self.base)

    def flat(self) -> np.ndarray:
        """All numbers in one row."""
        return np.concatenate([x.ravel() for x in (self.vectors, *self.filters, self.bias, self.out, np.array([self.base], np.float32))])

    @classmethod
    def of_flat(cls, numbers: np.ndarray) -> "Network":
        shapes = [(BUCKETS + 1, SIZE), *[(w, SIZE, FILTERS) for w in WIDTHS], (FILTERS * len(WIDTHS),), (FILTERS * len(WIDTHS),), (1,)]
        cut = np.split(numbers.astype(np.float32), np.cumsum([np.prod(x) for x in shapes])[:-1])
        vectors, *filters, bias, out, base = [c.reshape(x) for c, x in zip(cut, shapes)]
        return cls(vectors, filters, bias, out, float(base[0]))

    def embedded(self, parts: np.ndarray) -> np.ndarray:
        return self.vectors[parts].sum(1)

    def filtered(self, embedded: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
        """Values of the filters of one width at each word and the words before it, a row per word."""
        total = np.take(embedded @ self.filters[k][0], words, axis=0)
        for j in range(1, WIDTHS[k]):
            total[j:] += np.take(embedded @ self.filters[k][j], words[:-j], axis=0)
        return total

    def pooled(self, embedded: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Greatest values per text, a row per text. The gap keeps a filter from reading the text before."""
        return np.hstack([np.maximum.reduceat(self.filtered(embedded, words, k), starts, axis=0) for k in range(len(WIDTHS))])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base

    def of_words(self, texts: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
        """Logits of texts that are laid already, each with the gap after it."""
        seen, words = _seen(np.concatenate(texts), len(parts))
        starts = np.append(0, np.cumsum(list(map(len, texts)))[:-1])
        return self.logits(self.pooled(self.embedded(parts[seen]), words, starts))

    def raw(self, texts: list[str | None], words: Words) -> np.ndarray:
        parts, laid_out, starts = laid(texts, words)
        return self.logits(self.pooled(self.embedded(parts), laid_out, starts)).astype(np.float64)


class Steps:
    """Adagrad: each parameter's step shrinks with the gradients it has had."""

    def __init__(self, net: Network) -> None:
        self.net, self.had = net, Network(*[np.full_like(x, 1e-3) for x in (net.vectors,)], [np.full_like(f, 1e-3) for f in net.filters],
                                          np.full_like(net.bias, 1e-3), np.full_like(net.out, 1e-3), 1e-3)

    def step(self, texts: list[np.ndarray], parts: np.ndarray, labels: np.ndarray) -> None:
        """One step on a batch of texts, each the numbers of its words with the gap after it; ``parts`` has the buckets of the words."""
        net, had = self.net, self.had
        stops = np.cumsum(list(map(len, texts)))
        seen, words = _seen(np.concatenate(texts), len(parts))
        embedded = net.embedded(parts[seen])
        tops, places = [], []
        for k in range(len(WIDTHS)):
            values = net.filtered(embedded, words, k)
            places.append(np.stack([b - len(t) + values[b - len(t):b].argmax(0) for t, b in zip(texts, stops)]))
            tops.append(np.take_along_axis(values, places[-1], 0))
        active = np.maximum(np.hstack(tops) + net.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.base, -30, 30)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * net.out * (active > 0)
        hit, grads = [], []
        for k, width in enumerate(WIDTHS):
            mine = back[:, k * FILTERS:(k + 1) * FILTERS]
            d_filters = np.empty_like(net.filters[k])
            for j in range(width):
                word = words[places[k] - j]  # before the first word the index goes round to the gap at the end
                d_filters[j] = np.einsum("bf,bfs->sf", mine, embedded[word])
                hit.append(seen[word].ravel())
                grads.append((mine[:, :, None] * net.filters[k][j].T).reshape(-1, SIZE))
            had.filters[k] += d_filters ** 2
            net.filters[k] -= RATE * d_filters / np.sqrt(had.filters[k])
        for name, grad in (("out", error @ active), ("bias", back.sum(0))):
            setattr(had, name, getattr(had, name) + grad ** 2)
            setattr(net, name, getattr(net, name) - RATE * grad / np.sqrt(getattr(had, name)))
        had.base += float(error.sum()) ** 2
        net.base -= RATE * float(error.sum()) / had.base ** 0.5
        bucket = parts[np.concatenate(hit)].ravel()
        order = np.argsort(bucket, kind="stable")
        grad = np.repeat(np.concatenate(grads), parts.shape[1], axis=0)[order]
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        bucket, grad = bucket[order][first], np.add.reduceat(grad, first, axis=0)
        had.vectors[bucket] += grad ** 2
        net.vectors[bucket] -= RATE * grad / np.sqrt(had.vectors[bucket])
        net.vectors[BUCKETS] = 0


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def scaled(logits: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift that make probabilities of the logits, by Newton steps on the likelihood; the slope stays positive. ``y`` of ``n`` rows are toxic, one row by default."""
    a, b = 1.0, 0.0
    n = np.ones(len(logits)) if n is None else n
    x = np.column_stack([logits, np.ones(len(logits))])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = x.T @ (n * p - y) + np.array([a - 1, b])
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2)
        da, db = np.linalg.solve(h, g)
        a, b = max(0.05, a - da), b - db
    return float(a), float(b)


def best_threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The cut with the greatest F1, halfway between the scores beside it; a half where there is nothing to choose. ``y`` of ``n`` rows are toxic, one row by default."""
    if not y.any():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    taken = np.cumsum(np.ones(len(s)) if n is None else n[order])
    f1 = 2 * hits / (taken + y.sum())
    last = np.append(s[:-1] > s[1:], True)
    i = int(np.argmax(np.where(last, f1, -1)))
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i] / 2)


@dataclass
class Model:
    net: Network | None
    scale: tuple[float, float]
    mean: float
    thresholds: dict[str | None, float]
    threshold: float

    def score(self, texts: list[str | None], words: Words) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.mean)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.net.raw(texts, words) + b, -30, 30)))


def fold(doc_id: Column) -> Column:
    """0 to 4 by the checksum of the id as text; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0)).cast("int")


_WORDS = Words()


def _encoded(text: Column) -> Column:
    """Buckets of the words of a text, two bytes each, with the gap after them."""
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        texts, rows = texts.tolist(), []
        for a, b in chunks(texts, CHARS):
            parts, words, starts = laid(texts[a:b], _WORDS)
            rows += [x.tobytes() for x in np.split(parts.astype("<u2")[words], starts[1:])]
        return pd.Series(rows, dtype=object)
    return of(text)


def learnable(docs: DataFrame, labels: DataFrame, lang: str | None) -> DataFrame:
    """``grp, hash, id, apart, toxic, lang, words`` of all labelled rows outside fold 0, equal rows once, a group's rows together in the order of a hash.

    Up to ``FEW_LABELS`` labels are broadcast, so that texts without one aren't shuffled; more are met by an ordinary join.
    """
    known = (labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
             .groupBy(F.col("doc_id").alias("__id")).agg((F.avg("toxic") >= 0.5).alias("toxic")))
    known = written(known, "toxicity-labels")
    known = F.broadcast(known) if known.count() <= FEW_LABELS else known
    docs = docs.where(fold(F.col("doc_id")) != 0)
    groups = max(1, round(docs.select("doc_id").join(known, F.col("doc_id") == F.col("__id")).count() / GROUP_ROWS))
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"))
    own = own.join(known, F.col("id") == F.col("__id")).withColumn("hash", F.xxhash64("id", "text", "lang"))
    apart = F.pmod(F.xxhash64(F.lit("apart"), "hash"), F.lit(5)) == 4
    rows = own.select(F.pmod("hash", F.lit(groups)).cast("int").alias("grp"), "hash", "id", apart.alias("apart"), "toxic", "lang", _encoded(F.col("text")).alias("words"))
    rows = rows.repartition(groups, "grp").dropDuplicates(["grp", "hash", "id"]).sortWithinPartitions("grp", "hash", "id")
    return written(rows, "toxicity-rows")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Places of rows of some ``BLOCK_WORDS`` words, the buckets of their distinct words, and each row as numbers of its words."""
    sizes = pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64) // (2 * (1 + len(STEMS)))
    texts = batch.column("words").to_pylist()
    ends = np.cumsum(sizes)
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // BLOCK_WORDS)) + 1):
        if len(at):
            parts = np.frombuffer(b"".join(texts[at[0]:at[-1] + 1]), "<u2").reshape(-1, 1 + len(STEMS)).astype(np.int64)
            words, distinct = pd.factorize(parts @ (1 << 16) ** np.arange(1 + len(STEMS)))
            order = np.argsort(distinct)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            parts = (distinct[order][:, None] >> 16 * np.arange(1 + len(STEMS))) & 0xFFFF
            yield at, parts.astype(np.int32), np.split(place[words], np.cumsum(sizes[at])[:-1])


def _logits(net: Network, texts: list[np.ndarray], parts: np.ndarray) -> np.ndarray:
    return np.concatenate([net.of_words(texts[i:i + BATCH], parts) for i in range(0, len(texts), BATCH)] or [np.zeros(0)]).astype(np.float64)


def _learner(send, epoch: int, learn: bool, all_fit: bool, all_held: bool):
    """Rows of groups to what each group's pass changes, in slices, and the loss of the rows set apart under the network before it (slice -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, had = send.value
        start, group, steps, rng, first = Network.of_flat(numbers), None, None, None, 0
        loss, held = 0.0, 0

        def rows(values):
            cols = list(zip(*values))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                                              names=["slice", "first", "moved", "grown"])

        def done():
            if learn and steps is not None:
                moved, grown = steps.net.flat() - numbers, steps.had.flat() - had
                yield rows([(k, first, m.tobytes(), g.tobytes()) for k, (m, g) in enumerate(zip(np.array_split(moved, SLICES), np.array_split(grown, SLICES)))])

        for batch in batches:
            groups = batch.column("grp").to_numpy()
            for at in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(groups)) + 1):
                if not len(at):
                    continue
                some = batch.slice(at[0], len(at))
                if groups[at[0]] != group:
                    yield from done()
                    group, first = groups[at[0]], some.column("hash")[0].as_py()
                    steps, rng = Steps(Network.of_flat(numbers)), np.random.default_rng([epoch, int(group)])
                    steps.had = Network.of_flat(had)
                apart = some.column("apart").to_numpy(zero_copy_only=False)
                y = some.column("toxic").to_numpy(zero_copy_only=False).astype(np.float64)
                for of, parts, texts in _blocks(some):
                    out = np.flatnonzero(apart[of] | all_held)
                    if epoch:
                        loss += _loss(_logits(start, [texts[i] for i in out], parts), y[of][out]) * len(out) if len(out) else 0.0
                        held += len(out)
                    order = rng.permutation(np.flatnonzero(~apart[of] | all_fit)) if learn else np.zeros(0, int)
                    for i in range(0, len(order), BATCH):
                        steps.step([texts[j] for j in order[i:i + BATCH]], parts, y[of][order[i:i + BATCH]])
        yield from done()
        if held:
            yield rows([(-1, first, np.array([loss, held]).tobytes(), b"")])
    return run


def _averaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each number's mean change over the groups that changed it, by slice; the sums of losses and rows of slice -1."""
    at, sums = None, []

    def out():
        if at is None:
            return
        if at < 0:
            yield pd.DataFrame({"slice": [at], "moved": [sums[0].tobytes()], "grown": [b""]})
        else:
            n = np.maximum(sums[2], 1)
            yield pd.DataFrame({"slice": [at], "moved": [(sums[0] / n).astype("<f4").tobytes()], "grown": [(sums[1] / n).astype("<f4").tobytes()]})

    for batch in batches:
        for k, moved, grown in zip(batch["slice"], batch["moved"], batch["grown"]):
            if k != at:
                yield from out()
                at, sums = k, [0.0, 0.0, 0]
            if k < 0:
                sums[0] = sums[0] + np.frombuffer(moved)
            else:
                grown = np.frombuffer(grown, "<f4")
                sums = [sums[0] + np.frombuffer(moved, "<f4").astype(np.float64), sums[1] + grown.astype(np.float64), sums[2] + (grown > 0)]
    yield from out()


def _round(rows: DataFrame, numbers: np.ndarray, had: np.ndarray, epoch: int, learn: bool, all_fit: bool, all_held: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss of the rows set apart under a network (from the second round on), and the network and its sums of squares after one more pass of all groups."""
    send = rows.sparkSession.sparkContext.broadcast((numbers, had))
    each = rows.mapInArrow(_learner(send, epoch, learn, all_fit, all_held), "slice int, first long, moved binary, grown binary")
    each = each.repartition(SLICES, "slice").sortWithinPartitions("slice", "first").mapInPandas(_averaged, "slice int, moved binary, grown binary")
    found = {r["slice"]: r for r in each.collect()}
    send.unpersist()
    loss, n = np.frombuffer(found[-1]["moved"]) if -1 in found else (0.0, 1)
    if learn:
        numbers, had = [old + np.concatenate([np.frombuffer(found[k][c], "<f4") for k in range(SLICES)]) for old, c in ((numbers, "moved"), (had, "grown"))]
    return float(loss / n), numbers, had


def _counted(rows: DataFrame, net: Network, all_held: bool) -> DataFrame:
    """``lang, bin, n, y, total`` of the logits of the rows set apart; ``total`` is their sum in 2**-20."""
    send = rows.sparkSession.sparkContext.broadcast(net)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, parts, texts in _blocks(batch):
                some = batch.slice(at[0], len(at))
                yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("toxic"), pa.array(_logits(send.value, texts, parts))], names=["lang", "toxic", "logit"])

    held = rows if all_held else rows.where("apart")
    held = held.select("lang", "toxic", "words").mapInArrow(of, f"lang {rows.schema['lang'].dataType.simpleString()}, toxic boolean, logit double")
    near = F.least(F.greatest("logit", F.lit(-MOST)), F.lit(MOST))
    return held.groupBy("lang", F.floor((near + MOST) * F.lit(BINS / (2 * MOST))).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("y"), F.sum(F.round(near * F.lit(1 << 20)).cast("long")).alias("total"))


def train(rows: DataFrame, seed: int = 11, epochs: int = EPOCHS) -> Model:
    """A model from all rows of ``learnable``; those apart calibrate."""
    y, apart = F.col("toxic").cast("long"), F.col("apart").cast("long")
    n, toxic, held, fit = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(y), F.lit(0)), F.coalesce(F.sum(apart), F.lit(0)), F.coalesce(F.sum(y * (1 - apart)), F.lit(0))).first()
    if toxic in (0, n):
        return Model(None, (1.0, 0.0), toxic / n if n else 0.5, {}, 0.5)
    net = Network.start(seed)
    numbers, had = net.flat(), np.full(len(net.flat()), 1e-3, np.float32)
    best, waited = (np.inf, numbers), 0
    for epoch in range(epochs + 1):
        before = numbers
        loss, numbers, had = _round(rows, numbers, had, epoch, epoch < epochs, not fit, not held)
        if epoch:
            waited = 0 if loss < best[0] * (1 - LEAST_GAIN) else waited + 1
            best = (loss, before) if loss < best[0] else best
            if waited == PATIENCE:
                break
    net = Network.of_flat(best[1])
    counted = written(_counted(rows, net, not held), "toxicity-scores")

    def arrays(found: list) -> list[np.ndarray]:
        return [np.array([r[c] for r in found], float) for c in ("total", "y", "n")]

    def sums(of: DataFrame, *keys: str) -> DataFrame:
        return of.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "y", "n")])

    total, y, n_held = arrays(sums(counted, "bin").orderBy("bin").collect())
    a, b = scaled(total / n_held / (1 << 20), y, n_held)

    def cut(total: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        return best_threshold(1 / (1 + np.exp(-np.clip(a * total / n / (1 << 20) + b, -30, 30))), y, n)

    often = sums(counted, "lang").where(F.col("y") >= LEAST_POSITIVE).select(F.col("lang").alias("name"))
    by_lang: dict = {}
    for r in counted.join(often, F.col("lang").eqNullSafe(F.col("name")), "left_semi").orderBy("lang", "bin").collect():
        by_lang.setdefault(r["lang"], []).append(r)
    return Model(net, (a, b), toxic / n, {lang: cut(*arrays(found)) for lang, found in by_lang.items()}, cut(total, y, n_held))


def score_documents(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, lang: str = "lang") -> DataFrame:
    """Every row with ``held_out`` (boolean), ``score`` (0 to 1), ``predicted`` (int), the ``threshold`` of its language and ``flagged`` (boolean).

    Labels count only where the row's ``fold`` is not 0. ``labels`` has ``doc_id, toxic``; without a column ``lang`` all share one threshold.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    has_lang = lang in docs.columns
    model = train(learnable(docs, labels, lang if has_lang else None))
    send = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        texts = texts.tolist()
        return pd.Series(np.concatenate([send.value.score(texts[a:b], _WORDS) for a, b in chunks(texts, CHARS)] or [np.zeros(0)]))

    threshold = F.lit(model.threshold)
    for name, own in model.thresholds.items():
        threshold = F.when(F.col(lang).eqNullSafe(F.lit(name)), own).otherwise(threshold) if has_lang else threshold
    scored = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)], (fold(F.col("doc_id")) == 0).alias("held_out"),
                         score(F.coalesce("text", F.lit(""))).alias("score"), threshold.alias("threshold"))
    return scored.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
