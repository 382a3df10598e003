"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of each whole text are computed once and written as a narrow table. The random features approximate a Gaussian kernel
over the standardised statistics; each partition sums its normal equations, sums of sums come together in steps, and the driver solves one system of fixed size.
Two thirds of the fitting rows make the scores, the rest calibrates them: their scores are counted in a fixed number of bins, pooled to be
monotone, and interpolated between the pools so that the order of scores is kept.

Every labelled fitting row is used. Rows with the same id share the label, repeated labels count once, differing ones as their mean; null labels and labels without a
document have no effect. Null text counts as empty. Without any label, or with one class only, every score is the mean label (0.5 without any). Columns of
the input with the names of added columns are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quizspark.llm.common import python_words, text_or_empty
from quizspark.plans.storage import written

ADDED = ["score", "predicted"]
N_STATS = 20
N_FEATURES = 256
BINS = 4096


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text: lengths, shares of kinds of characters, repetition, line shapes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = python_words(text), [x for x in raw.split(b"\n") if x.strip()]
    n, c = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / c
    often = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    top = [x for _, x in often.most_common(5)]
    return [np.log1p(len(raw)), np.log1p(len(words)), *kinds[:8].tolist(), float(sizes.mean()), float(sizes.std()),
            len(often) / n, len(often) / n ** 0.75, (top[0] if top else 0) / n, sum(top) / n, pairs,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines)))]


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 lower-case, 1 upper-case, 2 digit, 3 white space, 4 . and comma, 5 other end signs, 6 other ASCII, 7 rest."""
    kind = np.full(256, 6, np.uint8)
    kind[128:] = 7
    for k, signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,", b"!?;:")):
        kind[list(signs)] = k
    return kind


_KIND = _kinds()


def with_statistics(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])
    return docs.withColumn("__stats", of(text_or_empty()))


def fold(doc_id: Column) -> Column:
    """0, 1 or 2 by the checksum of the id as text; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0)).cast("int")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.waves + self.shifts) * np.sqrt(2 / len(self.shifts))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def _stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["__stats"].tolist(), np.float64).reshape(-1, N_STATS)


def summed(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum over all rows of the vectors that ``per_batch`` makes of batches; at most 32 vectors reach the driver."""
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += per_batch(batch)
        yield pd.DataFrame({"v": [total.tobytes()]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    parts = rows.mapInPandas(first, "v binary")
    parts = parts.repartition(32).mapInPandas(again, "v binary")
    return sum((np.frombuffer(r["v"]) for r in parts.collect()), np.zeros(size))


def pooled(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Means that never fall, nearest in least squares: neighbours that violate the order are pooled."""
    pools: list[list[float]] = []
    for w, t in zip(weight.tolist(), total.tolist()):
        pools.append([w, t, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w2, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + w2, pools[-1][1] + t2, pools[-1][2] + n2]
    return np.repeat([t / w for w, t, _ in pools], [n for _, _, n in pools])


def _knots(centres: np.ndarray, weight: np.ndarray, total: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of the calibration: each pool's mean score and mean label, drawn a little towards the prior."""
    level = pooled(weight, total)
    first = np.concatenate([[True], np.diff(level) > 0]) if len(level) else np.zeros(0, bool)
    pool = np.cumsum(first) - 1
    w = np.bincount(pool, weight)
    x, y = np.bincount(pool, weight * centres) / w, (np.bincount(pool, total) + prior) / (w + 1)
    y = np.maximum.accumulate(y)
    ends = [x[0] - 1, *x, x[-1] + 1]
    return np.array(ends), np.array([y[0] * 0.9, *y, y[-1] + (1 - y[-1]) * 0.1])


def fit(rows: DataFrame, ridge: float = 1e-3, gamma: float = 0.05, seed: int = 7) -> Model | float:
    """A model from rows with ``_stats, label, fit`` (boolean: makes the scores, else calibrates); the mean label where one class is missing."""
    def moments(b: pd.DataFrame) -> np.ndarray:
        x, y = _stacked(b), b["label"].to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])

    sums = summed(rows.select("__stats", "label"), moments, 2 + 2 * N_STATS)
    n, positive = sums[:2]
    if n == 0 or positive in (0, n):
        return float(positive / n) if n else 0.5
    mean = sums[2:2 + N_STATS] / n
    scale = np.sqrt(np.maximum(sums[2 + N_STATS:] / n - mean ** 2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (N_STATS, N_FEATURES)), rng.uniform(0, 2 * np.pi, N_FEATURES), np.zeros(0),
                  (np.zeros(1), np.zeros(1)))
    d = N_FEATURES + N_STATS + 1
    upper = np.triu_indices(d)

    def normal(b: pd.DataFrame) -> np.ndarray:
        x, y = model.features(_stacked(b)), b["label"].to_numpy()
        return np.concatenate([(x.T @ x)[upper], x.T @ y])

    sums = summed(rows.where("fit").select("__stats", "label"), normal, len(upper[0]) + d)
    gram = np.zeros((d, d))
    gram[upper] = sums[:-d]
    gram = gram + np.triu(gram, 1).T
    weights = np.linalg.solve(gram + np.eye(d) * ridge * max(1.0, n), sums[-d:])
    model = Model(model.mean, model.scale, model.waves, model.shifts, weights, model.knots)

    def histogram(b: pd.DataFrame) -> np.ndarray:
        x, y = model.raw(_stacked(b)), b["label"].to_numpy()
        at = np.clip(((x + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    sums = summed(rows.where("not fit").select("__stats", "label"), histogram, 2 * BINS)
    weight, total = sums[:BINS], sums[BINS:]
    seen = weight > 0
    centres = (np.arange(BINS) + 0.5) / BINS * 3 - 1
    if not seen.any():
        return Model(model.mean, model.scale, model.waves, model.shifts, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    return Model(model.mean, model.scale, model.waves, model.shifts, weights,
                 _knots(centres[seen], weight[seen], total[seen], positive / n))


def score_documents(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row with ``held_out`` (boolean), ``score`` (0 to 1) and ``predicted`` (int).

    Labels count only where the row's ``fold`` is not 1. ``labels`` has ``doc_id, quality``.
    """
    carry = [c for c in (carry or docs.columns) if c.lower() not in [*ADDED, "held_out"]]
    rows = written(with_statistics(docs).select(*carry, "__stats"), "quality")
    known = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.avg("quality").alias("label")).withColumnRenamed("doc_id", "__id"))
    fitting = (rows.where(fold(F.col("doc_id")) != 1).join(known, F.col("doc_id") == F.col("__id"))
               .select("__stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("fit")))
    model = fit(written(fitting, "quality-fit"))
    send = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        m = send.value
        if isinstance(m, float):
            return pd.Series(np.full(len(stats), m))
        return pd.Series(m.score(np.array(stats.tolist(), np.float64).reshape(-1, N_STATS)))

    return (rows.select(*carry, (fold(F.col("doc_id")) == 1).alias("held_out"), score("__stats").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, with the columns of ``docs``."""
    columns = docs.columns
    return score_documents(docs, labels).where("predicted = 1").select(*columns)
