"""The quality classifier and the language model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizspark.llm import ngram, quality

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels, carry=["doc_id"]).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_no_label_one_class_and_edges(make, spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "word " * 60_000), (4, "same"), (4, "same"), (5, "A B c 1 . !")]
    docs = make(rows).withColumn("score", F.lit("old"))
    schema = "doc_id long, quality int, toxic int"
    for labels, mean in (([], 0.5), ([(1, 1, 0), (3, 1, 0)], 1.0), ([(None, 1, 0), (99, 0, 0), (1, None, 0)], 0.5)):
        got = quality.score_documents(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(rows) and {r.score for r in got} == {mean}
    got = quality.score_documents(docs, spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 0), (5, 1, 1), (5, 1, 1)], schema)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(make([]), spark.createDataFrame([], schema)).count() == 0


def test_pools_are_the_monotone_least_squares_fit():
    rng = np.random.default_rng(0)
    w, y = rng.integers(1, 5, 40).astype(float), rng.normal(size=40) + np.arange(40) / 30
    got = quality.pooled(w, w * y)
    low = [[np.average(y[i:j + 1], weights=w[i:j + 1]) if j >= i else 0 for j in range(40)] for i in range(40)]
    expected = [max(min(low[i][j] for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(got, expected) and (np.diff(got) >= 0).all()


def plain_scores(rows):
    """The same model with dictionaries."""
    def tokens(text):
        return (text or "").encode().lower().split() + [b"\n"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    words, pairs = Counter(), Counter()
    for i, text in rows:
        if not held[i]:
            w = tokens(text)
            words.update(w)
            pairs.update(zip([None, *w], w))
    n, v = sum(words.values()), len(words)
    before, after = Counter(b for _, b in pairs), defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in pairs.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1

    def discounts(counts):
        n = Counter(counts)
        y, out = (n[1] / (n[1] + 2 * n[2]) if n[1] else 0), [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5
            out.append(d if 0 < d < k else 0.5)
        return out

    d2, d1 = discounts(pairs.values()), discounts(before.values())
    rest = sum(d1[min(c, 3)] for c in before.values())

    def p1(b):
        return (before[b] - d1[min(before[b], 3)] + rest / (v + 1)) / len(pairs) if pairs else 1 / (v + 1)

    def p2(a, b):
        if a not in after:
            return p1(b)
        s, c = after[a], pairs[a, b]
        return (c - d2[min(c, 3)] + sum(d2[k] * s[k] for k in (1, 2, 3)) * p1(b)) / s[0]

    out = []
    for i, text in rows:
        w = tokens(text)
        out.append((i, held[i], len(w), sum(x in words for x in w), n, sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
                    sum(math.log10(p2(a, b)) for a, b in zip([None, *w], w))))
    assert not pairs or abs(sum(p1(b) for b in words) + rest / (v + 1) / len(pairs) - 1) < 1e-9
    return out


@pytest.mark.parametrize("case", ["documents", "edges", "all held out", "empty"])
def test_scores(spark, make, case):
    rows = {"documents": [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()],
            "edges": [(1, None), (2, ""), (None, "Ä b A"), (3, "the the the " * 20_000), (4, "x y"), (4, "x y"), (8, "unseen words"), (9, "x y\nx z")],
            "all held out": [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "empty": []}[case]
    docs = make(rows).withColumn("score", F.lit("old"))
    got = ngram.score_documents(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    expected = plain_scores(rows)
    assert len(got) == len(expected)
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key)):
        assert g[:5] == e[:5] and np.allclose(g[5:], e[5:], rtol=1e-9, atol=1e-9), (g, e)
