"""Centroid clustering against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from quizspark.llm import centroids

COLUMNS = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, size, k, rounds, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    return [(i, j, d, sum(e for _, e, l in out if l == j), total, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in out]


def test_equals_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1, 0, 2]) + rng.gauss(0, 0.2) for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, [0.5] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan] * 4),
                                      (904, [math.inf, 0.0, 0.0, 0.0]), (905, []), (906, [-0.0001, 0.0, 1e5, -1e5])]
    df = spark.createDataFrame([(i, v, 1, "old") for i, v in rows], "vec_id long, embedding array<double>, label int, Cluster string").repartition(5)
    got = centroids.cluster_vectors(df, size=4, k=5, rounds=6)
    assert [c for c in got.columns if c in COLUMNS] == COLUMNS and "Cluster" not in got.columns
    assert sorted(map(str, got.select("vec_id", *COLUMNS).collect())) == sorted(
        map(str, spark.createDataFrame(plain(rows, 4, 5, 6, 3), got.select("vec_id", *COLUMNS).schema).collect()))


def test_fewer_vectors_than_clusters_ties_and_no_rows(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster_vectors(df, size=2)
    assert sorted(tuple(r) for r in got.select("vec_id", *COLUMNS).collect()) == sorted(plain(rows, 2, 8, 10, 3))
    empty = centroids.cluster_vectors(df.limit(0), size=2)
    assert empty.collect() == [] and dict(empty.dtypes) == dict(got.dtypes)


def test_too_large_a_component(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="131072 or more"):
        centroids.cluster_vectors(df, size=2)
