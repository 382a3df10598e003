"""Mixing weights and the uniform shuffle."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quizspark.llm import mixing, sharding


def filled(sizes, weights, cap=3):
    """Water filling in plain Python: share, cut, share again."""
    total, free, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        room = total - sum(target[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        over = {i for i in free if room * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                target[i] = room * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
        free -= over
    return target


def test_targets(spark):
    for sizes in ([100, 5, 50, 7, 0, 900, 3], [1], [0, 0], [10, 10, 10], [1, 1, 10_000]):
        rows = [(f"s{i}", n) for i, n in enumerate(sizes[:-1])] + [(None, sizes[-1])]
        got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"), 3).collect()
        by = {r.source: r.target for r in got}
        expected = filled(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert np.allclose([by[s] for s, _ in rows], expected) and abs(sum(by.values()) - sum(sizes)) < 1e-6


def test_copies_follow_targets_and_repeat(make):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}" if i % 11 else None) for i in range(3000)] + [(None, "a b", "s0"), (None, None, "s1"), (5, "x", "s0"), (5, "x", "s0")]
    docs = make(rows).withColumn("target", F.lit("old"))
    a = sorted(mixing.plan_mix(docs).select("doc_id", "text", "copies", "size", "target", "source").collect(), key=str)
    b = sorted(mixing.plan_mix(docs.repartition(7)).select("doc_id", "text", "copies", "size", "target", "source").collect(), key=str)
    assert a == b and max(r.copies for r in a) <= 3
    taken, target = Counter(), {}
    for r in a:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in a)
    assert mixing.mix(make([])).count() == 0


def test_matrix_has_the_sums_and_the_law():
    for rows, columns in (([5, 0, 7], [4, 8]), ([], []), ([3], [1, 1, 1]), ([0, 0], [0, 0, 0])):
        m = sharding.communication_matrix(rows, columns, 3)
        assert m.sum(1).tolist() == rows and (not rows or m.sum(0).tolist() == columns)
    first = [sharding.communication_matrix([10, 20, 30], [20, 40], s)[0, 0] for s in range(4000)]
    assert abs(np.mean(first) - 10 / 3) < 0.1 and abs(np.var(first) - 10 * (1 / 3) * (2 / 3) * 50 / 59) < 0.15
    rng = np.random.default_rng(2)
    large = [sharding.hypergeometric(rng, 4 * 10 ** 9, 6 * 10 ** 9, 500) for _ in range(3000)]
    assert abs(np.mean(large) - 200) < 1 and abs(np.var(large) / 120 - 1) < 0.12


def test_shuffle(make):
    rows = [(i, f"t{i}") for i in range(997)] + [(None, None), (3, "t3"), (3, "t3")]
    docs = make(rows).repartition(5).withColumn("slot", F.lit("old"))
    got = sharding.shuffle_to_shards(docs, 7, cell_rows=30).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.12
    assert sharding.shuffle_to_shards(make([]), 7).count() == 0
