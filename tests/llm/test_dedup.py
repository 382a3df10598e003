"""Exact and near-duplicates against plain Python."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quizspark.llm import components, exact_dedup, simhash


def norm(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def test_exact_groups(make):
    rows = [(5, "a  b"), (3, "a\tb"), (4, "A b"), (None, "a b"), (9, None), (8, ""), (7, " "), (3, "a b"), (1, "é" * 300), (2, "é" * 300), (6, "é" * 299 + "e")]
    got = exact_dedup.mark_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    for key in {norm(t) for _, t in rows}:
        ids = [i for i, t in rows if norm(t) == key]
        group = [r for r in got if norm(r.text) == key]
        least = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in group} == {least} and {r.group_size for r in group} == {len(ids)}
        assert sum(r.kept for r in group) == 1


def test_exact_columns_that_clash_and_empty(make):
    docs = make([(1, "x"), (2, "x")]).withColumn("kept", F.lit("old")).withColumn("_row", F.lit(3))
    got = exact_dedup.mark_duplicates(docs).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False]
    assert exact_dedup.drop_duplicates(make([])).count() == 0
    assert exact_dedup.drop_duplicates(make([(1, "x"), (2, "x")])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_digest(values):
    assert values(["a \n b"], exact_dedup.digest) == [hashlib.sha256(b"a b").hexdigest()]


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("bucket", [2000, 2])
def test_near_duplicates_of_documents(small, bucket):
    rows = small.select("doc_id", "text").orderBy("doc_id").collect()
    fps = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
    expected = plain_components([r.doc_id for r in rows], fps)
    got = simhash.link_documents(small, carry=["doc_id"], bucket=bucket).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.fingerprint % (1 << 64) for r in got} == {r.doc_id: int(f) for r, f in zip(rows, fps)}
    assert sum(r.kept for r in got) == len(set(expected.values()))


@pytest.mark.parametrize("bucket", [2000, 3])
def test_links_of_close_fingerprints(spark, bucket):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for f in fps[:12]:  # chains and clusters at one to five bits
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted({simhash._signed(f) for f in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 4 for r in links.collect())
    roots = {r.node: r.root for r in components.component_roots(links).collect()}
    assert {f: roots.get(f, f) for f in fps} == plain_components(fps, np.array(fps).view(np.uint64))


def test_simhash_edges(make):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(4, None), (3, ""), (2, " \n"), (None, "one"), (7, "one"), (7, "one"), (1, long), (0, long + " x")]
    got = simhash.link_documents(make(rows).withColumn("fingerprint", F.lit("old"))).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 3
    assert {r.component_id for r in got if not (r.text or "").strip()} == {2}
    assert {r.component_id for r in got if r.text == "one"} == {7}
    assert {r.component_id for r in got if (r.text or "").startswith("w0")} == {0}
    assert simhash.drop_near_duplicates(make([])).count() == 0


def test_long_chain_is_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (0, 1)]
    got = {r.node: r.root for r in components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
