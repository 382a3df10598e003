"""Runs of words against a plain search over all periods and stretches."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizspark.llm import periodic
from quizspark.llm.queries import QUERIES


def plain_runs(words, times=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, times * q))


def plain_rest(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def text_of(rng):
    kind = rng.random()
    words = [rng.choice("a b c".split()[:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
    if kind < 0.5:
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        stretch = (unit * 9)[:rng.randint(1, 9 * len(unit))]
        at = rng.randint(0, len(words))
        words = words[:at] + stretch + words[at:]
    if kind < 0.2:
        words = words * rng.randint(1, 6)
    return words


def test_runs_equal_plain_search():
    rng = random.Random(5)
    texts = [text_of(rng) for _ in range(1500)]
    for times, least in ((4, 6), (2, 2), (3, 4)):
        sizes, runs, rest = periodic._treated([" ".join(t) for t in texts], times, least)
        at = 0
        for words, n, left in zip(texts, sizes, rest):
            want = plain_runs(words, times, least)
            assert runs[at:at + n] == want, words
            assert left.split() == plain_rest(words, want)
            at += n


def test_long_texts():
    rng = random.Random(6)
    unit = [f"w{i}" for i in range(3000)]
    words = ["x"] + unit * 5 + ["y"] * 30_000 + [f"w{rng.randint(0, 9)}" for _ in range(50_000)]
    sizes, runs, _ = periodic._treated([" ".join(words)], 4, 6)
    assert (1, 15_000, 3000) in runs and (15_001, 30_000, 1) in runs
    assert sizes == [len(runs)]


def test_operator_edges(spark):
    rows = [(1, None, "k", 7), (2, "", "k", 7), (3, " \t\n", None, 7), (4, "a a a a a a", "k", 7), (4, "a a a a a a", "k", 7), (None, "x\ty x y x y x y z", "k", 7)]
    out = periodic.mark_runs(spark.createDataFrame(rows, "doc_id long, text string, RUNS string, other int")).collect()
    assert sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"], r["other"]) for r in out) == [
        (0, [(0, 8, 2)], "x y z", 7), (1, [], "", 7), (2, [], "", 7), (3, [], "", 7), (4, [(0, 6, 1)], "a", 7), (4, [(0, 6, 1)], "a", 7)]
    none = periodic.mark_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert none.collect() == [] and none.columns == ["doc_id", "text", "runs", "collapsed"]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(plain_rest(words, runs))).hexdigest())


def test_query_equals_plain_rows(spark, tmp_path):
    rng = random.Random(7)
    texts = [" ".join(text_of(rng)) for _ in range(400)] + [None, "", "ä ö ä ö ä ö ä ö", "q " * 300]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, texts[3], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names and {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(i, t) for i, t, _ in rows), key=str)
