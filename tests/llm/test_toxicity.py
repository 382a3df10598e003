"""Convolutional classifier: gradients, filters and pooling against plain versions, held-out accuracy, edges."""

from __future__ import annotations

import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from quizspark.llm import toxicity as tox
from quizspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_pooled(net, text, words):
    """One text, one filter and one word at a time."""
    found = [p for w in text.split() for p in [words.parts[words.rows([w])[0]]]]
    pad = np.full(1 + len(tox.STEMS), tox.BUCKETS)
    vectors = [net.vectors[p].sum(0) for p in [*found, *[pad] * tox._GAP]]
    tops = []
    for k, width in enumerate(tox.WIDTHS):
        for f in range(tox.FILTERS):
            tops.append(max(sum(float(vectors[i - j] @ net.filters[k][j][:, f]) for j in range(width) if i >= j) for i in range(len(vectors))))
    return np.array(tops)


def test_filters_and_pooling():
    words, net = tox.Words(), tox.Network.start(3)
    texts = ["a b c d e", "", "b B. b!! 12 || x", "e"]
    parts, laid, starts = tox.laid(texts, words)
    got = net.pooled(net.embedded(parts), laid, starts)
    for row, text in zip(got, texts):
        assert np.allclose(row, plain_pooled(net, text, words), atol=1e-5)


def test_gradient_of_a_step():
    """The first step of each parameter goes against the slope measured by small changes."""
    texts, y = ["a b c", "c d", "", "d a a b"], np.array([1.0, 0, 0, 1])
    words, net = tox.Words(None), tox.Network.start(4)
    net.vectors[:-1] *= 10
    net.bias += np.float32(0.1)  # off the bend of the maximum with zero
    parts, joined, starts = tox.laid(texts, words)
    cut = np.split(joined, starts[1:])
    before = net.copy()
    steps = tox.Steps(net)
    steps.step(cut, parts, y)

    def loss(n):
        return tox._loss(n.of_words(cut, parts).astype(float), y)

    for name in ("vectors", "bias", "out", "filters"):
        old = before.filters if name == "filters" else [getattr(before, name)]
        new = net.filters if name == "filters" else [getattr(net, name)]
        had = steps.had.filters if name == "filters" else [getattr(steps.had, name)]
        for a, b, h in zip(old, new, had):
            moved = np.argwhere(np.abs(b - a) > 1e-4)[:20]
            assert len(moved)
            for at in map(tuple, moved):
                grad = -(b[at] - a[at]) * np.sqrt(h[at]) / tox.RATE
                kept = a[at]
                a[at] = kept + 1e-3
                up = loss(before)
                a[at] = kept - 1e-3
                down = loss(before)
                a[at] = kept
                assert abs((up - down) / 2e-3 - grad) < 0.02 * abs(grad) + 2e-3


def test_thresholds_and_scaling():
    rng = np.random.default_rng(0)
    s, y = rng.random(200).round(2), rng.integers(0, 2, 200).astype(float)
    t = tox.best_threshold(s, y)
    def f1(c):
        return 2 * y[s >= c].sum() / ((s >= c).sum() + y.sum())
    assert f1(t) == max(f1(c) for c in np.unique(s))
    assert tox.best_threshold(s, np.zeros(200)) == 0.5
    x = rng.normal(0, 3, 5000)
    labels = (rng.random(5000) < 1 / (1 + np.exp(-(0.5 * x - 1)))).astype(float)
    a, b = tox.scaled(x, labels)
    assert abs(a - 0.5) < 0.1 and abs(b + 1) < 0.2


def made(n, seed):
    rng = random.Random(seed)
    bad = ["vilest", "rotten", "filthy"]
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" if rng.random() < 0.9 else rng.choice("ijk") * 3 for _ in range(rng.randint(1, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), toxic))
    return rows


def test_learns_and_keeps_its_folds(spark):
    rows = made(1500, 1)
    long = " ".join(["calm"] * 200_000 + ["rotten"])
    docs = [(i, t, lang, "x") for i, t, lang, _ in rows] + [(5000, long, "en", "x"), (5001, long[:-6] + "calm", "en", "x"), (5002, None, "en", "x"), (5003, "", None, "x"),
                                                            (None, rows[0][1], "en", "x"), (7, rows[7][1], rows[7][2], "x")]
    labels = [(i, 1, y) for i, _, _, y in rows] + [(7, 1, rows[7][3]), (8, 1, None), (None, 1, 1), (9999, 0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, Score string").repartition(4)
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = tox.score_documents(df, lb)
    assert out.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted", "threshold", "flagged"]
    got = out.collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["flagged"] == (r["score"] >= r["threshold"]) and 0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert by[5000]["predicted"] == 1 and by[5001]["predicted"] == 0 and by[5002]["score"] == by[5003]["score"]
    flipped = spark.createDataFrame([(i, 1, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in
                                     [(i, 1, y) for i, _, y in labels if i is not None and y is not None]], lb.schema)
    again = {r["doc_id"]: r["score"] for r in tox.score_documents(df, flipped, carry=["doc_id"]).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_one_class_no_labels_no_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["score"], r["predicted"]) for r in tox.score_documents(df, none).collect()} == {(0.5, 1)}
    same = spark.createDataFrame([(i, 0, 0) for i in range(20)], none.schema)
    assert {(r["score"], r["flagged"]) for r in tox.score_documents(df, same).collect()} == {(0.0, False)}
    assert tox.score_documents(df.limit(0), same).collect() == []


def test_query_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_toxicity_cnn"](spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect() if r["doc_id"] in got]
    held = [r for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
    assert sum(got[r["doc_id"]]["predicted"] == r["toxic"] for r in held) / len(held) > 0.85


def test_rows_past_any_sample_are_learnt(spark):
    """Only the last rows in the order of a hash of the id are toxic; all labelled rows must count."""
    ids = [r[0] for r in spark.range(13_000).where(tox.fold(tox.F.col("id")) != 0).orderBy(tox.F.xxhash64("id"), "id").collect()]
    assert len(ids) > 8192 + 1500
    last = set(ids[8192:])
    docs = [(i, f"calm w{i % 50} " + ("rotten" if i in last else "kind")) for i in ids] + [(i, "calm " + ("rotten" if i % 2 else "kind")) for i in range(20_000, 20_100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i in last)) for i in ids], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in tox.score_documents(df, labels, carry=["doc_id"]).collect()}
    assert all(got[i] == i % 2 for i in range(20_000, 20_100))


def test_groups_learn_together(spark, monkeypatch):
    """Many groups and blocks reach what one reaches; no row is left out, equal rows count once."""
    monkeypatch.setattr(tox, "GROUP_ROWS", 150)
    monkeypatch.setattr(tox, "BLOCK_WORDS", 2000)
    rows = made(2500, 2)
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(7, rows[7][1], rows[7][2])], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    learnt = tox.learnable(df, labels, "lang")
    assert learnt.select("grp").distinct().count() > 8
    assert sorted(r["id"] for r in learnt.select("id").collect()) == [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    got = tox.score_documents(df, labels, carry=["doc_id"]).where("held_out").collect()
    assert sum(r["predicted"] == rows[r["doc_id"]][3] for r in got) / len(got) > 0.97


def plain_parts(word):
    letters = re.sub(r"[\W\d_]+", "", word.lower())
    return [xxhash.xxh64_intdigest(p, k) % tox.BUCKETS for k, p in enumerate((letters, *(letters[:n] for n in tox.STEMS)))] if letters else [tox.BUCKETS] * (1 + len(tox.STEMS))


def test_buckets_of_odd_words_without_a_call_a_word():
    """As the plain version gives them, also for letters whose lower case hangs on their neighbours; the work of Python calls doesn't grow with the words."""
    random.seed(11)
    odd = ["", "-", "ΟΔΟΣ", "ΣΑΣ", "Σ", "İstanbul", "a\u0301b", "ẞ1_x", "123", "don't", "\x1c", "a\x85b", "\u2028x", "東京2020", "x\u00a0y", "Foo,", "foo"]
    many = [f"{random.choice(odd)}{random.randrange(10**9)}{random.choice('abcxyz')}w{i}" for i in range(50_000)]
    calls = [0]
    words = tox.Words()
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        rows = words.rows(odd + many)
    finally:
        sys.setprofile(None)
    assert calls[0] < 5_000
    assert words.parts[rows].tolist() == [plain_parts(w) for w in odd + many]
    again = words.rows(["foo", "FOO!"])
    assert words.parts[again].tolist() == [plain_parts("foo")] * 2


def test_distinct_words_of_a_block_and_of_a_batch():
    rng = np.random.default_rng(12)
    rows = [rng.integers(0, 40, (n, 1 + len(tox.STEMS))) + tox.BUCKETS - 39 for n in (0, 1, 500, 0, 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([r.astype("<u2").tobytes() for r in rows], pa.binary())], names=["words"])
    (at, parts, texts), = tox._blocks(batch)
    assert at.tolist() == [0, 1, 2, 3, 4] and all((parts[t] == r).all() for t, r in zip(texts, rows))
    assert [tuple(x) for x in parts.tolist()] == sorted({tuple(x) for r in rows for x in r.tolist()}, key=lambda x: x[::-1])
    for t in texts:
        seen, words = tox._seen(t, len(parts))
        assert seen.tolist() == sorted(set(t.tolist())) and (seen[words] == t).all()
