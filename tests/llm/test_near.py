"""Near-duplicates by shingle similarity against plain Python, with planted copies."""

import random

import pytest

import corpus_pipeline
from quizspark.llm import near, simhash


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_kept(rows, least=0.8):
    """Smallest id of each component of pairs at or above ``least``."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[at + 1:]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= 0.79 * max(len(a), len(b)) and (a == b or len(a & b) / len(a | b) >= least):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in ids}


def changed(words, n):
    """A copy with ``n`` words replaced, far apart."""
    out = list(words)
    for k in range(n):
        out[3 + k * (len(words) // n)] = f"new{random.random()}"
    return " ".join(out)


def planted():
    """Copies at 0.80 to 0.96 and others below 0.8, a large group about one text, and short texts."""
    random.seed(8)
    rows, at = [], 10_000_000
    for group in range(60):
        words = [f"g{group}w{random.randrange(5000)}" for _ in range(304)]
        rows += [(at, " ".join(words)), (at + 1, changed(words, 1 + group % 9))]
        at += 2
    words = [f"hot{random.randrange(5000)}" for _ in range(304)]
    rows += [(at + i, changed(words, 1 + i % 8)) for i in range(150)]
    return rows + [(at + 200, None), (at + 201, " "), (at + 202, "two words"), (at + 203, "Two  words"), (at + 204, "two words more")]


def test_stage_against_plain(make, small):
    rows = [(r.doc_id, r.text) for r in small.dropDuplicates(["text"]).collect()] + planted()
    sims = [len(a & b) / len(a | b) for a, b in [(shingles(x[1]), shingles(y[1])) for x, y in zip(planted()[:120:2], planted()[1:120:2])]]
    assert sum(0.8 <= x < 0.85 for x in sims) >= 5 and sum(x >= 0.9 for x in sims) >= 5 and sum(x < 0.8 for x in sims) >= 5
    got = corpus_pipeline.drop_near(make([]).sparkSession, make(rows), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(plain_kept(rows))


def test_edges(make):
    rows = [(None, "a b"), (3, "a b"), (3, "a b"), (2, "A  b"), (7, "c")]
    got = near.drop_near_duplicates(make(rows))
    assert got.columns == make(rows).columns and sorted(r.doc_id for r in got.collect()) == [2, 7]
    assert near.drop_near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("limit,second", [(2, False), (2, True), (8, True), (1000, False)])
def test_a_key_that_unlinked_texts_share(make, monkeypatch, limit, second):
    """All texts share their keys, and the narrower ones too if ``second``; only some are near copies, and the rounds must find each of them."""
    monkeypatch.setattr(near, "LIMIT", limit)
    rows = planted()[:40] + planted()[120:140]
    docs = make(rows)
    keys = near.F.array(*[near.F.lit(k).cast("long") for k in range(3)])
    monkeypatch.setattr(near, "_sketch", lambda text, words, of=near._sketch: near.F.struct(
        of(text, words)["fp"].alias("fp"), of(text, words)["n"].alias("n"), keys.alias("keys")))
    if second:
        monkeypatch.setattr(near, "_prefixes", lambda sets, least: sets.select(
            near.F.explode(keys).alias("key"), "fp", near.F.size("h").alias("n"), near.F.lit(0).alias("at")))
    assert sorted(r.doc_id for r in near.drop_near_duplicates(docs).collect()) == sorted(plain_kept(rows))


def test_common_passage_makes_no_links_and_few_pairs(make, monkeypatch):
    """Texts with half in common meet in crowded keys; their number of comparisons stays far below all pairs."""
    random.seed(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"x{random.randrange(10**6)}" for _ in range(30)])) for i in range(600)]
    seen = []
    monkeypatch.setattr(near, "written", lambda df, label, of=near.written: seen.append((label, of(df, label))) or seen[-1][1])
    got = near.drop_near_duplicates(make(rows))
    assert got.count() == len(plain_kept(rows))
    assert sum(df.count() for label, df in seen if label == "near-pairs") < 600 * 599 / 2 / 3


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " more", "b", 2), (3, "short text", "c", 3), (3, "short text", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, __id int")
    got = near.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted((r["doc_id"], r["hash"], r["__id"]) for r in got.collect()) == [(1, "a", 1), (3, "c", 3)]


def test_simhash_links_come_first(make, monkeypatch):
    """Without any MinHash key, copies that differ in a word or two of 304 are still found, by their fingerprints."""
    rows = planted()[:120]
    monkeypatch.setattr(near, "_sketch", lambda text, words, of=near._sketch: near.F.struct(
        of(text, words)["fp"].alias("fp"), of(text, words)["n"].alias("n"), near.F.array(of(text, words)["fp"]).alias("keys")))
    bits = {i: simhash.fingerprint(t, 5) for i, t in rows}
    close = {i + 1 for i, _ in rows[::2] if (bits[i] ^ bits[i + 1]).bit_count() <= simhash.MAX_BITS}
    assert len(close) >= 5
    kept = {r.doc_id for r in near.drop_near_duplicates(make(rows)).collect()}
    assert {i for i, _ in rows} - kept == close - plain_kept(rows)


def test_a_fingerprint_link_needs_the_similarity(make, monkeypatch):
    """All texts have one fingerprint; only those that are near copies go."""
    monkeypatch.setattr(near, "fingerprint_column", lambda text, words: near.F.lit(5).cast("long"))
    rows = planted()[:40]
    assert sorted(r.doc_id for r in near.drop_near_duplicates(make(rows)).collect()) == sorted(plain_kept(rows))


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_sieve(spark, monkeypatch, bits):
    """Whatever its size it lets all ids through; with room enough few others."""
    monkeypatch.setattr(near, "SIEVE_BITS", bits)
    ids = spark.range(20_000).select(near.F.xxhash64("id").alias("h"))
    may = near._sieve(ids)
    others = spark.range(20_000, 60_000).select(near.F.xxhash64("id").alias("h"))
    assert ids.where(may(near.F.col("h"))).count() == 20_000
    assert bits < 1 << 20 or others.where(may(near.F.col("h"))).count() < 40_000 * 0.02
    assert near._sieve(ids.limit(0))(near.F.col("h")) is not None and others.where(near._sieve(ids.limit(0))(near.F.col("h"))).count() == 0


def test_texts_without_a_partner_meet_no_join(make, monkeypatch):
    """Of 400 unlike texts and two near copies only a few texts are joined with what is known of candidates and of rows that go."""
    random.seed(10)
    words = [f"w{random.randrange(5000)}" for _ in range(304)]
    rows = [(i, " ".join(f"x{random.randrange(10**6)}" for _ in range(40))) for i in range(400)] + [(500, " ".join(words)), (501, changed(words, 1))]
    met = []
    monkeypatch.setattr(near, "_found", lambda docs, known, how, of=near._found: met.append(docs.count()) or of(docs, known, how))
    assert near.drop_near_duplicates(make(rows)).count() == 401
    assert met and max(met) < 40
