"""Scores of batches against their definitions, and long pairs, whose runs are all tried."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizspark.functions import edits, match as mt, similarity as si


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _ratio(a, b):
    n = max(len(a), len(b))
    return (200 * (n - _distance(a, b)) + n) // (2 * n) if n else 100


def _scores(a, b):
    wa, wb = ([w for w in x.split(" ") if w] for x in (a, b))
    few, many = (wa, wb) if len(wa) <= len(wb) else (wb, wa)
    shared = " ".join(sorted(set(wa) & set(wb)))
    left, right = (" ".join([shared, *sorted(set(x) - set(y))]).strip() for x, y in ((wa, wb), (wb, wa)))
    return [_ratio(a, b), max(_ratio(" ".join(many[k:k + len(few)]), " ".join(few)) for k in range(len(many) - len(few) + 1)) if few else 0,
            _ratio(" ".join(sorted(wa)), " ".join(sorted(wb))), max(_ratio(shared, left), _ratio(shared, right), _ratio(left, right)) if wa and wb else 0]


@pytest.mark.parametrize("longest,letters", [(8, "ab"), (70, "abc"), (200, "abé日")])
def test_distances(longest, letters):
    rng = random.Random(longest)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(60)]
    texts += [x[:len(x) // 3] + "b" + x[len(x) // 2:] for x in texts]
    size = np.array([len(x) for x in texts])
    at = np.cumsum(size) - size
    found = edits.distances(edits.codes(texts), at[:60], size[:60], at[60:], size[60:])
    assert found.tolist() == [_distance(a, b) for a, b in zip(texts[:60], texts[60:])]


def test_nearest_stretch_of_each_end():
    rng = random.Random(5)
    for pattern, text in (("".join(rng.choice("ab") for _ in range(m)), "".join(rng.choice("ab") for _ in range(n))) for m, n in ((3, 9), (70, 40), (1, 0))):
        both = edits.codes([pattern, text])
        want = [min(_distance(pattern, text[k:end]) for k in range(end + 1)) for end in range(len(text) + 1)]
        assert edits.nearest(both[:len(pattern)], both[len(pattern):]).tolist() == want


@pytest.mark.parametrize("work", [1 << 22, 1])
def test_scores_of_batches(monkeypatch, work):
    monkeypatch.setattr(si, "WORK", work)
    monkeypatch.setattr(si, "CHARS", 500)
    rng = random.Random(6)

    def text(words, letters):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, words)))
    for letters, words in (("ab", 4), ("abé", 9), ("abcd日", 20)):
        a, b = ([text(words, letters) for _ in range(60)] for _ in "ab")
        want = [_scores(x, y) for x, y in zip(a, b)]
        assert np.stack(si.all_scores(a, b)).T.tolist() == want
        assert si.best_scores(a, b).tolist() == [max(w) for w in want]
    assert si.best_scores([], []).tolist() == []


def test_nearest_run_of_long_texts_shares_no_word(spark):
    """The best run differs in a letter of every word, so no word of it is in place; others have words in place."""
    rng = random.Random(8)

    def words(n):
        return ["".join(rng.choice("etaoinshr") for _ in range(7)) for _ in range(n)]
    few = words(300)
    run = [w[:3] + "x" + w[4:] for w in few]
    many = few[:2] + words(10) + run + words(10) + few[-2:]
    a, b = " ".join(many), " ".join(few)
    got = spark.createDataFrame([(a, b)], "a string, b string").select(si.fuzzy_scores(F.col("a"), F.col("b")).alias("s")).first()["s"]
    n = len(b)
    assert got["partial_ratio"] == (200 * (n - 300) + n) // (2 * n) == 87 and got["token_set_ratio"] < 80


def test_long_answers_match_by_a_run(spark):
    rng = random.Random(9)
    few = ["".join(rng.choice("etaoinshr") for _ in range(7)) for _ in range(300)]
    run = [w[:3] + "x" + w[4:] for w in few]
    other = [["".join(rng.choice("etaoinshr") for _ in range(7)) for _ in range(150)] for _ in "ab"]
    row = (" ".join(few[:2] + other[0] + run + other[1]), " ".join(few), ["no"])
    df = spark.createDataFrame([row], "a string, e string, also array<string>")
    for got in (mt.match_answers(df, "a", "e"), mt.match_any(df, "a", "e", "also")):
        match = got.first()["match"]
        assert (match["is_match"], match["match_type"], match["confidence"]) == (True, "fuzzy", 0.87)


def test_rows_of_a_batch_are_settled_apart(spark):
    rows = [("gold", "gold", ["x"]), ("", "", []), (None, None, None), ("what is 12", "who was 12", ["five"]), ("usa", "x", [None, "united states", "usa"]),
            ("x² usa", "y", ["x² united states"]), ("it is a", "b", None), ("12²", "12", []), ("don't panic now", "panic", ["now don't panic"])]
    df = spark.createDataFrame(rows, "a string, e string, also array<string>").coalesce(1)
    got = [(r["match"]["is_match"], r["match"]["match_type"], round(r["match"]["confidence"], 6), r["matched_against"]) for r in mt.match_any(df, "a", "e", "also").collect()]
    assert got[0] == (True, "exact", 1.0, "gold") and got[1] == (False, "exact", 0.0, "") and got[2] == (False, "exact", 0.0, None)
    assert got[3] == (True, "jeopardy_format", 1.0, "who was 12") and got[4] == (True, "exact", 1.0, "usa")
    assert got[5] == (True, "abbreviation", 1.0, "x² united states")
    assert got[7] == (False, "fuzzy", 0.67, "12") and got[8][:2] == (True, "fuzzy")
