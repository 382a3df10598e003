"""Token ids, records and packing, against encoding whole texts."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quizspark.llm import packing, records
from quizspark.llm.tokens import WordIds, chunks, slices

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_those_of_whole_texts(path, small):
    random.seed(5)
    signs = "abzAZé '́.,!?;:-_12²½  \n\t\r\x1c\x1f\x0b\x85'sItdl'm$#|&*~\U0001F600漢字Σς\xa0 \x02\x03"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 25))) for _ in range(20_000)]
    texts += ["a<|endoftext|>b c", "<|startoftext|>", " x", "\nx", "x\n", "x ", " ", "\n", "", "a" * 5000]
    texts += [r.text for r in small.limit(60).collect()]
    words, whole = WordIds(path), Tokenizer.from_file(path)
    words.LIMIT = 3000
    for first, last in chunks(texts, 20_000):
        ids, starts = words.ids(texts[first:last])
        for i, enc in enumerate(whole.encode_batch(texts[first:last], add_special_tokens=False)):
            assert ids[starts[i]:starts[i + 1]].tolist() == enc.ids, texts[first + i]


def test_chunks_cover_everything_once():
    texts = ["a" * n for n in (3, 0, 9, 100, 1, 1)] + [None]
    assert [i for a, b in chunks(texts, 10) for i in range(a, b)] == list(range(7)) and list(chunks([])) == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_slices_cover_everything_once_with_the_same_ids(path):
    texts = [None, "é b", "", "a b c d e f", None, "<|endoftext|>", " x  y", "\U0001F600", "z"]
    batch = pa.array(["left out", *texts], pa.string()).slice(1)
    for kind in (pa.string(), pa.large_string()):
        parts = list(slices(batch.cast(kind), 5))
        assert [i for a, b, _ in parts for i in range(a, b)] == list(range(len(texts)))
        assert [t for *_, part in parts for t in part] == [t or "" for t in texts]
        assert all(b - a == 1 or sum(len(t.encode()) for t in part) <= 5 for a, b, part in parts)
        words = WordIds(path)
        got = [words.ids(part, terms=True) for *_, part in parts]
        ids, starts, terms, at = words.ids([t or "" for t in texts], terms=True)
        for k, part in enumerate((ids, terms)):
            assert np.concatenate([g[2 * k] for g in got]).tolist() == part.tolist()
        for k, part in enumerate((starts, at)):
            assert np.concatenate([np.diff(g[2 * k + 1]) for g in got]).tolist() == np.diff(part).tolist()
    assert list(slices(pa.array([], pa.string()))) == []


def test_tokenizing_holds_a_slice_whatever_the_batch():
    def peak(n):
        texts = pa.array([f"{i} " + "some words of a text " * 150 for i in range(n)], pa.string())
        batch = pa.record_batch([pa.array(range(n), pa.int64())] * 2 + [texts], names=["doc_id", "key", "text"])
        tracemalloc.start()
        rows = sum(b.num_rows for b in packing._tokenizer(WORD, 1, 3)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return most
    peak(10)
    assert peak(4000) < 40e6 and peak(4000) < 1.3 * peak(1000)


def expected_ids(docs, path, end):
    rows = docs.select("doc_id", "text").collect()
    encs = Tokenizer.from_file(path).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    return [(r.doc_id, np.array(e.ids + [end], "<u4")) for r, e in zip(rows, encs)]


EDGES = [(9, None), (None, "null id"), (2, ""), (7, "long text " * 3000), (4, "same"), (4, "same"), (-3, "minus")]


@pytest.mark.parametrize("which", ["edges", "small", "empty"])
def test_records_round_trip(make, small, which, tmp_path):
    docs = {"edges": make(EDGES), "small": small, "empty": make([])}[which]
    got = sorted(map(tuple, records.round_trip(docs, BYTE, 0, str(tmp_path / "r")).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for doc_id, ids in sorted(expected_ids(docs, BYTE, 0), key=lambda x: (x[0] is not None, x[0] or 0)):
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in expected] and [r[1] for r in got] == [r[1] for r in expected]


def test_damage_is_found():
    frame = records.framed(b"abc")
    assert records.unframed(frame, 0) == (b"abc", len(frame))
    for i in range(len(frame)):
        with pytest.raises(ValueError):
            records.unframed(frame[:i] + bytes([frame[i] ^ 1]) + frame[i + 1:], 0)


@pytest.mark.parametrize("which", ["edges", "small", "empty"])
def test_packing_places_every_id_once(make, small, which):
    docs = {"edges": make(EDGES), "small": small, "empty": make([])}[which]
    got = packing.pack_documents(docs, WORD, 1).collect()
    want = {}
    for doc_id, ids in expected_ids(docs, WORD, 1):
        want.setdefault(doc_id, []).append(ids)
    for doc_id, copies in want.items():
        pieces = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        for ids in {c.tobytes(): c for c in copies}.values():
            for r in pieces:
                if r.doc_tokens == len(ids):
                    assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and r.length > 0
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n <= packing.WINDOW for n in by.values())
    if which == "small":
        assert sum(by.values()) / (len(by) * packing.WINDOW) > 0.98


def test_bm25_against_plain(small):
    rows = [sorted(set(r.text.lower().split())) and r.text.lower().split() for r in small.limit(80).collect()]
    vocab = {w: i for i, w in enumerate(sorted({w for r in rows for w in r}))}
    coded = [np.unique([vocab[w] for w in r], return_counts=True) for r in rows]
    index = packing.Index([t.astype("<u4") for t, _ in coded], [c.astype("<u2") for _, c in coded])
    df = {w: sum(w in set(r) for r in rows) for w in vocab}
    mean = np.mean([len(r) for r in rows])
    for q in (0, 7, 33):
        got = index.scores(q)
        for d in range(len(rows)):
            s = 0.0
            for w in set(rows[q]):
                tf = rows[d].count(w)
                s += max(0, np.log((80 - df[w] + 0.5) / (df[w] + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rows[d]) / mean))
            assert abs(got[d] - s) < 1e-3 * max(1, s)


def test_joined_checksum():
    a, b = np.arange(70, dtype="<u4").tobytes(), np.arange(9, dtype="<u4").tobytes()
    assert packing.joined_crc(zlib.crc32(a), zlib.crc32(b), 9) == zlib.crc32(a + b)
