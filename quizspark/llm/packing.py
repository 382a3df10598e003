"""Lexical retrieval packing: windows filled with the nearest unused documents of a BM25 index.

Documents are tokenized where they are read. What a document fills alone is cut off as whole windows; its rest goes to one of many
shards, dealt by a hash, with its terms. A shard has about ``SHARD_DOCS`` documents at any size of the corpus and is packed by
one task: it builds an inverted index of its documents, takes the longest unused rest as a seed, ranks the unused
documents by BM25 against all terms of the seed, and lays them after it. What doesn't fit is cut at a multiple of ``UNIT``
tokens and stays unused for a later window, so a window is padded by less than a unit, but for the last of a shard.

Token ids never leave the task that made them: the checksum of any piece follows from the checksums of its windows or units.
A batch's texts stay in Arrow and are tokenized ``SLICE_BYTES`` at a time, so a task holds its batch and what one slice takes.

Null text counts as empty: the end id alone. Repeated rows and rows without an id are packed each. Other columns are not
returned. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quizspark.llm.tokens import WordIds, ranges, slices

WINDOW = 2048
UNIT = 32
SHARD_DOCS = 2048
K1, B = 1.2, 0.75
_ZEROS = bytes(4 * WINDOW)
TOKENIZED = pa.schema({"doc_id": pa.int64(), "shard": pa.int64(), "n": pa.int64(), "full": pa.binary(), "units": pa.binary(),
                       "terms": pa.binary(), "counts": pa.binary()})
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def joined_crc(a: int, b: int, tokens: int) -> int:
    """Checksum of two byte strings one after the other, from theirs; the second holds ``tokens`` ids."""
    zeros = _ZEROS[:4 * tokens]
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


def _checksums(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Of each full window, and of each unit of the rest."""
    data, at = memoryview(ids.astype("<u4").tobytes()), len(ids) // WINDOW * WINDOW * 4
    full = [zlib.crc32(data[i:i + 4 * WINDOW]) for i in range(0, at, 4 * WINDOW)]
    units = [zlib.crc32(data[i:i + 4 * UNIT]) for i in range(at, len(data), 4 * UNIT)]
    return np.array(full, "<u4").tobytes(), np.array(units, "<u4").tobytes()


def _tokenizer(path: str, end_id: int, shards: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.load(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            keys = batch.column("key").to_numpy()
            for first, last, texts in slices(batch.column("text")):
                ids, starts, terms, at = words.ids(texts, terms=True)
                rows = []
                for i in range(last - first):
                    own = np.append(ids[starts[i]:starts[i + 1]], np.uint32(end_id))
                    found, counts = np.unique(terms[at[i]:at[i + 1]], return_counts=True)
                    rows.append((len(own), *_checksums(own), found.tobytes(), np.minimum(counts, 65535).astype("<u2").tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(first, last - first), pa.array(keys[first:last] % shards, pa.int64()), pa.array(cols[0], pa.int64()),
                     *[pa.array(c, pa.binary()) for c in cols[1:]]], schema=TOKENIZED)
        pa.default_memory_pool().release_unused()  # the worker lives on, beside the stages that follow
    return tokenize


class Index:
    """Inverted index of a shard's documents for BM25."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        every, count = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        docs = np.repeat(np.arange(len(terms)), sizes)
        lengths = np.bincount(docs, count, len(terms))
        order = np.argsort(every, kind="stable")
        starts = np.flatnonzero(np.diff(every[order], prepend=every[order][:1] + 1)) if len(every) else np.zeros(0, np.int64)
        df = np.diff(np.append(starts, len(every)))
        idf = np.maximum(0, np.log((len(terms) - df + 0.5) / (df + 0.5)))
        tf = count[order]
        norm = K1 * (1 - B + B * lengths / max(1e-9, lengths.mean()))
        self.docs = docs[order]
        self.gain = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.docs])
        term_of = np.empty(len(every), np.int64)
        term_of[order] = np.repeat(np.arange(len(df)), df)
        self.own = np.split(term_of, np.cumsum(sizes)[:-1])
        self.starts, self.df = starts, np.where(idf > 0, df, 0)
        self.n = len(terms)

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents for the terms of one. A term in at least half of the documents weighs nothing."""
        t = self.own[doc]
        at = ranges(self.starts[t], self.df[t])
        return np.bincount(self.docs[at], self.gain[at], self.n)


def pack(frame: pd.DataFrame) -> list[tuple]:
    """Pieces of one shard: (row, start, length, crc, sequence, offset)."""
    frame = frame.reset_index(drop=True)
    full = [np.frombuffer(x, "<u4").tolist() for x in frame["full"]]
    units = [np.frombuffer(x, "<u4").tolist() for x in frame["units"]]
    total = frame["n"].tolist()
    pieces, sequence = [], 0
    for i, crcs in enumerate(full):
        for j, crc in enumerate(crcs):
            pieces.append((i, j * WINDOW, WINDOW, crc, sequence, 0))
            sequence += 1
    done = [len(x) * WINDOW for x in full]
    rest = np.array([t - d for t, d in zip(total, done)])
    index = Index([np.frombuffer(x, "<u4") for x in frame["terms"]], [np.frombuffer(x, "<u2") for x in frame["counts"]])

    def lay(i: int, space: int, offset: int) -> int:
        """Lay what fits of a document's rest; returns the number of tokens."""
        length = int(rest[i]) if rest[i] <= space else space // UNIT * UNIT
        first = len(units[i]) - -(-int(rest[i]) // UNIT)
        crc, left = 0, length
        for u in units[i][first:first + -(-length // UNIT)]:
            crc = joined_crc(crc, u, min(UNIT, left))
            left -= UNIT
        pieces.append((i, done[i], length, crc, sequence, offset))
        done[i] += length
        rest[i] -= length
        return length

    while rest.any():
        seed = int(np.argmax(rest))
        at = lay(seed, WINDOW, 0)
        if WINDOW - at >= UNIT and rest.any():
            score = index.scores(seed) + 1.0
            while WINDOW - at >= UNIT:
                score[rest == 0] = 0
                best = int(np.argmax(score))
                if score[best] == 0:
                    break
                at += lay(best, WINDOW - at, at)
        sequence += 1
    return pieces


def _pack_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "n", "units"], kind="stable", na_position="first")
    ids, n = frame["doc_id"].tolist(), frame["n"].tolist()
    rows = [(None if pd.isna(ids[i]) else int(ids[i]), start, length, crc, n[i], (int(key[0]) << 32) + sequence, offset)
            for i, start, length, crc, sequence, offset in pack(frame)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """All pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    shards = max(1, round(docs.count() / SHARD_DOCS))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), 1)
    rows = docs.select(F.col("doc_id").cast("long"), key.alias("key"), "text")
    tokenized = rows.mapInArrow(_tokenizer(tokenizer, end_id, shards), "doc_id long, shard long, n long, full binary, "
                                "units binary, terms binary, counts binary")
    return tokenized.groupBy("shard").applyInPandas(_pack_shard, PIECES)
