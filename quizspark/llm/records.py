"""Token ids as length-delimited binary records.

A record frames one sequence: its length (unsigned 64-bit), a masked checksum of those eight bytes, the sequence, a masked
checksum of the sequence; all little-endian. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that checksums of data
that hold checksums stay apart. A sequence is a flag byte (1: the id is null), the document id (signed 64-bit) and its token ids,
two bytes each where the vocabulary fits, else four. Beside each data file lies an index file with the offset of each
record and the end (unsigned 64-bit), so a reader can seek to any record of a shuffled order.

Files hold ascending ranges of document ids and are written once by the task that tokenized the range, first under a name of
its own, then renamed: a repeated task replaces a file by the same bytes. The manifest has one row per file. Only
file names, counts and offsets reach the driver, never ids.

Null text counts as empty and gives a record with the end id only. A null id sorts first. Repeated rows give a record each. An empty table gives
no file. Other columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from quizspark.llm.tokens import WordIds, chunks
from quizspark.plans.storage import new_path

_MASK_ADD = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<Bq")
MANIFEST = "shard int, file string, n_records long, n_tokens long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_ADD) & 0xFFFFFFFF


def framed(sequence: bytes) -> bytes:
    head = struct.pack("<Q", len(sequence))
    return b"".join((head, struct.pack("<I", masked(head)), sequence, struct.pack("<I", masked(sequence))))


def unframed(buffer: bytes, at: int) -> tuple[bytes, int]:
    """The sequence of the record at an offset, and the offset of the next; raises if a checksum is wrong."""
    size, check = _HEAD.unpack_from(buffer, at)
    if masked(buffer[at:at + 8]) != check:
        raise ValueError(f"bad length at {at}")
    start = at + _HEAD.size
    sequence = buffer[start:start + size]
    if len(sequence) != size or masked(sequence) != struct.unpack_from("<I", buffer, start + size)[0]:
        raise ValueError(f"bad sequence at {at}")
    return sequence, start + size + 4


def sequence_of(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _ID.pack(doc_id is None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def parsed(sequence: bytes, width: int) -> tuple[int | None, np.ndarray]:
    null, doc_id = _ID.unpack_from(sequence)
    return None if null else doc_id, np.frombuffer(sequence, f"<u{width}", offset=_ID.size)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words = WordIds.load(tokenizer)
        width = 2 if max(words.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        name, own = f"{shard:08d}", f"{shard:08d}.{uuid.uuid4().hex}"
        offsets, at, n_tokens, out = [0], 0, 0, None
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_numpy(zero_copy_only=False).tolist()
            for first, last in chunks(texts):
                ids, starts = words.ids([t or "" for t in texts[first:last]])
                for i in range(last - first):
                    own_ids = np.append(ids[starts[i]:starts[i + 1]], np.uint32(end_id))
                    record = framed(sequence_of(doc_ids[first + i], own_ids, width))
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{own}.rec", buffer_size=1 << 20)
                    out.write(record)
                    at += len(record)
                    offsets.append(at)
                    n_tokens += len(own_ids)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/{own}.idx") as index:
            index.write(np.array(offsets, "<u8").tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{root}/{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "file": name, "n_records": len(offsets) - 1, "n_tokens": n_tokens, "width": width}],
            pa.schema({"shard": pa.int32(), "file": pa.string(), "n_records": pa.int64(), "n_tokens": pa.int64(),
                       "width": pa.int32()}))
    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list:
    """Write all documents in ascending order of their ids; returns the manifest, one row per file in that order."""
    ordered = (docs.select(F.col("doc_id").cast("long"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return sorted(ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).collect(), key=lambda r: r["shard"])


def _reader(folder: str, piece_mb: int = 4):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                with store.open_input_file(f"{root}/{row.file}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                start, first = row.start, 0
                with store.open_input_file(f"{root}/{row.file}.rec") as f:
                    while first < len(offsets) - 1:
                        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (piece_mb << 20))) - 1)
                        f.seek(int(offsets[first]))
                        buffer, at = f.read(int(offsets[last] - offsets[first])), 0
                        rows = []
                        for _ in range(first, last):
                            sequence, at = unframed(buffer, at)
                            doc_id, ids = parsed(sequence, row.width)
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})
                        first = last
    return read


def read_records(spark, folder: str, manifest: list) -> DataFrame:
    """Per record ``doc_id``, ``start`` (ids before it in all files), ``n_tokens`` and ``ids_crc32``, from the files."""
    rows, start = [], 0
    for r in manifest:
        rows.append((r["file"], r["width"], start))
        start += r["n_tokens"]
    files = spark.createDataFrame(rows, "file string, width int, start long")
    return (files.repartition(max(1, len(rows)), "file")
            .mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents to ``folder``, by default a new one in the shared folder, and describe what the files hold."""
    folder = folder or new_path(docs.sparkSession, "records")
    if ":" not in folder:
        folder = f"file://{folder}"
    return read_records(docs.sparkSession, folder, write_records(docs, folder, tokenizer, end_id))
