"""Packing documents into training sequences along a space-filling curve.

Each document becomes the mean of fixed pseudo-random vectors of its token ids, in three dimensions; the place on a
Hilbert curve of 2^10 cells a side is its key. Documents are range-partitioned and sorted by that key, so
neighbours on the curve, which share vocabulary, share sequences. Within a partition the tokens form one stream that is cut
every 1024 ids: only the last sequence of each partition can be padded.

Defined cases: a null or empty text is its end id alone; ties on the curve are ordered by doc_id, then by the ids; repeated
rows are packed as often as they occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import batch_bytes, materialize, shuffle_width, text_or_empty
from gridloom.llm.tokens import encoder, parts_of

BITS, DIMS = 10, 3
SEED = 20_240_501


def token_vectors(size: int) -> np.ndarray:
    """A fixed standard normal vector per token id."""
    return np.random.default_rng(SEED).standard_normal((size, DIMS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n x d), by transposing Gray-coded bit planes (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(rows: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of id arrays (each of at least one id)."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    sums = np.add.reduceat(vectors[np.concatenate(rows)].astype(np.float64), offsets, axis=0)
    # A mean of n vectors has spread n^-1/2 or more; squash with a fixed scale to the unit cube.
    unit = 1 / (1 + np.exp(-6 * sums / lengths[:, None]))
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, curve key and ids (with the end id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        vectors, end = token_vectors(tokens.size), np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            for part, texts in parts_of(batch, "text"):
                ids = [x + end for x in tokens.encode(texts)]
                keys = curve_keys([np.frombuffer(x, tokens.dtype) for x in ids], vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys), pa.array(ids, pa.binary())], ["doc_id", "curve", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, curve long, ids binary")


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), ids_crc32, doc_tokens, sequence_id, offset.

    ids holds the piece's ids as little-endian unsigned 32-bit integers. The hot source spreads over partitions like any
    other, and equal documents are told apart by doc_id when the ranges are drawn.
    """
    with batch_bytes(docs.sparkSession):
        rows = materialize(encoded(docs, path, end_id), "pack")
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, at = TaskContext.get().partitionId() << 40, 0
        dtype = encoder(path).dtype
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            n = np.array([len(b) // dtype.itemsize for b in blobs], np.int64)
            if not len(n):
                continue
            begin = at + np.cumsum(n) - n
            at += int(n.sum())
            pieces = (begin + n - 1) // length - begin // length + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[owner] // length + nth
            lo = np.maximum(sequence * length, begin[owner])
            hi = np.minimum((sequence + 1) * length, begin[owner] + n[owner])
            start, size = lo - begin[owner], hi - lo
            data = [np.frombuffer(blobs[o], dtype)[s : s + k].astype("<u4").tobytes() for o, s, k in zip(owner.tolist(), start.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(data, pa.binary()),
                    pa.array(np.array([zlib.crc32(x) for x in data], np.int64)), pa.array(n[owner]), pa.array(base + sequence), pa.array(lo - sequence * length),
                ],
                ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pieces_digest(pieces: DataFrame) -> DataFrame:
    """Pieces without their ids."""
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset"))
