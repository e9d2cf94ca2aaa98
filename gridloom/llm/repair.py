"""Token-id files compressed by a pair grammar (Re-Pair), with random-access decoding.

File format: a Parquet folder with one row per shard, in ascending doc_id order: part, shard, before (ids of the part's earlier shards), n_ids, doc_ids and the shard's blob.
A blob is self-contained; all numbers are little-endian::

    8 bytes   magic "GLRP0001"
    u32 x 4   terminals (rule symbols start there), rules, symbols, documents
    u32 x r   left symbol of each rule      u32 x r   right symbol      u32 x r   expansion length
    u32 x s   the compressed symbols (u16 where all symbols fit, flagged by bit 31 of `rules`; then left and right are u16 too)
    u32 x d   ids of each document (with its end id)

A rule's symbols are terminals or earlier rules. Summed expansion lengths give the place of any id, so a document is
decoded from the symbols that cover it alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import batch_bytes, shuffle_width, text_or_empty
from gridloom.llm.tokens import encoder, parts_of

MAGIC = b"GLRP0001"
#: A pair that occurs less often is left: its rule would take more room than it saves.
LEAST_COUNT = 8
#: By what the count that a round asks for falls from one to the next.
FALL = 4
BINS = 1 << 18
SHARD_IDS = 1_000_000


def bins_of(seq: np.ndarray) -> np.ndarray:
    """A bin for each pair of neighbours."""
    return (seq[:-1] * 40503 + seq[1:]) & (BINS - 1)


def frequent_pairs(seq: np.ndarray, bins: np.ndarray, filled: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right symbols of the pairs that occur `floor` times, most frequent first, smaller pairs first on ties, one pair a bin.

    filled counts the pairs in each bin. A pair's count is at most its bin's, so only pairs of bins that reach the floor
    are sorted. A pair that shares a bin with a more frequent one waits for a later round.
    """
    some = np.flatnonzero((filled >= floor)[bins])
    keys, counts = np.unique(seq[some].astype(np.int64) << 32 | seq[some + 1], return_counts=True)
    keys, counts = keys[counts >= floor], counts[counts >= floor]
    keys = keys[np.lexsort((keys, -counts))]
    left, right = keys >> 32, keys & 0xFFFFFFFF
    _, lead = np.unique((left * 40503 + right) & (BINS - 1), return_index=True)
    lead.sort()
    return left[lead].astype(np.int32), right[lead].astype(np.int32)


def compress(ids: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right): each round gives the most frequent pairs a nonterminal and replaces them left to right.

    The count that a round asks for falls from one to the next, by FALL, down to LEAST_COUNT; rounds then go on until no pair reaches it.
    """
    seq, lefts, rights = ids.astype(np.int32), [], []
    first, floor = terminals, len(ids)
    while len(seq) > 1:
        bins = bins_of(seq)
        filled = np.bincount(bins, minlength=BINS)
        floor = max(LEAST_COUNT, min(floor, int(filled.max())) // FALL)
        left, right = frequent_pairs(seq, bins, filled, floor)
        if not len(left):
            if floor == LEAST_COUNT:
                break
            continue
        at = (left * 40503 + right) & (BINS - 1)
        rule_of, ruled = np.zeros(BINS, np.int32), np.zeros(BINS, bool)
        rule_of[at], ruled[at] = np.arange(len(left)), True
        where = np.flatnonzero(ruled[bins])
        rule = rule_of[bins[where]]
        hit = (left[rule] == seq[where]) & (right[rule] == seq[where + 1])
        where, rule = where[hit], rule[hit]
        # Of a run of overlapping hits, every second one is replaced.
        head = np.concatenate([[True], np.diff(where) > 1])
        place = np.arange(len(where))
        pick = (place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0
        where, rule = where[pick], rule[pick]
        # A pair that lost most of its places to others waits for a later round.
        uses = np.bincount(rule, minlength=len(left))
        good = uses >= min(LEAST_COUNT // 2, int(uses.max()))
        where, rule = where[good[rule]], (np.cumsum(good) - 1)[rule[good[rule]]]
        seq[where] = first + rule
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        lefts.append(left[good])
        rights.append(right[good])
        first += int(good.sum())
    none = np.zeros(0, np.int32)
    return seq, np.concatenate(lefts or [none]), np.concatenate(rights or [none])


def expansion_lengths(left: np.ndarray, right: np.ndarray, terminals: int) -> np.ndarray:
    """Ids that each rule expands to; a rule only refers to earlier ones."""
    lengths = [1] * terminals
    for a, b in zip(left.tolist(), right.tolist()):
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths[terminals:], np.int64)


def to_blob(docs: list[np.ndarray], terminals: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    seq, left, right = compress(ids, terminals)
    small = terminals + len(left) <= 1 << 16
    kind = "<u2" if small else "<u4"
    head = np.array([terminals, len(left) | (small << 31), len(seq), len(docs)], "<u4")
    lengths = expansion_lengths(left, right, terminals)
    return b"".join([MAGIC, head.tobytes(), left.astype(kind).tobytes(), right.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), seq.astype(kind).tobytes(), np.array([len(d) for d in docs], "<u4").tobytes()])


class Shard:
    """A blob opened for reading."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a grammar shard")
        self.terminals, rules, n, docs = np.frombuffer(blob, "<u4", 4, 8).tolist()
        kind = np.dtype("<u2" if rules >> 31 else "<u4")
        rules &= 0x7FFFFFFF
        at = 24

        def take(kind: np.dtype, size: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, size, at)
            at += found.nbytes
            return found

        self.left, self.right = take(kind, rules), take(kind, rules)
        self.lengths = take(np.dtype("<u4"), rules).astype(np.int64)
        self.symbols = take(kind, n).astype(np.int64)
        self.doc_lengths = take(np.dtype("<u4"), docs).astype(np.int64)
        size = np.ones(n, np.int64)
        rule = self.symbols >= self.terminals
        size[rule] = self.lengths[self.symbols[rule] - self.terminals]
        self.ends = np.cumsum(size)
        self.table: np.ndarray | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols; rules are written out once, each from its two halves."""
        if self.table is None:
            self.starts = np.cumsum(self.lengths) - self.lengths
            table = np.zeros(int(self.lengths.sum()), "<u4")
            for to, a, b, n in zip(self.starts.tolist(), self.left.tolist(), self.right.tolist(), self.lengths.tolist()):
                for s in (a, b):
                    if s < self.terminals:
                        table[to] = s
                        to += 1
                    else:
                        k, o = int(self.lengths[s - self.terminals]), int(self.starts[s - self.terminals])
                        table[to : to + k] = table[o : o + k]
                        to += k
            self.table = table
        rule = symbols >= self.terminals
        size = np.ones(len(symbols), np.int64)
        size[rule] = self.lengths[symbols[rule] - self.terminals]
        begin = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), "<u4")
        out[begin[~rule]] = symbols[~rule]
        n = size[rule]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin[rule], n) + step] = self.table[np.repeat(self.starts[symbols[rule] - self.terminals], n) + step]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the symbols that cover them."""
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        if start >= stop:
            return np.zeros(0, "<u4")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        stop = int(self.doc_lengths[: i + 1].sum())
        return self.ids(stop - int(self.doc_lengths[i]), stop)


SHARDS = "part int, shard int, before long, n_ids long, doc_ids array<{}>, blob binary"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write docs' ids, ascending by doc_id, as grammar shards at path.

    Defined cases: a null or empty text is its end id alone; null doc_ids come first; rows that share a doc_id are ordered by
    text, and equal rows are all written; other columns are ignored; an empty table writes an empty folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(tokenizer)
        end = np.array([end_id], tokens.dtype).tobytes()
        part, shard, before, names, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([to_blob(held, tokens.size)], pa.binary())],
                ["part", "shard", "before", "n_ids", "doc_ids", "blob"],
            )

        for batch in batches:
            for some, texts in parts_of(batch, "text"):
                for name, x in zip(some.column("doc_id").to_pylist(), tokens.encode(texts)):
                    names.append(name)
                    held.append(np.frombuffer(x + end, tokens.dtype))
                    size += len(held[-1])
                    if size >= SHARD_IDS:
                        yield out()
                        shard, before, names, held, size = shard + 1, before + size, [], [], 0
        if names:
            yield out()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = ordered.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    with batch_bytes(docs.sparkSession):
        ordered.mapInArrow(run, SHARDS.format("bigint")).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if with_ids, ids (little-endian unsigned 32-bit) of every document at path.

    Per-partition totals, one small row per written partition, give each shard's place in the whole.
    """
    shards = spark.read.schema(SHARDS.format("bigint")).parquet(path)
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for p in sorted(totals):
        base[p], at = at, at + totals[p]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])
    if not with_ids:
        schema = T.StructType(schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, blob = (batch.column(c)[i].as_py() for c in ("part", "before", "blob"))
                names = batch.column("doc_ids")[i].values
                shard = Shard(blob)
                every = shard.expand(shard.symbols)
                ends = np.cumsum(shard.doc_lengths)
                starts = ends - shard.doc_lengths
                first = base[part] + before
                for a in range(0, len(ends), 5000):
                    some = [every[x:y] for x, y in zip(starts[a : a + 5000].tolist(), ends[a : a + 5000].tolist())]
                    out = [names[a : a + 5000], pa.array(first + starts[a : a + 5000]), pa.array(shard.doc_lengths[a : a + 5000]), pa.array([zlib.crc32(x) for x in some], pa.int64())]
                    if with_ids:
                        out.append(pa.array([x.tobytes() for x in some], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, schema.names)

    return shards.mapInArrow(run, schema)
