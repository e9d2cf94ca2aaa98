"""Supervised subword embeddings for document quality.

A document is the mean of learned vectors of its words, word bigrams, byte 3- and 4-grams of its words (word edges count as a
sign) and equality patterns of three words in a row (which of a word's two forerunners it equals), all hashed into one table; a softmax layer on the mean gives the class. Every labelled row that is not held out
is learnt from, with all its features: rows are dealt by hash to parts of about 2 * SAMPLE rows and at most about PART_BYTES, their number growing with the labels, and the executors train a model of each part by stochastic
gradient descent in numpy, for EPOCHS passes and STEPS steps at least. A class that would be rare in a part is dealt to several.
Since the mean and the layer are both linear, scoring needs a single number per table row, the difference of its
two class logits: the parts' models are averaged into one such table, which is the mean of their logits, and executors hash the whole text and average those numbers.

Defined cases: a null or empty text has no features and scores by the bias alone; rows without a label, labels without a row and
repeated labels (the smaller quality counts) are allowed; a labelled row that is repeated with the same text is learnt from once, with other texts once for each; without labels of both classes training raises NoClasses; extra columns pass through, and ones named
like added columns are refused; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import batch_bytes, text_or_empty
from gridloom.llm.tokens import parts_of, texts_of

#: Half the labelled rows of a part that one model is trained on; all rows are in some part.
SAMPLE = 1500
#: Bytes of features of a part, about; one row has 8 * BUCKETS at most.
PART_BYTES = 128 << 20
#: Rows of each class, if there are as many, that parts hold at least half of on average.
LEAST = 32
BUCKETS = 1 << 18
#: Table rows in a line of what a part's training returns.
BLOCK = 1 << 12
DIMS, EPOCHS, STEPS, RATE, BATCH, SEED = 8, 12, 2000, 2.0, 16, 7
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def scramble(h: np.ndarray) -> np.ndarray:
    """Table rows of 32-bit hashes, in place."""
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features of the texts: (table rows, position of each in the joined bytes). A blank is put around each text."""
    joined = np.frombuffer(b" " + b"".join(t.encode() + b" " for t in texts), np.uint8)
    white = WHITE[joined]
    b = np.where(white, np.uint8(32), joined).astype(np.uint32)
    # Words: a polynomial hash over prefix sums, taken at word ends.
    edge = np.diff(white.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts):
        with np.errstate(over="ignore"):
            place = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([[0], starts[1:], [len(b)]])))
            power = np.cumprod(np.concatenate([[1], np.full(min(int((ends - starts).max()), len(b)), 0x01000193)]).astype(np.uint32), dtype=np.uint32)
            weighted = np.where(white, np.uint32(0), (b + np.uint32(1)) * power[np.minimum(np.maximum(place, 0), len(power) - 1)])
            words = np.add.reduceat(weighted, starts, dtype=np.uint32)
            pairs = words[:-1] * np.uint32(0x9E3779B1) ^ words[1:]
            text = np.searchsorted(spans(texts), starts, "right")
            within = np.flatnonzero(text[1:] == text[:-1])
            yield scramble(words), starts
            yield scramble(pairs[within]), starts[1:][within]
            # Patterns stand for word n-grams whatever the words, so what is learnt of repeats holds for words not seen in training.
            near = words[2:] == words[1:-1]
            pattern = np.uint32(11) + near + np.uint32(2) * (words[2:] == words[:-2])
            within = np.flatnonzero(text[2:] == text[:-2])
            yield scramble(pattern[within] * np.uint32(0x85EBCA6B)), starts[2:][within]
    for n in (3, 4):
        if len(b) < n:
            continue
        with np.errstate(over="ignore"):
            h = np.full(len(b) - n + 1, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= b[k : len(b) - n + 1 + k]
            inner = white[1 : len(b) - n + 2].copy()
            for k in range(2, n - 1):
                inner |= white[k : len(b) - n + 1 + k]
            at = np.flatnonzero(~inner)
            yield scramble(h[at]), at


def spans(texts: list[str]) -> np.ndarray:
    """Where each text begins in the joined bytes, and where the last ends."""
    return np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])


@dataclass
class Model:
    """weights: logit of class 1 over class 0 of each table row; bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        bounds = spans(texts)
        for rows, at in features(texts):
            owner = np.searchsorted(bounds, at, "right") - 1 if len(texts) > 1 else np.zeros(len(at), np.int64)
            total += np.bincount(owner, self.weights[rows], len(texts))[: len(texts)]
            count += np.bincount(owner, minlength=len(texts))[: len(texts)]
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def labelled(docs: DataFrame, labels: DataFrame, *columns: Column) -> DataFrame:
    """Different doc_id, quality and columns of the labelled rows that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality IN (0, 1)")
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", *columns).join(known, "doc_id").distinct()


def plan_parts(rows: list[int], sizes: list[int], sample: int) -> tuple[int, list[int]]:
    """How many parts so many rows of each class with about so many bytes of features are dealt to, and how many of them a row of each class is in."""
    number = max(1, -(-sum(rows) // (2 * sample)), -(-sum(sizes) // PART_BYTES))
    copies = []
    for n, size in zip(rows, sizes):
        least = max(LEAST, min(sample // 4, PART_BYTES * n // (4 * max(1, size))))
        copies.append(min(number, max(1, number * least // max(1, n))))
    return number, copies


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every labelled row that is not held out (key, quality, text), with the part it is dealt to, one partition for each part."""
    text = text_or_empty()
    size = F.least(F.octet_length(text), F.lit(BUCKETS)).cast("long") * 8
    got = labelled(docs, labels, F.xxhash64(text).alias("hash"), size.alias("size")).groupBy("quality").agg(F.count("*"), F.sum("size")).collect()
    counts = {r[0]: (r[1], r[2]) for r in got}
    if len(counts) < 2:
        raise NoClasses("labels of both classes are needed")
    number, copies = plan_parts([counts[k][0] for k in (0, 1)], [counts[k][1] for k in (0, 1)], sample)
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 0, copies[0]).otherwise(copies[1]) - 1))
    dealt = labelled(docs, labels, text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text")).withColumn("copy", copy)
    part = F.pmod(F.pmod(F.xxhash64("key"), F.lit(number)) + F.col("copy"), F.lit(number)).cast("int")
    return dealt.select("key", "quality", "text", part.alias("part")).repartitionById(number, "part")


def learn(batches: Iterator[pa.RecordBatch], prior: float) -> Iterator[tuple[int, Model]]:
    """The model of each part in a partition."""
    held: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "quality"))
        for part, key, quality, t in zip(*columns, texts_of(batch.column("text"))):
            found = [rows for rows, _ in features([t])]
            rows, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
            held.setdefault(part, []).append((key, quality, rows, n.astype(np.uint32)))
    while held:
        part, documents = held.popitem()
        documents.sort(key=lambda d: d[:2])
        yield part, fit([d[2] for d in documents], [d[3] for d in documents], np.array([d[1] for d in documents], np.int64), prior)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit(rows: list[np.ndarray], counts: list[np.ndarray], classes: np.ndarray, prior: float) -> Model:
    """Stochastic gradient descent on the softmax loss; prior is class 1's share of all labels, against the sample's. rows and counts: per document."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)

    shares = [(c / max(1, c.sum())).astype(np.float32) for c in counts]
    step, met = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    balance = np.array([1 / max(1, (classes == k).sum()) for k in (0, 1)], np.float32)[classes]
    balance /= balance.mean()
    epochs = max(EPOCHS, -(-STEPS // -(-len(classes) // BATCH)))
    steps, done = epochs * len(classes), 0
    for _ in range(epochs):
        order = rng.permutation(len(classes))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            rate = RATE * (1 - done / steps)
            done += len(some)
            mean = np.stack([shares[i] @ vectors.take(rows[i], 0) for i in some])
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), classes[some]] -= 1
            p *= balance[some, None] / len(some)
            # With two classes all gradients of a batch's vectors are along one direction, so they add up to a number per table row.
            along = rate * len(some) * (layer[:, 1] - layer[:, 0])
            layer -= rate * mean.T @ p
            bias -= rate * p.sum(0)
            for i, slope in zip(some, p[:, 1]):
                step[rows[i]] += shares[i] * slope
                met[rows[i]] = True
            at = np.flatnonzero(met)
            moved, by = vectors.take(at, 0), step[at]
            for k in range(DIMS):
                moved[:, k] -= by * along[k]
            vectors[at] = moved
            step[at], met[at] = 0, False
    weights = vectors @ (layer[:, 1] - layer[:, 0])
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(weights.astype(np.float32), float(bias[1] - bias[0]) + float(np.log(prior / (1 - prior))))


class NoClasses(ValueError):
    """The labelled rows don't show both classes."""


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The mean of the models of all parts; a part has about 2 * sample rows."""
    with batch_bytes(docs.sparkSession):
        texts = training_rows(docs, labels, sample)
        share = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
        prior = share.agg(F.avg(F.col("quality").cast("double"))).first()[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, model in learn(batches, prior):
                blocks = model.weights.astype("<f4").reshape(-1, BLOCK)
                columns = [pa.array([part] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([model.bias] * len(blocks))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "weights", "bias"])

        def mean(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            total = np.zeros(BLOCK)
            for w in table["weights"]:
                total += np.frombuffer(w.as_buffer(), "<f4")
            weights = pa.array([(total / len(table)).astype("<f4").tobytes()], pa.binary())
            return pa.table({"block": table["block"][:1], "weights": weights, "bias": [sum(table["bias"].to_pylist()) / len(table)]})

        models = texts.mapInArrow(run, "part int, block int, weights binary, bias double")
        got = models.groupBy("block").applyInArrow(mean, "block int, weights binary, bias double").orderBy("block").collect()
    return Model(np.concatenate([np.frombuffer(r["weights"], "<f4") for r in got]), got[0]["bias"])


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with score (0 to 1, higher: class 1 likelier) and predicted (1 from 0.5 on); without the text unless keep_text."""
    if clash := [c for c in ("score", "predicted") if c in docs.columns]:
        raise ValueError(f"columns {clash} are already there")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts_of(batch, text):
                s = shared.value.scores(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*(f.name for f in kept), "score", "predicted"])

    return docs.mapInArrow(run, schema)
