"""Exact deduplication of incoming batches against immutable snapshots.

A snapshot holds one entry per distinct text: digest, the doc_id that stays and the number of copies; the bytes stay with the documents. Its entries
lie in buckets by digest, and each bucket has a static binary-fuse filter. A batch is first grouped by digest (copies within the
batch meet here, with partial aggregation, so a text that fills a third of it costs one row per task). The distinct
digests are screened by the filters of their buckets: what a filter denies is new; what it passes joins the exact bucket, where
the bytes are compared. False positives, and texts that differ under one digest, count as new.

Defined cases: a null text is an empty one, and all empty texts are equal; the smallest doc_id stays, a null doc_id counting as larger
than any other; rows that share a doc_id are separate rows of one group; other columns are ignored by the grouping; empty tables give
empty results. Texts are equal when identical after replacing each run of ASCII white space by one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import lookup_join, materialize, new_name, scratch, text_or_empty
from gridloom.llm.fuse import BinaryFuse

#: Entries per bucket that sizing aims at; a filter over them takes about half a megabyte.
BUCKET_ENTRIES = 200_000


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


@dataclass
class Snapshot:
    """entries: bucket, digest, keep_id, group_size; filters: bucket, filter."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, as bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(normalized(text_or_empty()), 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """Distinct digests of a batch: keep_id and group_size."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def bodies(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """digest, keep_id, group_size and normalised text of the rows that stay; keepers has one row per digest, and doc_id reaches few rows."""
    texts = docs.select("doc_id", normalized(text_or_empty()).alias("body")).withColumn("_digest", F.unhex(F.sha2("body", 256)))
    found = texts.join(keepers, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_digest") == F.col("digest")))
    return found.drop("doc_id", "_digest").dropDuplicates(["digest"])


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def key_of(column: pd.Series) -> np.ndarray:
    """64 bits of each digest, other than those that choose the bucket."""
    return np.frombuffer(b"".join(bytes(x[8:16]) for x in column), "<u8")


def build_filters(entries: DataFrame) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "filter": [BinaryFuse.build(key_of(rows["digest"])).to_bytes()]})

    return entries.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def snapshot(batch: DataFrame, arriving: int = 0) -> Snapshot:
    """Freeze groups as a snapshot. arriving: how many groups a batch may have at most; buckets suit the larger of the two sides."""
    n = max(batch.count(), arriving)
    buckets = max(1, -(-n // BUCKET_ENTRIES))
    entries = materialize(batch.withColumn("bucket", bucket_of(F.col("digest"), buckets)), "snapshot")
    return Snapshot(entries, materialize(build_filters(entries), "filters"), buckets)


def screen(batch: DataFrame, old: Snapshot) -> DataFrame:
    """batch with `maybe`: whether its bucket's filter passes the digest. Each group holds one row per distinct digest of one bucket, and one filter."""

    def probe(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(len(rows), bool)
        for data in filters["filter"]:
            hits |= BinaryFuse.from_bytes(data).has(key_of(rows["digest"]))
        return rows.assign(maybe=hits)[["digest", "keep_id", "group_size", "maybe"]]

    kind = batch.schema["keep_id"].dataType.simpleString()
    placed = batch.withColumn("bucket", bucket_of(F.col("digest"), old.buckets))
    return placed.groupBy("bucket").cogroup(old.filters.groupBy("bucket")).applyInPandas(probe, f"digest binary, keep_id {kind}, group_size long, maybe boolean")


def ingest(docs: DataFrame, old_docs: DataFrame, old: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of old and new together: digest, keep_id, group_size, distinct by digest.

    Bytes are compared once per screened group, between its text and the snapshot's.
    """
    screened = materialize(screen(batch, old), "screened")
    passed = screened.where("maybe").select("digest", "keep_id", "group_size")
    exact = old.entries.select("digest", F.col("keep_id").alias("old_keep"), F.col("group_size").alias("old_size"))
    hits = materialize(passed.join(exact, "digest"), "hits")
    mine = bodies(docs, hits.select("digest", "keep_id")).select("digest", "body")
    theirs = bodies(old_docs, hits.select("digest", F.col("old_keep").alias("keep_id"))).select("digest", F.col("body").alias("old_body"))
    same = mine.join(theirs, "digest").where("body = old_body").select("digest")
    grown = hits.join(same, "digest").select("digest", F.least("keep_id", "old_keep").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size"))
    fresh = screened.select("digest", "keep_id", "group_size").join(same, "digest", "left_anti")
    rest = old.entries.select("digest", "keep_id", "group_size").join(same, "digest", "left_anti")
    return grown.unionByName(fresh).unionByName(rest)


def exact_duplicates(docs: DataFrame, arriving: Column | None = None) -> DataFrame:
    """docs' rows as doc_id, keep_id, group_size, kept, text_sha256.

    arriving marks the rows of the incoming batch; the others form the snapshot. Without it, half of the rows by hash of doc_id
    arrive, so that both ways through the operator are used.
    """
    with scratch(docs.sparkSession):
        return materialize(found_duplicates(docs, arriving), "duplicates", keep=True)


def found_duplicates(docs: DataFrame, arriving: Column | None) -> DataFrame:
    arriving = F.xxhash64("doc_id") % 2 == 0 if arriving is None else arriving
    rows = materialize(digests(docs).withColumn("arrives", arriving), "digests")
    source = docs.select("doc_id", "text").withColumn("arrives", arriving)
    old = snapshot(groups(rows.where("NOT arrives")), rows.where("arrives").count())
    batch = groups(rows.where("arrives"))
    merged = materialize(ingest(source.where("arrives"), source.where("NOT arrives"), old, batch), "merged")
    joined = lookup_join(rows.select("doc_id", "digest"), merged, "digest", "group_size", F.col("doc_id"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without later copies; equal rows, doc_id included, stay once per doc_id and text. Columns of docs may have any names."""
    sha, id_, kept_sha = (new_name(docs.columns, c) for c in ("sha", "kept_id", "kept_sha"))
    keep = exact_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(kept_sha)).distinct()
    matched = docs.withColumn(sha, F.sha2(normalized(text_or_empty()), 256))
    matched = matched.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return matched.dropDuplicates(["doc_id", sha]).select(*docs.columns)
