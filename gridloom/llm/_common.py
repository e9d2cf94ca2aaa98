"""Shared helpers of the text operators: the shared folder, cut lineage, skew-safe lookups."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the innermost open scratch() block.
_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, from spark.checkpoint.dir; where that is unset, a local one for a local master, and an error for a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what materialize() writes within the block, other than tables it is told to keep, when the block ends."""
    paths: list[str] = []
    token = _WRITTEN.set(paths)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for path in paths:
            delete(spark, path)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and values that
    depend on task order (range bounds, generated ids) are fixed from here on. With keep, the table outlives a scratch() block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Level 1: each column writer holds a native compressor outside the heap, and higher levels take several times its memory.
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    written = _WRITTEN.get()
    if written is not None and not keep:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Within the block, Arrow batches that Spark sends to Python hold about `most` bytes; for work that is done when the block ends."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_name(taken: list[str], label: str) -> str:
    """A column name made from label that none of taken has, whatever its case."""
    have = {c.lower() for c in taken}
    while label.lower() in have:
        label += "_"
    return label


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join rows to a lookup with one line per key, although one key may hold a third of the rows.

    A key is hot when it has more than 1/(4 P) of the rows, P being the shuffle width; so there are at
    most 4 P hot keys, and only that bounded list is broadcast. Hot keys are dealt to several salts
    on the row side, and their lookup line is repeated once per salt. total, the number of rows, is counted where it isn't given.
    """
    width = shuffle_width(rows.sparkSession)
    if total is None:
        total = lookup.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // (4 * width))
    hot = lookup.where(F.col(count) > limit).select(
        F.col(key).alias("_hot"), F.ceil(F.col(count) / F.lit(limit)).cast("int").alias("_salts")
    )
    left = (
        rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_hot", "_salts")
    )
    salts = F.when(F.col(count) > limit, F.ceil(F.col(count) / F.lit(limit))).otherwise(1).cast("int")
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")
