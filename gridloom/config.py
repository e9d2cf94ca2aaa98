"""Concurrency settings of a session, kept for the length of a block."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import SparkSession

from gridloom.errors import ArgumentError


def default_workers() -> int:
    given = os.environ.get("GRIDLOOM_CPU_WORKERS")
    return int(given) if given else len(os.sched_getaffinity(0))


@contextmanager
def concurrency(spark: SparkSession, shuffle_partitions: int | None = None, batch_rows: int | None = None):
    """Shuffle partitions and Arrow batch rows inside the block; the former values come back after it."""
    wanted = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows}
    before = {}
    for k, v in wanted.items():
        if v is not None:
            if isinstance(v, bool) or not isinstance(v, int) or v < 1:
                raise ArgumentError(f"{k} must be a positive whole number")
            before[k] = spark.conf.get(k, None)
            spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
