"""Parquet output with provenance in the column metadata, and Arrow tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.errors import ArgumentError

PROVENANCE = "gridloom"


def provenance(resolution: int, stats: list[str], bands: list[str], mode: str = "forward", decode: str = "none", overviews: str = "off", nodata: float | None = None, layout: str = "wide") -> dict[str, str]:
    out = {"index": "lattice-1", "mode": mode, "decode": decode, "overviews": overviews, "nodata": "file" if nodata is None else repr(float(nodata)), "bands": "\n".join(bands), "resolution": str(resolution), "stats": "\n".join(stats), "layout": layout}
    if len(stats) == 1:
        out["stat"] = stats[0]
    return out


def write_parquet(table: DataFrame, path: str, compression: str = "zstd", metadata: dict[str, str] | None = None, single_file: bool = False, mode: str = "error") -> None:
    """Write a result; metadata goes with the cell column, where Spark keeps it in the Parquet schema."""
    if compression not in ("zstd", "snappy", "none"):
        raise ArgumentError("compression must be zstd, snappy or none")
    if "cell" not in table.columns:
        raise ArgumentError("the table needs a cell column")
    for f in table.schema.fields:
        if isinstance(f.dataType, T.MapType):
            raise ArgumentError("fractions have no Parquet form")
    marked = table.withColumn("cell", F.col("cell").alias("cell", metadata={PROVENANCE: json.dumps(metadata or {})}))
    (marked.coalesce(1) if single_file else marked).write.mode(mode).option("compression", compression).parquet(path)


def read_metadata(table: DataFrame) -> dict[str, str]:
    return json.loads(table.schema["cell"].metadata.get(PROVENANCE, "{}"))


def to_arrow(table: DataFrame):
    if any(isinstance(f.dataType, T.MapType) for f in table.schema.fields):
        raise ArgumentError("fractions have no Arrow form")
    return table.toArrow()
