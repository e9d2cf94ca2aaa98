"""Coarser pixel grids by averaging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_grid(pixels: DataFrame, bands: Sequence[str], factor: int) -> DataFrame:
    """Means of factor x factor pixels (row, col, bands); missing ones are skipped."""
    at = [F.floor(F.col(c) / factor).alias(c) for c in ("row", "col")]
    return pixels.groupBy(*at).agg(*[F.avg(b).alias(b) for b in bands])
