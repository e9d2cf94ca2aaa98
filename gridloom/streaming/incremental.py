"""Sums and counts per cell over a stream of pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.assign import forward
from gridloom.operators.stats import weighted


def running_cells(pixels: DataFrame, bands: list[str], resolution: int) -> DataFrame:
    """Streaming pixels (lon, lat, bands) as running sum and count per cell and band; both add up over chunks, so a mean follows at any time. Write it in complete or update mode."""
    out = [weighted(F.col(b), None, s).alias(f"{b}_{s}") for s in ("sum", "count") for b in bands]
    return forward(pixels, resolution).groupBy("cell").agg(*out)


def windowed_cells(captures: DataFrame, bands: list[str], resolution: int, time: str, window: str, late: str) -> DataFrame:
    """The same per time window, with a watermark that lets state go once captures can no longer be late."""
    out = [weighted(F.col(b), None, s).alias(f"{b}_{s}") for s in ("sum", "count") for b in bands]
    return forward(captures.withWatermark(time, late), resolution).groupBy(F.window(time, window), "cell").agg(*out)
