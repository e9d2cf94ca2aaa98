"""Expressions on values: missing codes, decoding, packing, resampling weights, distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError

EARTH_RADIUS = 6_371_008.8
CODE_MIN, CODE_MAX = -32768, 65535


def present(value: Column, nodata: float | None = None) -> Column:
    """The value as a double, null where it is NaN or the missing code."""
    v = value.cast("double")
    v = F.nanvl(v, F.lit(None).cast("double"))
    if nodata is None or math.isnan(nodata):
        return v
    return F.when(v != F.lit(float(nodata)), v)


def dequant_aef(value: Column) -> Column:
    """Signed square of value / 127.5."""
    y = value.cast("double") / 127.5
    return y * F.abs(y)


def scale_offset(value: Column, scale: float | None = None, offset: float | None = None) -> Column:
    """value * scale + offset; what is not declared is 1 and 0."""
    if scale in (None, 1.0) and offset in (None, 0.0):
        return value
    return value * F.lit(float(1.0 if scale is None else scale)) + F.lit(float(offset or 0.0))


def code_table(decode: Callable[[np.ndarray], np.ndarray], low: int = CODE_MIN, high: int = CODE_MAX) -> np.ndarray:
    """The user's decoding function, run once over every possible code; NaN means missing."""
    codes = np.arange(low, high + 1)
    out = np.asarray(decode(codes.astype(np.float64)), dtype=np.float64)
    if out.shape != codes.shape:
        raise ArgumentError("dequant must return one number for each code")
    return out


def decode_codes(df: DataFrame, columns: Sequence[str], decode: Callable[[np.ndarray], np.ndarray], low: int = CODE_MIN, high: int = CODE_MAX) -> DataFrame:
    """df with integer codes in `columns` replaced by decoded values.

    The table has at most 98,304 rows whatever df holds, so it is broadcast and joined; no Python runs per row.
    """
    table = code_table(decode, low, high)
    rows = df.sparkSession.createDataFrame([(c, None if math.isnan(v) else float(v)) for c, v in zip(range(low, high + 1), table)], "_code long, _value double")
    out = df
    for c in columns:
        joined = out.join(F.broadcast(rows), out[c].cast("long") == F.col("_code"), "left")
        out = joined.withColumn(c, F.col("_value")).drop("_code", "_value")
    return out


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box_area(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Square metres of a longitude and latitude box."""
    from gridloom.functions.grid import SPHERE_RADIUS

    return F.lit(SPHERE_RADIUS**2) * F.radians(xmax - xmin) * (F.sin(F.radians(ymax)) - F.sin(F.radians(ymin)))


def keys_cubic(t: Column) -> Column:
    """Keys' cubic convolution kernel with a = -1/2, at distance |t|."""
    a = F.abs(t)
    near = 1.5 * a * a * a - 2.5 * a * a + 1.0
    far = -0.5 * a * a * a + 2.5 * a * a - 4.0 * a + 2.0
    return F.when(a <= 1, near).when(a < 2, far).otherwise(0.0)


def lanczos3(t: Column) -> Column:
    p = F.lit(math.pi) * t
    return F.when(F.abs(t) < 1e-12, 1.0).when(F.abs(t) >= 3, 0.0).otherwise(3.0 * F.sin(p) * F.sin(p / 3) / (p * p))


def triangle(t: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.abs(t))


#: Pixels on each side of a sampling point, and the weight at a distance.
KERNELS: dict[str, tuple[int, Callable[[Column], Column]]] = {"bilinear": (1, triangle), "bicubic": (2, keys_cubic), "lanczos": (3, lanczos3)}


def source_label(path: Column) -> Column:
    """File name without query, fragment, folders and last extension."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^.*/", ""), r"\.[^.]*$", "")
