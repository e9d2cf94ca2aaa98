"""Boxes, coverings and polygon masks as predicates and joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import GeometryError
from gridloom.functions.grid import cell_lat, cell_lon, cell_parent, wrap_lon

Box = tuple[float, float, float, float]


def split_box(box: Sequence[float]) -> list[Box]:
    """A checked (xmin, ymin, xmax, ymax); two boxes where it crosses the antimeridian (xmin > xmax)."""
    if len(box) != 4 or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in box):
        raise GeometryError("a box is four finite numbers")
    xmin, ymin, xmax, ymax = map(float, box)
    if not (-180 <= xmin <= 180 and -180 <= xmax <= 180 and -90 <= ymin and ymax <= 90):
        raise GeometryError("a box must lie within 180 degrees of longitude and 90 of latitude")
    if ymin >= ymax or xmin == xmax:
        raise GeometryError("a box must have an extent")
    if xmin < xmax:
        return [(xmin, ymin, xmax, ymax)]
    return [b for b in ((xmin, ymin, 180.0, ymax), (-180.0, ymin, xmax, ymax)) if b[0] < b[2]]


def intersect(a: Sequence[Box], b: Sequence[Box]) -> list[Box]:
    out = []
    for p in a:
        for q in b:
            box = (max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]))
            if box[0] < box[2] and box[1] < box[3]:
                out.append(box)
    return out


def in_box(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Half-open on the upper sides, closed where these are 180 and 90; longitudes are wrapped first."""
    x = wrap_lon(lon)
    found = F.lit(False)
    for xmin, ymin, xmax, ymax in split_box(box):
        right = (x <= xmax) if xmax == 180 else (x < xmax)
        top = (lat <= ymax) if ymax == 90 else (lat < ymax)
        found = found | ((x >= xmin) & (lat >= ymin) & right & top)
    return found


def cells_centred_in(cells: DataFrame, box: Sequence[float]) -> DataFrame:
    return cells.where(in_box(cell_lon(F.col("cell")), cell_lat(F.col("cell")), box))


#: Cells of a covering up to which it is broadcast.
BROADCAST_CELLS = 100_000


def keep_covered(pixels: DataFrame, covering: DataFrame, resolution: int) -> DataFrame:
    """Rows whose cell (of `resolution`), or an ancestor of it, is in the covering (res, cell).

    Rows are read once and joined to the distinct cells of each covering level by their ancestor at that level. A covering is broadcast only when its
    counted size allows; a larger one is joined by shuffle.
    """
    levels = [r["res"] for r in covering.select("res").distinct().collect()]
    levels = sorted(r for r in levels if r <= resolution)
    if not levels:
        return pixels.limit(0)
    small = covering.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    marked, marks = pixels, []
    for r in levels:
        cells = covering.where(F.col("res") == r).select(F.col("cell").alias(f"_cover_{r}")).distinct()
        marked = marked.join(F.broadcast(cells) if small else cells, cell_parent(F.col("cell"), r) == F.col(f"_cover_{r}"), "left")
        marks.append(f"_cover_{r}")
    return marked.where(F.coalesce(*marks).isNotNull()).drop(*marks)


def in_polygons(lon: Column, lat: Column, polygons: Sequence[Sequence[Sequence[tuple[float, float]]]]) -> Column:
    """Whether a point lies in any of several polygons, each a list of rings; where they overlap it lies in both."""
    found = F.lit(False)
    for rings in polygons:
        found = found | in_polygon(lon, lat, rings)
    return found


def in_polygon(lon: Column, lat: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Even-odd test in the plane: whether a ray to the east crosses the rings' edges an odd number of times. Built from literals, so it stays inside generated code."""
    crossings = F.lit(0)
    for ring in rings:
        points = list(ring)
        if points[0] != points[-1]:
            points.append(points[0])
        for (x1, y1), (x2, y2) in zip(points, points[1:]):
            if y1 == y2:
                continue
            spans = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
            at = (lat - float(y1)) * ((x2 - x1) / (y2 - y1)) + float(x1)
            crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1
