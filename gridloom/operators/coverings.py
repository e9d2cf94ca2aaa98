"""Coverings: sets of cells of several resolutions, as DataFrames of (res, cell).

cover() turns polygons into the compact covering of their cells; compact(), union() and intersection() are the algebra of coverings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError
from gridloom.functions.grid import RES_UNIT, ROW_UNIT, cell_column, cell_parent, cell_resolution, cell_row, check_resolution

Polygons = Sequence[Sequence[Sequence[tuple[float, float]]]]

#: Blocks of the first cut over a polygon's extent; each is refined by itself.
BLOCKS = 4096
#: Cells and edges that meet in one numpy step.
CELLS_AT_ONCE, EDGES_AT_ONCE = 1024, 4096


def check_containment(containment: str) -> str:
    if containment not in ("centre", "center", "overlapping"):
        raise ArgumentError("containment is centre or overlapping")
    return "centre" if containment == "center" else containment


def edges_of(rings: Sequence[Sequence[tuple[float, float]]]) -> np.ndarray:
    """(x1, y1, x2, y2) of each edge of a polygon's rings, which are closed where they aren't."""
    found = []
    for ring in rings:
        points = np.array(ring, float)[:, :2]
        if not np.array_equal(points[0], points[-1]):
            points = np.vstack([points, points[:1]])
        found.append(np.hstack([points[:-1], points[1:]]))
    return np.vstack(found)


def bounds(r: int, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, ...]:
    """West, south, east and north of cells in degrees."""
    n = 2.0**r
    lat = lambda y: np.degrees(np.arcsin(np.clip(y / n * 2 - 1, -1, 1)))
    return col / n * 360 - 180, lat(row), (col + 1) / n * 360 - 180, lat(row + 1)


def holds(edges: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Even-odd test of points, the one of regions.in_polygon."""
    odd = np.zeros(len(lon), bool)
    if not len(lon):
        return odd
    low, high = lat.min(), lat.max()
    near = edges[(np.minimum(edges[:, 1], edges[:, 3]) <= high) & (np.maximum(edges[:, 1], edges[:, 3]) >= low) & (edges[:, 1] != edges[:, 3])]
    for at in range(0, len(near), EDGES_AT_ONCE):
        x1, y1, x2, y2 = near[at : at + EDGES_AT_ONCE].T
        spans = (y1 > lat[:, None]) != (y2 > lat[:, None])
        cross = lon[:, None] < (lat[:, None] - y1) * ((x2 - x1) / (y2 - y1)) + x1
        odd ^= ((spans & cross).sum(axis=1) % 2).astype(bool)
    return odd


def crossed(edges: np.ndarray, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> np.ndarray:
    """Whether some edge runs through the inside of each rectangle; one along its border doesn't."""
    hit = np.zeros(len(west), bool)
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    near = (lo[:, 0] < east.max()) & (hi[:, 0] > west.min()) & (lo[:, 1] < north.max()) & (hi[:, 1] > south.min())
    edges, lo, hi = edges[near], lo[near], hi[near]
    for at in range(0, len(edges), EDGES_AT_ONCE):
        some = slice(at, at + EDGES_AT_ONCE)
        x1, y1, x2, y2 = edges[some].T
        boxes = (lo[some, 0] < east[:, None]) & (hi[some, 0] > west[:, None]) & (lo[some, 1] < north[:, None]) & (hi[some, 1] > south[:, None])
        sides = [(x2 - x1) * (y[:, None] - y1) - (y2 - y1) * (x[:, None] - x1) for x in (west, east) for y in (south, north)]
        hit |= (boxes & (np.minimum.reduce(sides) < 0) & (np.maximum.reduce(sides) > 0)).any(axis=1)
    return hit


def refine(polygons: list[np.ndarray], start: int, row: np.ndarray, col: np.ndarray, resolution: int, containment: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(resolution, rows, columns) of the covering inside cells of resolution `start`, depth first, so that what waits stays small."""
    stack = [(start, row, col)]
    while stack:
        r, row, col = stack.pop()
        if len(row) > CELLS_AT_ONCE:
            stack.append((r, row[CELLS_AT_ONCE:], col[CELLS_AT_ONCE:]))
            row, col = row[:CELLS_AT_ONCE], col[:CELLS_AT_ONCE]
        west, south, east, north = bounds(r, row, col)
        _, lat, _, _ = bounds(r, row + 0.5, col)
        lon = (west + east) / 2
        inside, border = np.zeros(len(row), bool), np.zeros(len(row), bool)
        for edges in polygons:
            through = crossed(edges, west, south, east, north)
            border |= through
            centre = holds(edges, lon, lat)
            # A cell that no edge of a polygon runs through is in it or out of it as a whole.
            inside |= centre & (~through if r < resolution else True)
        if r == resolution:
            keep = inside | border if containment == "overlapping" else inside
            yield r, row[keep], col[keep]
            continue
        if inside.any():
            yield r, row[inside], col[inside]
        more = border & ~inside
        if more.any():
            down, across = np.tile([0, 0, 1, 1], int(more.sum())), np.tile([0, 1, 0, 1], int(more.sum()))
            stack.append((r + 1, np.repeat(row[more] * 2, 4) + down, np.repeat(col[more] * 2, 4) + across))


def cover(spark: SparkSession, polygons: Polygons, resolution: int, containment: str = "centre") -> DataFrame:
    """The compact covering (res, cell) of polygons in longitude and latitude by cells of `resolution`, coarser where whole blocks are inside.

    containment is centre (cells whose centre is inside) or overlapping (cells whose inside meets the polygons). The extent is cut into a few thousand
    blocks, which executors refine on their own; only borders are refined, so the work grows with a polygon's outline, not its area.
    """
    check_resolution(resolution)
    containment = check_containment(containment)
    edges = [edges_of(rings) for rings in polygons]
    out = None
    for part in edges:
        west, east = part[:, [0, 2]].min(), part[:, [0, 2]].max()
        south, north = part[:, [1, 3]].min(), part[:, [1, 3]].max()
        for start in range(resolution, -1, -1):
            n = 1 << start
            place = lambda share: max(0, min(n - 1, math.floor(share * n)))  # noqa: B023, E731
            x0, x1 = (place((x + 180) / 360) for x in (west, east))
            y0, y1 = (place((math.sin(math.radians(max(-90.0, min(90.0, y)))) + 1) / 2) for y in (south, north))
            across = x1 - x0 + 1
            if across * (y1 - y0 + 1) <= BLOCKS:
                break
        blocks = across * (y1 - y0 + 1)

        def run(batches, part=part, start=start, x0=x0, y0=y0, across=across):
            for batch in batches:
                i = batch.column("id").to_numpy()
                for r, row, col in refine([part], start, y0 + i // across, x0 + i % across, resolution, containment):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), r, np.int32)), pa.array(r * RES_UNIT + row.astype(np.int64) * ROW_UNIT + col.astype(np.int64))], ["res", "cell"])

        one = spark.range(0, blocks, 1, max(1, blocks // 64)).mapInArrow(run, "res int, cell long")
        out = one if out is None else out.unionByName(one)
    return out if len(edges) == 1 else compact(out)


def ancestors(cell: Column) -> Column:
    """Array of the cells that contain `cell`, itself last."""
    res = cell_resolution(cell)

    def at(r: Column) -> Column:
        y, x = (F.call_function("shiftright", part, res - r) for part in (cell_row(cell), cell_column(cell)))
        return r.cast("long") * F.lit(RES_UNIT) + y * F.lit(ROW_UNIT) + x

    return F.transform(F.sequence(F.lit(0), res), at)


def descendant(cell: Column, i: Column, resolution: int) -> Column:
    """The i-th cell of `resolution` inside `cell`, row by row."""
    levels = F.lit(resolution) - cell_resolution(cell)
    k = F.call_function("shiftleft", F.lit(1).cast("long"), levels)
    return F.lit(resolution * RES_UNIT) + (cell_row(cell) * k + F.floor(i / k)) * F.lit(ROW_UNIT) + cell_column(cell) * k + i % k


def with_resolution(cells: DataFrame) -> DataFrame:
    return cells.select(cell_resolution(F.col("cell")).alias("res"), "cell")


def inside(cells: DataFrame, covering: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct cells of which the covering has an ancestor or, unless strict, the cell itself: an equi-join on exploded ancestors."""
    up = ancestors(F.col("cell"))
    up = F.slice(up, F.lit(1), F.size(up) - 1) if strict else up
    rows = cells.select("cell", F.explode(up).alias("above"))
    return rows.join(covering.select(F.col("cell").alias("above")).distinct(), "above", "left_semi").select("cell").distinct()


def compact(covering: DataFrame) -> DataFrame:
    """The same region with as few cells as can be: none inside another, and four siblings become their parent.

    One exchange for each resolution from the finest on, as each can complete parents for the next.
    """
    cells = covering.where(F.col("cell").isNotNull()).select("cell").distinct()
    finest = cells.agg(F.max(cell_resolution(F.col("cell")))).first()[0]
    cells = cells.join(inside(cells, cells, strict=True), "cell", "left_anti")
    for r in range(finest or 0, 0, -1):
        here = cell_resolution(F.col("cell")) == r
        groups = cells.groupBy(F.when(here, cell_parent(F.col("cell"), r - 1)).otherwise(F.col("cell")).alias("up"), here.alias("fine")).agg(F.collect_list("cell").alias("members"))
        cells = groups.select(F.explode(F.when(F.col("fine") & (F.size("members") == 4), F.array("up")).otherwise(F.col("members"))).alias("cell"))
    return with_resolution(cells)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The compact covering of what either covers."""
    return compact(a.select("cell").unionByName(b.select("cell")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The compact covering of what both cover: of two nested cells the inner one."""
    return compact(inside(a, b).unionByName(inside(b, a)))
