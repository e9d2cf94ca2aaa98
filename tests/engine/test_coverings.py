"""Coverings against brute force over every cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError, GeometryError
from gridloom.functions.grid import RES_UNIT, ROW_UNIT
from gridloom.operators import coverings
from gridloom.plans.raster import covering_of

R = 6
STAR = [[(-100.0, -20.0), (10.0, 70.0), (60.0, -60.0), (5.0, 5.0)], [(0.0, 20.0), (8.0, 20.0), (8.0, 40.0), (0.0, 40.0)]]
SQUARE = [[(50.0, -30.0), (120.0, -30.0), (120.0, 10.0), (50.0, 10.0)]]


def every(r=R):
    n = 1 << r
    row, col = np.divmod(np.arange(n * n), n)
    return row, col, r * RES_UNIT + row * ROW_UNIT + col


def spread(rows, r=R):
    """Ids of resolution r under covering rows, which may not overlap."""
    out = []
    for x in rows:
        k = 1 << (r - x["res"])
        row, col = x["cell"] >> 29 & ROW_UNIT - 1, x["cell"] & ROW_UNIT - 1
        out += [r * RES_UNIT + (row * k + i) * ROW_UNIT + col * k + j for i in range(k) for j in range(k)]
    assert len(set(out)) == len(out)
    return set(out)


def of_centres(polygon, r=R):
    row, col, ids = every(r)
    west, _, east, _ = coverings.bounds(r, row, col)
    return set(ids[coverings.holds(coverings.edges_of(polygon), (west + east) / 2, coverings.bounds(r, row + 0.5, col)[1])].tolist())


def test_centres(spark):
    got = coverings.cover(spark, [STAR], R).collect()
    assert spread(got) == of_centres(STAR)
    both = coverings.cover(spark, [STAR, SQUARE], R).collect()
    assert spread(both) == of_centres(STAR) | of_centres(SQUARE)


def test_overlapping(spark):
    """Held against a dense grid of points in each cell."""
    got = spread(coverings.cover(spark, [STAR], R, "overlapping").collect())
    row, col, ids = every()
    edges, seen = coverings.edges_of(STAR), np.zeros(len(ids), bool)
    for dy in np.linspace(0.02, 0.98, 12):
        for dx in np.linspace(0.02, 0.98, 12):
            seen |= coverings.holds(edges, (col + dx) / 2**R * 360 - 180, coverings.bounds(R, row + dy, col)[1])
    sure = set(ids[seen].tolist())
    assert sure <= got and of_centres(STAR) <= got
    assert len(got - sure) <= 0.02 * len(got)


def test_whole_cells_take_no_neighbours(spark):
    box = [[(-90.0, 0.0), (0.0, 0.0), (0.0, 90.0), (-90.0, 90.0)]]
    assert [tuple(x) for x in coverings.cover(spark, [box], R, "overlapping").collect() if x["res"] < 2] == []
    assert spread(coverings.cover(spark, [box], R, "overlapping").collect()) == of_centres(box)


def test_fine_cover_is_compact(spark):
    got = coverings.cover(spark, [SQUARE], 12)
    n = got.count()
    again = coverings.compact(got)
    area = lambda df: df.agg(F.sum(F.pow(F.lit(0.25), "res"))).first()[0]
    assert n < 60_000 and again.count() <= n and area(again) == pytest.approx(area(got))


def test_algebra(spark):
    a, b = (coverings.cover(spark, [p], R) for p in (STAR, SQUARE))
    wide = [[(-170.0, -80.0), (100.0, -80.0), (100.0, 60.0), (-170.0, 60.0)]]
    c = coverings.cover(spark, [wide], R)
    assert spread(coverings.union(a, b).collect()) == of_centres(STAR) | of_centres(SQUARE)
    assert spread(coverings.intersection(a, c).collect()) == of_centres(STAR) & of_centres(wide)
    assert coverings.compact(a.limit(0)).collect() == []
    flat = spark.createDataFrame([(int(x),) for x in every(3)[2]], "cell long")
    assert [tuple(x) for x in coverings.compact(flat.union(flat)).collect()] == [(0, 0)]


def test_areas(spark):
    assert spread(covering_of(spark, (170, -10, -170, 10), 5, "centre").collect(), 5) == of_centres([[(170, -10), (180, -10), (180, 10), (170, 10)]], 5) | of_centres([[(-180, -10), (-170, -10), (-170, 10), (-180, 10)]], 5)
    with pytest.raises(GeometryError):
        covering_of(spark, "POLYGON ((0.1 0.1, 0.2 0.1, 0.2 0.2))", 3, "centre")
    assert covering_of(spark, "POLYGON ((0.1 0.1, 0.2 0.1, 0.2 0.2))", 3, "overlapping").count() == 1
    with pytest.raises(ArgumentError):
        coverings.check_containment("touching")
