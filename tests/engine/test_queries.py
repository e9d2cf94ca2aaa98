import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridloom import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    a, b = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind in "fiu":
            assert np.array_equal(a[c].astype(float), b[c].astype(float), equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_every_source_is_kept(spark, con):
    labels = [str(x) for (x,) in con.execute("SELECT DISTINCT l_linenumber FROM lineitem ORDER BY 1").fetchall()]
    assert catalog.QUERIES["separate_all"](spark, DATA).columns == ["cell", *[f"{x}_b2" for x in labels]]


def test_sub_points_wrap(spark):
    from pyspark.sql import functions as F

    from gridloom.operators.assign import sub_points

    def at(lon, lat):
        points = sub_points(2, F.lit(lon), F.lit(lat), F.lit(10.0), F.lit(10.0))
        return [tuple(p) for p in spark.range(1).select(points.alias("p")).first()["p"]]

    assert at(179.0, 0.0) == [(176.5, -2.5), (-178.5, -2.5), (176.5, 2.5), (-178.5, 2.5)]
    assert at(-180.0, 0.0)[0] == (177.5, -2.5)
    assert at(10.0, 89.0) == [(7.5, 86.5), (12.5, 86.5), (-172.5, 88.5), (-167.5, 88.5)]
    assert at(10.0, -89.0)[:2] == [(-172.5, -88.5), (-167.5, -88.5)]


def test_reducer_vectors(spark):
    from gridloom.operators.composite import reduce_sources

    def run(rows, how):
        df = spark.createDataFrame([(1, float(v), float(w)) for v, w in rows], "cell long, v double, w double")
        return reduce_sources(df, how).first()["value"]

    even = [(3, 1), (1, 1), (2, 1), (10, 1)]
    assert [run(even, h) for h in ("median", "mean", "count", "sum")] == [2.5, 4, 4, 16] and run(even, "var") == pytest.approx(50 / 3)
    assert run([(1, 9), (5, 1)], "mean") == pytest.approx(1.4) and run([(1, 9), (5, 1)], "median") == 1
    assert run([(2, 1), (7, 3), (2, 1.5)], "majority") == 7 and run([(4, 1), (3, 1)], "majority") == 3
    assert run([(4, 1)], "sd") is None and run([(float("nan"), 1)], "count") == 0 and run([(float("nan"), 1)], "mean") is None


def test_aggregate_rules(spark):
    from gridloom.errors import ArgumentError, ResolutionError
    from gridloom.operators.aggregate import aggregate

    base = 5 * (1 << 58)
    df = spark.createDataFrame([(base, 1.0, 2.0), (base + 1, None, 3.0), (base + (1 << 29), 4.0, None)], "cell long, v double, npix double")
    row = aggregate(df, 4).first()
    assert row["v"] == 1.0 and row["npix"] == 5.0
    assert aggregate(df, 4, stat="sum").first()["v"] == 5.0
    with pytest.raises(ResolutionError):
        aggregate(df, 5)
    with pytest.raises(ArgumentError):
        aggregate(df, 4, columns="nope")
    with pytest.raises(Exception, match="negative"):
        aggregate(df.withColumn("npix", -df.npix), 4).collect()


def assert_plan_is_compiled(df):
    """Functions on arrays with a lambda are interpreted, value by value."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan, plan


@pytest.mark.parametrize("name", ["overlay_all", "overlay_weighted"])
def test_overlay_is_compiled(spark, name):
    assert_plan_is_compiled(catalog.QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["centroid_nearest", "centroid_bilinear", "centroid_bicubic", "centroid_lanczos"])
def test_centroid_is_compiled(spark, name):
    assert_plan_is_compiled(catalog.QUERIES[name](spark, DATA))


@pytest.mark.parametrize("interp, reach", [("nearest", 0), ("bilinear", 1), ("bicubic", 2), ("lanczos", 3)])
def test_stencil(spark, interp, reach):
    from gridloom.operators.assign import stencil

    points = [(1, 0.5, 0.5), (2, -3.2, 7.49), (3, 5.0, 2.999)]
    found = stencil(spark.createDataFrame(points, "cell long, x double, y double"), ("cell",), interp).collect()
    span = lambda p: [math.floor(p)] if reach == 0 else range(math.floor(p - 0.5) - reach + 1, math.floor(p - 0.5) + reach + 1)
    assert sorted(tuple(r) for r in found) == sorted((i, x, y, row, col) for i, x, y in points for row in span(y) for col in span(x))


@pytest.mark.parametrize("k", [2, 3, 8, 9])
def test_overlay_even_equals_points(spark, k):
    from pyspark.sql import functions as F

    from gridloom.operators.assign import overlay, overlay_even, sub_points

    nan, inf = float("nan"), float("inf")
    lons, lats = [-180.0, -179.9, -22.5, 0.0, 13.37, 179.999, 180.0, 200.0, None, nan, inf], [-90.0, -88.0, -14.4775, 0.0, 41.3, 89.9, 90.0, None, nan]
    sizes = [(10.0, 10.0), (0.01, 60.0), (170.0, 3.0), (25.0, 100.0), (-10.0, -10.0), (None, 1.0), (1.0, nan)]
    rows = [(i, lon, lat, *s) for i, (lon, lat, s) in enumerate((a, b, s) for a in lons for b in lats for s in sizes)]
    px = spark.createDataFrame(rows, "i long, lon double, lat double, dlon double, dlat double")
    at = [F.col(c) for c in ("lon", "lat", "dlon", "dlat")]
    for resolution in (0, 4, 29):
        found = [df.select("i", "cell", "w").collect() for df in (overlay_even(px, resolution, k, *at), overlay(px, resolution, k, sub_points(k, *at)))]
        even, points = (Counter(), Counter())
        for total, table in zip((even, points), found):
            for x in table:
                total[x["i"], x["cell"]] += x["w"]
        assert even == pytest.approx(points) and len(even) >= 280
        lat = {x[0]: x[2] for x in rows}
        away = [(x["i"], x["cell"]) for x in found[0] if abs(lat[x["i"]]) < 40]
        assert len(set(away)) == len(away) > 0


def test_overlay_even_counts_wide_pixels(spark):
    from pyspark.sql import functions as F

    from gridloom.operators.assign import overlay, overlay_even, sub_points

    px = spark.createDataFrame([(0, 5.0, 84.0), (1, -100.0, -90.0)], "i long, lon double, lat double")
    at = [F.col("lon"), F.col("lat"), F.lit(500.0), F.lit(30.0)]
    total = [{(x["i"], x["cell"]): x["w"] for x in df.groupBy("i", "cell").agg(F.sum("w").alias("w")).collect()} for df in (overlay_even(px, 3, 8, *at), overlay(px, 3, 8, sub_points(8, *at)))]
    assert total[0] == total[1] and sum(total[0].values()) == 2.0
