"""Queries that read rasters: GeoTIFF files are written from the orders table, read back through read_raster, and held against SQL over the table.

A raster has 128 x 128 pixels of one degree around (0, 0), so its arrays are bounded whatever the table holds. A pixel gathers the orders whose key falls on
it: band price is the root of their highest total (so that no mean ends in a 5 and rounds two ways), band orders their number; pixels without orders are missing. Sources s0, s1 and s2 hold the orders whose key
leaves that remainder by 3.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError
from gridloom.plans.raster import raster_info, raster_to_parquet, read_raster
from gridloom.queries import ORACLES, cell_sql, query, rounded  # noqa: F401
from gridloom.sources.tiff import write_raster

SIDE, RES = 128, 5
ORDERS = f"SELECT o_totalprice, o_orderkey % 3 AS s, (o_orderkey * 7919) % {SIDE * SIDE} AS i FROM orders"
PIXELS = f"""
WITH o AS ({ORDERS}), a AS (SELECT i, sqrt(CAST(max(o_totalprice) AS DOUBLE)) AS price, CAST(count(*) AS DOUBLE) AS orders FROM o GROUP BY i),
b AS (SELECT i, s, sqrt(CAST(max(o_totalprice) AS DOUBLE)) AS price, CAST(count(*) AS DOUBLE) AS orders FROM o GROUP BY i, s),
p AS (SELECT *, i // {SIDE} AS y, i % {SIDE} AS x, i % {SIDE} - 63.5 AS lon, 63.5 - i // {SIDE} AS lat FROM a),
q AS (SELECT *, i % {SIDE} - 63.5 AS lon, 63.5 - i // {SIDE} AS lat FROM b),
c AS (SELECT *, {cell_sql("lon", "lat", RES)} AS cell FROM p), d AS (SELECT *, {cell_sql("lon", "lat", RES)} AS cell FROM q)
"""


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one for a local master without such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ArgumentError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
    root = root.removeprefix("file://")
    os.makedirs(root, exist_ok=True)
    return f"{root}/{uuid.uuid4().hex}-{name}"


def arrays(spark: SparkSession, sf_dir: str, by_source: bool) -> dict[str, np.ndarray]:
    """Rows x columns x (price, orders) of each source; -1 is missing."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = [((F.col("o_orderkey") * 7919) % (SIDE * SIDE)).alias("i"), (F.col("o_orderkey") % 3 if by_source else F.lit(0)).alias("s")]
    got = o.groupBy(*keys).agg(F.sqrt(F.max("o_totalprice").cast("double")).alias("price"), F.count(F.lit(1)).alias("orders")).toPandas()
    out = {}
    for s in range(3 if by_source else 1):
        a, mine = np.full((SIDE * SIDE, 2), -1.0), got[got.s == s]
        a[mine.i.to_numpy()] = mine[["price", "orders"]].to_numpy()
        out[f"s{s}"] = a.reshape(SIDE, SIDE, 2)
    return out


def files(spark: SparkSession, sf_dir: str, by_source: bool = False, turned: bool = False) -> dict[str, str]:
    """Paths of the GeoTIFF files by label. With turned, s1 has its bands in the other order, and in planes."""
    out = {}
    for name, a in arrays(spark, sf_dir, by_source).items():
        out[name] = shared_path(spark, f"{name}.tif")
        turn = turned and name == "s1"
        write_raster(out[name], a[:, :, ::-1] if turn else a, (-64.0, 1.0, 0, 64.0, 0, -1.0), nodata="-1", tile=32, planar=turn, names=["orders", "price"] if turn else ["price", "orders"])
    return out


def one(spark: SparkSession, sf_dir: str) -> str:
    return files(spark, sf_dir)["s0"]


@query("read_forward", f"{PIXELS} SELECT cell, round(avg(price), 3) AS price_mean, round(avg(orders), 4) AS orders_mean, max(price) AS price_max, max(orders) AS orders_max, CAST(count(*) AS DOUBLE) AS npix FROM c GROUP BY cell")
def read_forward(spark, d) -> DataFrame:
    return rounded(rounded(read_raster(spark, one(spark, d), RES, ["mean", "max", "npix"]), "price_mean", digits=3), "orders_mean")


@query("read_band_select", f"{PIXELS} SELECT cell, sum(orders) AS orders FROM c GROUP BY cell")
def read_band_select(spark, d):
    return read_raster(spark, one(spark, d), RES, "sum", bands="orders")


BOX = (-20.3, -31.7, 45.2, 50.9)
WITHIN = f"lon >= {BOX[0]} AND lon < {BOX[2]} AND lat >= {BOX[1]} AND lat < {BOX[3]}"


@query("read_bbox", f"{PIXELS} SELECT cell, sum(orders) AS orders, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE {WITHIN} GROUP BY cell")
def read_bbox(spark, d):
    return read_raster(spark, one(spark, d), RES, ["sum", "npix"], bands="orders", bbox=BOX)


@query("read_bbox_antimeridian", f"{PIXELS} SELECT cell, sum(orders) AS orders FROM c WHERE (lon >= 30.2 OR lon < -40.1) AND lat >= -50 AND lat < 10 GROUP BY cell")
def read_bbox_antimeridian(spark, d):
    return read_raster(spark, one(spark, d), RES, "sum", bands="orders", bbox=(30.2, -50, -40.1, 10))


@query("read_block", f"{PIXELS} SELECT cell, sum(orders) AS orders FROM (SELECT *, (x // 32) * 32 - 63.5 AS bx, 63.5 - (y // 32) * 32 AS ly FROM c) WHERE {WITHIN.replace('lon', 'bx').replace('lat', 'ly')} GROUP BY cell")
def read_block(spark, d):
    return read_raster(spark, one(spark, d), RES, "sum", bands="orders", bbox=BOX, bbox_align="block")


MASK = "MULTIPOLYGON (((-30 -20, 20 -20, 20 30, -30 30, -30 -20), (-5.2 -5.2, 5.2 -5.2, 5.2 5.2, -5.2 5.2, -5.2 -5.2)), ((0 0, 40.2 0, 40.2 40.2, 0 40.2, 0 0)))"
MASKED = "((lon > -30 AND lon < 20 AND lat > -20 AND lat < 30 AND NOT (abs(lon) < 5.2 AND abs(lat) < 5.2)) OR (lon > 0 AND lon < 40.2 AND lat > 0 AND lat < 40.2))"


@query("read_mask", f"{PIXELS} SELECT cell, sum(orders) AS orders, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE {MASKED} GROUP BY cell")
def read_mask(spark, d):
    return read_raster(spark, one(spark, d), RES, ["sum", "npix"], bands="orders", mask=MASK)


COVER = f"SELECT DISTINCT {cell_sql('lon', 'lat', 3)} AS cell FROM p WHERE price >= 600"


@query("read_aoi", f"{PIXELS}, v AS ({COVER}) SELECT c.cell, sum(orders) AS orders FROM c JOIN v ON {cell_sql('lon', 'lat', 3)} = v.cell GROUP BY c.cell")
def read_aoi(spark, d):
    path = one(spark, d)
    covering = read_raster(spark, path, 3, "max", bands="price", sort=False).where("price >= 600").select(F.lit(3).alias("res"), "cell")
    return read_raster(spark, path, RES, "sum", bands="orders", aoi=covering)


K = 3
SUB = f"u AS (SELECT price, orders, x - 64 + ((i % {K}) + 0.5) / {K} AS lon, 64 - (y + ((i // {K}) + 0.5) / {K}) AS lat FROM (SELECT price, orders, x, y FROM p), range({K * K}) t(i)), w AS (SELECT *, {cell_sql('lon', 'lat', RES)} AS cell FROM u)"


@query("read_overlay", f"{PIXELS}, {SUB} SELECT cell, round(avg(price), 3) AS price_mean, round(avg(orders), 4) AS orders_mean, round(count(*) / {K * K}.0, 4) AS price_count, round(count(*) / {K * K}.0, 4) AS orders_count FROM w GROUP BY cell")
def read_overlay(spark, d):
    got = read_raster(spark, one(spark, d), RES, ["mean", "count"], mode="overlay", subsamples=K)
    return rounded(rounded(got, "price_mean", digits=3), "orders_mean", "price_count", "orders_count")


@query("read_overlay_var", f"{PIXELS}, {SUB} SELECT cell, round(CASE WHEN count(*) > {K * K} THEN var_pop(price) * count(*) / (count(*) - {K * K}) END, 3) AS price FROM w GROUP BY cell")
def read_overlay_var(spark, d):
    got = read_raster(spark, one(spark, d), RES, "var", bands="price", mode="overlay", subsamples=K)
    return got.select("cell", F.round("price", 3).alias("price"))


CENTRES = f"""g AS (SELECT {RES} * {1 << 58} + y * {1 << 29} + x AS cell, (x + 0.5) / {1 << RES} * 360 - 180 AS lon, degrees(asin((y + 0.5) / {1 << RES} * 2 - 1)) AS lat
    FROM range({1 << RES}) a(x), range({1 << RES}) b(y)), h AS (SELECT cell, lon, lat, price, orders FROM g JOIN (SELECT x, y, price, orders FROM p) s ON s.x = floor(lon + 64) AND s.y = floor(64 - lat))"""


@query("read_centroid", f"{PIXELS}, {CENTRES} SELECT cell, price, orders FROM h")
def read_centroid(spark, d):
    return read_raster(spark, one(spark, d), RES, mode="centroid")


@query("read_centroid_bbox", f"{PIXELS}, {CENTRES} SELECT cell, price FROM h WHERE {WITHIN}")
def read_centroid_bbox(spark, d):
    return read_raster(spark, one(spark, d), RES, mode="centroid", bands="price", bbox=BOX)


@query("read_pooled", f"{PIXELS} SELECT cell, round(avg(price), 3) AS price, CAST(count(*) AS DOUBLE) AS npix FROM d GROUP BY cell")
def read_pooled(spark, d):
    return rounded(read_raster(spark, files(spark, d, by_source=True), RES, ["mean", "npix"], bands="price"), "price", digits=3)


@query("read_separate", f"{PIXELS} SELECT cell, " + ", ".join(f"round(avg(CASE WHEN s = {s} THEN {b} END), 3) AS s{s}_{b}" for s in range(3) for b in ("price", "orders")) + " FROM d GROUP BY cell")
def read_separate(spark, d):
    out = read_raster(spark, files(spark, d, by_source=True, turned=True), RES, separate=True)
    names = [f"s{s}_{b}" for s in range(3) for b in ("price", "orders")]
    return rounded(out, *names, digits=3).select("cell", *names)


PER = "e AS (SELECT cell, s, avg(price) AS v, CAST(count(*) AS DOUBLE) AS w FROM d GROUP BY cell, s)"


@query("read_composite", f"{PIXELS}, {PER} SELECT cell, round(max(v), 3) AS price FROM e GROUP BY cell")
def read_composite(spark, d):
    return rounded(read_raster(spark, files(spark, d, by_source=True), RES, bands="price", composite_by="max"), "price", digits=3)


@query("read_composite_mean", f"{PIXELS}, {PER} SELECT cell, round(sum(w * v) / sum(w), 2) AS price FROM e GROUP BY cell")
def read_composite_mean(spark, d):
    return rounded(read_raster(spark, files(spark, d, by_source=True), RES, bands="price", composite_by="mean"), "price", digits=2)


@query(
    "read_majority",
    f"{PIXELS}, m AS (SELECT cell, CAST(floor(price) AS BIGINT) % 4 AS k, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, k) AS r FROM m) SELECT cell, CAST(k AS DOUBLE) AS band_01 FROM z WHERE r = 1",
)
def read_majority(spark, d):
    a = np.floor(arrays(spark, d, False)["s0"][:, :, 0])
    path = shared_path(spark, "classes.tif")
    write_raster(path, np.where(a < 0, 255, a % 4).astype(np.uint8), (-64.0, 1.0, 0, 64.0, 0, -1.0), nodata="255", tile=32)
    return read_raster(spark, path, RES, "majority")


@query("read_parquet_round_trip", f"{PIXELS} SELECT cell, round(avg(price), 3) AS price, round(avg(orders), 4) AS orders FROM c GROUP BY cell")
def read_parquet_round_trip(spark, d):
    dest = "file://" + shared_path(spark, "table")
    raster_to_parquet(spark, one(spark, d), dest, RES)
    return rounded(rounded(spark.read.parquet(dest), "price", digits=3), "orders")


@query("read_raster_info", f"SELECT 'x' AS label, {SIDE} AS width, {SIDE} AS height, 2 AS n_bands, 'float64' AS dtype, -1.0 AS nodata, 'EPSG:4326' AS crs, 16 AS n_blocks, 'price,orders' AS bands, -64.0 AS west, 64.0 AS north FROM (SELECT max(o_orderkey) FROM orders)")
def read_raster_info(spark, d):
    info = raster_info(spark, {"x": one(spark, d)})
    return info.select("label", "width", "height", "n_bands", "dtype", "nodata", "crs", "n_blocks", F.concat_ws(",", "band_names").alias("bands"), F.col("geotransform")[0].alias("west"), F.col("geotransform")[3].alias("north"))
