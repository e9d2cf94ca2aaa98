"""Queries of the raster engine on the given tables, each with its SQL for DuckDB.

lineitem stands in for a raster that was captured once per line number: position, two bands and a class follow from its columns.
embeddings stands in for cells with 64-band vectors, events for captures over time, and range() for a regular pixel grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import grid, values
from gridloom.operators import aggregate as agg
from gridloom.operators import assign, composite, coverings, regions, stats

RES = 4

PIXELS = """
SELECT l_linenumber AS src,
       CAST((l_orderkey * 7919 + l_linenumber * 104729) % 36000 AS DOUBLE) / 100 - 179.995 AS lon,
       CAST((l_partkey * 7907 + l_suppkey * 131) % 18000 AS DOUBLE) / 100 - 89.995 AS lat,
       CASE WHEN l_tax > 0 THEN l_extendedprice END AS b1,
       l_quantity AS b2, l_tax AS tax, ascii(l_returnflag) AS cls
FROM lineitem
"""


def cell_sql(lon: str, lat: str, r: int) -> str:
    n = 1 << r
    x = f"greatest(0, least({n - 1}, CAST(floor(({lon} + 180) / 360 * {n}) AS BIGINT)))"
    y = f"greatest(0, least({n - 1}, CAST(floor((sin(radians({lat})) + 1) / 2 * {n}) AS BIGINT)))"
    return f"({r} * {1 << 58} + {y} * {1 << 29} + {x})"


CELLS = f"SELECT *, {cell_sql('lon', 'lat', RES)} AS cell FROM p"
WITH = f"WITH p AS ({PIXELS}), c AS ({CELLS})"


def r(x, digits: int = 4):
    return F.round(x, digits)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.select(*[r(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    as_double = lambda x: x.cast("double")
    return line.select(
        F.col("l_linenumber").alias("src"),
        (as_double((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 36000) / 100 - 179.995).alias("lon"),
        (as_double((F.col("l_partkey") * 7907 + F.col("l_suppkey") * 131) % 18000) / 100 - 89.995).alias("lat"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).alias("b1"),
        F.col("l_quantity").cast("double").alias("b2"),
        F.col("l_tax").alias("tax"),
        F.ascii("l_returnflag").alias("cls"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.forward(pixels(spark, sf_dir), RES)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("fwd_mean", f"{WITH} SELECT cell, round(avg(b1), 4) AS b1, round(avg(b2), 4) AS b2 FROM c GROUP BY cell")
def fwd_mean(spark, d):
    return rounded(stats.summarise(cells(spark, d), ["b1", "b2"], "mean"), "b1", "b2")


@query("fwd_sum_count", f"{WITH} SELECT cell, round(coalesce(sum(b1), 0), 2) AS b1_sum, round(sum(b2), 2) AS b2_sum, CAST(count(b1) AS DOUBLE) AS b1_count, CAST(count(b2) AS DOUBLE) AS b2_count FROM c GROUP BY cell")
def fwd_sum_count(spark, d):
    return rounded(stats.summarise(cells(spark, d), ["b1", "b2"], ["sum", "count"]), "b1_sum", "b2_sum", digits=2)


@query("fwd_minmax", f"{WITH} SELECT cell, min(b1) AS b1_min, max(b1) AS b1_max FROM c GROUP BY cell HAVING count(b1) > 0")
def fwd_minmax(spark, d):
    return stats.summarise(cells(spark, d), ["b1"], ["min", "max"])


@query("fwd_var_sd", f"{WITH} SELECT cell, round(var_samp(b2), 4) AS b2_var, round(stddev_samp(b2), 4) AS b2_sd FROM c GROUP BY cell")
def fwd_var_sd(spark, d):
    return rounded(stats.summarise(cells(spark, d), ["b2"], ["var", "sd"]), "b2_var", "b2_sd")


@query(
    "fwd_multi_stat",
    f"{WITH} SELECT cell, round(avg(b1), 4) AS b1_mean, round(avg(b2), 4) AS b2_mean, max(b1) AS b1_max, max(b2) AS b2_max, CAST(count(b1) AS DOUBLE) AS b1_count, CAST(count(b2) AS DOUBLE) AS b2_count, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE b1 IS NOT NULL OR b2 IS NOT NULL GROUP BY cell ORDER BY cell",
)
def fwd_multi_stat(spark, d):
    table = stats.summarise(cells(spark, d), ["b1", "b2"], ["mean", "max", "count", "npix"])
    return stats.by_cell(rounded(table, "b1_mean", "b2_mean"))


@query("fwd_npix", f"{WITH} SELECT cell, round(avg(b1), 4) AS b1, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE b1 IS NOT NULL GROUP BY cell")
def fwd_npix(spark, d):
    return rounded(stats.summarise(cells(spark, d), ["b1"], ["mean", "npix"]), "b1")


@query("fwd_src_nodata", f"{WITH} SELECT cell, round(avg(CASE WHEN b2 <> 50 THEN b2 END), 4) AS b2 FROM c WHERE b2 <> 50 GROUP BY cell")
def fwd_src_nodata(spark, d):
    px = cells(spark, d).withColumn("b2", values.present(F.col("b2"), 50.0))
    return rounded(stats.summarise(px, ["b2"], "mean"), "b2")


MAJORITY = "SELECT cell, cls AS k, count(*) AS n FROM c GROUP BY cell, cls"


@query("fwd_majority", f"{WITH}, m AS ({MAJORITY}), o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, k) AS i FROM m) SELECT cell, CAST(k AS DOUBLE) AS cls FROM o WHERE i = 1")
def fwd_majority(spark, d):
    return stats.summarise(cells(spark, d), ["cls"], "majority")


@query("fwd_fractions", f"{WITH}, m AS ({MAJORITY}) SELECT cell, k AS cls, round(n / sum(n) OVER (PARTITION BY cell), 6) AS share FROM m")
def fwd_fractions(spark, d):
    table = stats.summarise(cells(spark, d), ["cls"], "fractions")
    return table.select("cell", F.explode("cls").alias("cls", "share")).select("cell", "cls", r(F.col("share"), 6).alias("share"))


@query("scoff", f"{WITH} SELECT cell, round(avg(b2 * 0.5 + 10), 4) AS b2 FROM c GROUP BY cell")
def scoff(spark, d):
    px = cells(spark, d).withColumn("b2", values.scale_offset(F.col("b2"), 0.5, 10.0))
    return rounded(stats.summarise(px, ["b2"], "mean"), "b2")


@query("dequant_lut", f"{WITH} SELECT cell, round(avg(CASE WHEN b2 < 45 THEN sqrt(b2) END), 4) AS b2 FROM c WHERE b2 < 45 GROUP BY cell")
def dequant_lut(spark, d):
    import numpy as np

    def decode(x):
        return np.where((x >= 0) & (x < 45), np.sqrt(np.abs(x)), np.nan)

    px = values.decode_codes(cells(spark, d), ["b2"], decode, 0, 255)
    return rounded(stats.summarise(px, ["b2"], "mean"), "b2")


@query("dequant_aef", f"{WITH} SELECT cell, round(avg((b2 - 25) / 127.5 * abs((b2 - 25) / 127.5)), 8) AS b2 FROM c GROUP BY cell")
def dequant_aef(spark, d):
    px = cells(spark, d).withColumn("b2", values.dequant_aef(F.col("b2") - 25))
    return rounded(stats.summarise(px, ["b2"], "mean"), "b2", digits=8)


@query("bbox_pixel", f"{WITH} SELECT cell, round(avg(b2), 4) AS b2, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE lon >= -20.5 AND lat >= 10 AND lon < 60 AND lat < 70.25 GROUP BY cell")
def bbox_pixel(spark, d):
    px = cells(spark, d).where(regions.in_box(F.col("lon"), F.col("lat"), (-20.5, 10, 60, 70.25)))
    return rounded(stats.summarise(px, ["b2"], ["mean", "npix"]), "b2")


@query("bbox_antimeridian", f"{WITH} SELECT cell, round(avg(b2), 4) AS b2 FROM c WHERE (lon >= 150 OR lon < -170) AND lat >= -60 AND lat <= 90 GROUP BY cell")
def bbox_antimeridian(spark, d):
    px = cells(spark, d).where(regions.in_box(F.col("lon"), F.col("lat"), (150, -60, -170, 90)))
    return rounded(stats.summarise(px, ["b2"], "mean"), "b2")


@query("chunk_additive", f"{WITH} SELECT cell, round(sum(b2), 2) AS b2_sum, CAST(count(b2) AS DOUBLE) AS b2_count FROM c GROUP BY cell")
def chunk_additive(spark, d):
    px = cells(spark, d)
    halves = [(-180, -90, 0, 90), (0, -90, 180, 90)]
    parts = [stats.summarise(px.where(regions.in_box(F.col("lon"), F.col("lat"), b)), ["b2"], ["sum", "count"]) for b in halves]
    return rounded(composite.merge_chunks(parts, ["b2_sum", "b2_count"]), "b2_sum", digits=2)


COVER = "SELECT (n_nationkey % 3) + 1 AS res, " + cell_sql("(n_nationkey * 14.4 - 179)", "(n_nationkey * 7.2 - 89)", 3).replace("(3 *", "(3 *") + " AS c3 FROM nation"


@query(
    "aoi_semi_join",
    f"""{WITH}, v AS (SELECT (n_nationkey % 3) + 1 AS res, CAST(n_nationkey AS DOUBLE) * 14.4 - 179 AS lon, CAST(n_nationkey AS DOUBLE) * 7.2 - 89 AS lat FROM nation),
    k AS (SELECT {cell_sql("lon", "lat", 1)} AS k FROM v WHERE res = 1 UNION SELECT {cell_sql("lon", "lat", 2)} FROM v WHERE res = 2 UNION SELECT {cell_sql("lon", "lat", 3)} FROM v WHERE res = 3)
    SELECT cell, round(avg(b2), 4) AS b2 FROM c WHERE EXISTS (SELECT 1 FROM k WHERE k.k IN ({cell_sql("c.lon", "c.lat", 1)}, {cell_sql("c.lon", "c.lat", 2)}, {cell_sql("c.lon", "c.lat", 3)})) GROUP BY cell""",
)
def aoi_semi_join(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    key = F.col("n_nationkey").cast("double")
    at = nation.select((F.col("n_nationkey") % 3 + 1).alias("res"), (key * 14.4 - 179).alias("lon"), (key * 7.2 - 89).alias("lat"))
    cell = F.when(F.col("res") == 1, grid.lonlat_to_cell(F.col("lon"), F.col("lat"), 1)).when(F.col("res") == 2, grid.lonlat_to_cell(F.col("lon"), F.col("lat"), 2)).otherwise(grid.lonlat_to_cell(F.col("lon"), F.col("lat"), 3))
    kept = regions.keep_covered(cells(spark, d), at.select("res", cell.alias("cell")), RES)
    return rounded(stats.summarise(kept, ["b2"], "mean"), "b2")


TRIANGLE = [(-100.0, -40.0), (120.5, -10.25), (10.0, 75.0)]
HOLE = [(0.0, 0.0), (40.0, 5.0), (20.0, 40.0)]


def crossing_sql() -> str:
    out = []
    for ring in (TRIANGLE, HOLE):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            slope = (x2 - x1) / (y2 - y1)
            out.append(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < (lat - ({y1})) * CAST({slope!r} AS DOUBLE) + ({x1}) THEN 1 ELSE 0 END)")
    return " + ".join(out)


CENTRE_LON = f"((cell & {grid.ROW_UNIT - 1}) + 0.5) / {1 << RES} * 360 - 180"
CENTRE_LAT = f"degrees(asin((((cell >> 29) & {grid.ROW_UNIT - 1}) + 0.5) / {1 << RES} * 2 - 1))"


@query(
    "aoi_polygon",
    f"{WITH}, k AS (SELECT cell, b2, {CENTRE_LON} AS lon, {CENTRE_LAT} AS lat FROM c) SELECT cell, round(avg(b2), 4) AS b2 FROM k WHERE ({crossing_sql()}) % 2 = 1 GROUP BY cell",
)
def aoi_polygon(spark, d):
    covering = coverings.cover(spark, [[TRIANGLE, HOLE]], RES)
    return rounded(regions.keep_covered(cells(spark, d), covering, RES).groupBy("cell").agg(F.avg("b2").alias("b2")), "b2")


def nested(level: int) -> str:
    """The cells of c at a coarser level."""
    return f"{level} * {1 << 58} + (((cell >> 29) & {grid.ROW_UNIT - 1}) >> {RES - level}) * {grid.ROW_UNIT} + ((cell & {grid.ROW_UNIT - 1}) >> {RES - level})"


@query(
    "covering_intersection",
    f"{WITH}, a AS (SELECT DISTINCT cell FROM c WHERE src = 1 AND b2 > 48), b AS (SELECT DISTINCT {nested(2)} AS up FROM c WHERE lat > 60) SELECT cell FROM a WHERE {nested(2)} IN (SELECT up FROM b)",
)
def covering_intersection(spark, d):
    c = cells(spark, d)
    a = c.where("src = 1 AND b2 > 48").select("cell").distinct()
    b = c.where("lat > 60").select(grid.cell_parent(F.col("cell"), 2).alias("cell")).distinct()
    found = coverings.intersection(a, b)
    # A compact covering is written out again at the pixels' resolution.
    return found.select(F.explode(F.expr(f"sequence(0, cast(pow(4, {RES} - res) AS bigint) - 1)")).alias("i"), "res", "cell").select(coverings.descendant(F.col("cell"), F.col("i"), RES).alias("cell"))


@query("polygon_mask", f"{WITH} SELECT cell, round(avg(b2), 4) AS b2, CAST(count(*) AS DOUBLE) AS npix FROM c WHERE ({crossing_sql()}) % 2 = 1 GROUP BY cell")
def polygon_mask(spark, d):
    px = cells(spark, d).where(regions.in_polygon(F.col("lon"), F.col("lat"), [TRIANGLE, HOLE]))
    return rounded(stats.summarise(px, ["b2"], ["mean", "npix"]), "b2")


K, SIZE = 4, 10.0


@query(
    "overlay_weighted",
    f"""WITH p AS ({PIXELS}), s AS (SELECT p.b2, {cell_sql(f"(lon + {SIZE} * ((i % {K} + 0.5) / {K} - 0.5))", f"(lat + {SIZE} * (((i // {K}) + 0.5) / {K} - 0.5))", RES)} AS cell
    FROM p, range({K * K}) t(i) WHERE abs(lat) < 80 AND abs(lon) < 170)
    SELECT cell, round(sum(b2 / {K * K}) / sum(1.0 / {K * K}), 4) AS b2_mean, round(sum(1.0 / {K * K}), 4) AS b2_count FROM s GROUP BY cell""",
)
def overlay_weighted(spark, d):
    px = pixels(spark, d).where((F.abs("lat") < 80) & (F.abs("lon") < 170))
    placed = assign.overlay_even(px, RES, K, F.col("lon"), F.col("lat"), F.lit(SIZE), F.lit(SIZE))
    out = stats.summarise(placed, ["b2"], ["mean", "count"], weight="w")
    return rounded(out, "b2_mean", "b2_count")


@query(
    "overlay_all",
    f"""WITH p AS ({PIXELS}), a AS (SELECT b2, lon + {SIZE} * ((i % {K} + 0.5) / {K} - 0.5) AS x, lat + {SIZE} * (((i // {K}) + 0.5) / {K} - 0.5) AS y FROM p, range({K * K}) t(i)),
    t AS (SELECT b2, CASE WHEN abs(y) > 90 THEN x + 180 ELSE x END AS x, CASE WHEN y > 90 THEN 180 - y WHEN y < -90 THEN -180 - y ELSE y END AS lat FROM a),
    u AS (SELECT b2, lat, CASE WHEN x >= 180 THEN x - 360 WHEN x < -180 THEN x + 360 ELSE x END AS lon FROM t),
    s AS (SELECT b2, {cell_sql("lon", "lat", RES)} AS cell FROM u)
    SELECT cell, round(sum(b2 / {K * K}) / sum(1.0 / {K * K}), 4) AS b2_mean, round(sum(1.0 / {K * K}), 4) AS b2_count FROM s GROUP BY cell""",
)
def overlay_all(spark, d):
    placed = assign.overlay_even(pixels(spark, d), RES, K, F.col("lon"), F.col("lat"), F.lit(SIZE), F.lit(SIZE))
    out = stats.summarise(placed, ["b2"], ["mean", "count"], weight="w")
    return rounded(out, "b2_mean", "b2_count")


@query("pooled", f"{WITH} SELECT cell, round(avg(b2), 4) AS b2 FROM c WHERE src IN (1, 2, 3) GROUP BY cell")
def pooled(spark, d):
    px = cells(spark, d)
    whole = px.where("src = 1").unionByName(px.where("src = 2")).unionByName(px.where("src = 3"))
    return rounded(stats.summarise(whole, ["b2"], "mean"), "b2")


@query("separate", f"{WITH} SELECT cell, " + ", ".join(f'round(avg(CASE WHEN src = {i} THEN b2 END), 4) AS "{i}_b2"' for i in (1, 2, 3)) + " FROM c WHERE src IN (1, 2, 3) GROUP BY cell")
def separate(spark, d):
    return rounded(composite.separate(cells(spark, d), ["b2"], "mean", ["1", "2", "3"]), "1_b2", "2_b2", "3_b2")


SOURCES = range(1, 8)


@query("pooled_all", f"{WITH} SELECT cell, round(avg(b2), 4) AS b2 FROM c GROUP BY cell")
def pooled_all(spark, d):
    px = cells(spark, d)
    whole = reduce(DataFrame.unionByName, [px.where(F.col("src") == i) for i in SOURCES])
    return rounded(stats.summarise(whole, ["b2"], "mean"), "b2")


@query("separate_all", f"{WITH} SELECT cell, " + ", ".join(f'round(avg(CASE WHEN src = {i} THEN b2 END), 4) AS "{i}_b2"' for i in SOURCES) + " FROM c GROUP BY cell")
def separate_all(spark, d):
    return rounded(composite.separate(cells(spark, d), ["b2"], "mean", [str(i) for i in SOURCES]), *[f"{i}_b2" for i in SOURCES])


PER = "s AS (SELECT cell, src, avg(b2) AS v, CAST(count(b2) AS DOUBLE) AS w FROM c GROUP BY cell, src)"
REDUCED = {
    "mean": "sum(w * v) / sum(w)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "CAST(count(v) AS DOUBLE)",
    "var": "CASE WHEN count(v) >= 2 THEN greatest(0, sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)) / (sum(w) - sum(w * w) / sum(w)) END",
}
REDUCED["sd"] = f"sqrt({REDUCED['var']})"


def add_composite(reducer: str, sql: str) -> None:
    @query(f"composite_{reducer}", sql)
    def run(spark, d):
        return rounded(composite.composite(cells(spark, d), "b2", "mean", reducer), "b2", digits=3)


for _name, _sql in REDUCED.items():
    add_composite(_name, f"{WITH}, {PER} SELECT cell, round({_sql}, 3) AS b2 FROM s GROUP BY cell")
add_composite(
    "median",
    f"""{WITH}, {PER}, q AS (SELECT cell, v, sum(w) OVER (PARTITION BY cell ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY cell) / 2 AS half, lead(v) OVER (PARTITION BY cell ORDER BY v) AS nx FROM s),
    f AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY upto, v) AS i FROM q WHERE upto >= half - 1e-12 * greatest(half, 1))
    SELECT cell, round(CASE WHEN abs(upto - half) <= 1e-12 * greatest(half, 1) AND nx IS NOT NULL THEN (v + nx) / 2 ELSE v END, 3) AS b2 FROM f WHERE i = 1""",
)


@query(
    "composite_majority",
    f"""{WITH}, k AS (SELECT cell, src, cls, count(*) AS n FROM c GROUP BY cell, src, cls), b AS (SELECT *, row_number() OVER (PARTITION BY cell, src ORDER BY n DESC, cls) AS i FROM k),
    t AS (SELECT cell, cls, sum(n) AS w FROM b WHERE i = 1 GROUP BY cell, cls), o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY w DESC, cls) AS i FROM t)
    SELECT cell, CAST(cls AS DOUBLE) AS cls FROM o WHERE i = 1""",
)
def composite_majority(spark, d):
    return composite.composite(cells(spark, d), "cls", "majority", "majority")


FINE = 6
FINE_WITH = f"WITH p AS ({PIXELS}), f AS (SELECT {cell_sql('lon', 'lat', FINE)} AS cell, avg(b2) AS b2, CAST(count(*) AS DOUBLE) AS npix FROM p GROUP BY 1), g AS (SELECT 3 * {1 << 58} + (((cell >> 29) & {(1 << 29) - 1}) >> 3) * {1 << 29} + ((cell & {(1 << 29) - 1}) >> 3) AS cell, b2, npix FROM f)"


def fine(spark, d):
    return stats.summarise(assign.forward(pixels(spark, d), FINE), ["b2"], ["mean", "npix"])


AGG = {"mean": "sum(npix * b2) / sum(npix)", "sum": "sum(b2)", "count": "CAST(count(b2) AS DOUBLE)", "min": "min(b2)", "max": "max(b2)", "var": "var_samp(b2)", "sd": "stddev_samp(b2)"}


def add_aggregate(stat: str, sql: str) -> None:
    @query(f"agg_{stat}", f"{FINE_WITH} SELECT cell, round({sql}, 4) AS b2, sum(npix) AS npix FROM g GROUP BY cell")
    def run(spark, d):
        return rounded(agg.aggregate(fine(spark, d), 3, stat=stat, resolution_in=FINE), "b2")


for _name, _sql in AGG.items():
    add_aggregate(_name, _sql)


@query("agg_unweighted", f"{FINE_WITH} SELECT cell, round(avg(b2), 4) AS b2 FROM g GROUP BY cell")
def agg_unweighted(spark, d):
    return rounded(agg.aggregate(fine(spark, d).drop("npix"), 3, resolution_in=FINE), "b2")


def vector_cells(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    cell = F.lit(5 * (1 << 58)) + (F.col("vec_id") % 32) * F.lit(1 << 29) + F.floor(F.col("vec_id") / 32) % 32
    return emb.select(cell.alias("cell"), F.col("embedding").cast("array<double>").alias("value"), (F.col("label") + 1).cast("double").alias("npix"))


@query(
    "agg_vector",
    f"""WITH e AS (SELECT 2 * {1 << 58} + ((vec_id % 32) >> 3) * {1 << 29} + (((vec_id // 32) % 32) >> 3) AS cell, unnest(embedding) AS v, unnest(range(64)) AS i, CAST(label + 1 AS DOUBLE) AS w FROM embeddings),
    m AS (SELECT cell, i, sum(w * v) / sum(w) AS v FROM e GROUP BY cell, i)
    SELECT cell, i AS pos, round(v, 6) AS v FROM m""",
)
def agg_vector(spark, d):
    out = agg.aggregate(vector_cells(spark, d), 2, vector_length=64, resolution_in=5)
    return out.select("cell", F.posexplode("value").alias("pos", "v")).select("cell", F.col("pos").cast("long").alias("pos"), r(F.col("v"), 6).alias("v"))


@query("vector_pack", f"{WITH} SELECT cell, round(avg(b1), 4) AS v0, round(avg(b2), 4) AS v1 FROM c GROUP BY cell")
def vector_pack(spark, d):
    out = stats.summarise(cells(spark, d), ["b1", "b2"], "mean", as_vector=True)
    return out.select("cell", r(F.get("value", F.lit(0))).alias("v0"), r(F.get("value", F.lit(1))).alias("v1"))


@query("value_type_f32", f"{WITH} SELECT cell, CAST(max(b1) AS FLOAT) AS b1 FROM c GROUP BY cell HAVING count(b1) > 0")
def value_type_f32(spark, d):
    return stats.summarise(cells(spark, d), ["b1"], "max", value_type="float")


@query("cell_hex_roundtrip", f"{WITH} SELECT DISTINCT cell, lpad(lower(to_hex(cell)), 16, '0') AS hex, {RES} AS res FROM c")
def cell_hex_roundtrip(spark, d):
    out = cells(spark, d).select("cell").distinct().withColumn("hex", grid.cell_hex(F.col("cell")))
    return out.select(grid.hex_cell(F.col("hex")).alias("cell"), "hex", grid.cell_resolution(F.col("cell")).alias("res"))


@query("cell_centres", f"{WITH} SELECT DISTINCT cell, round(((cell & {(1 << 29) - 1}) + 0.5) / 16 * 360 - 180, 8) AS lon, round(degrees(asin((((cell >> 29) & {(1 << 29) - 1}) + 0.5) / 16 * 2 - 1)), 8) AS lat FROM c")
def cell_centres(spark, d):
    out = cells(spark, d).select("cell").distinct()
    return out.select("cell", r(grid.cell_lon(F.col("cell")), 8).alias("lon"), r(grid.cell_lat(F.col("cell")), 8).alias("lat"))


@query("cell_centred_in", f"{WITH}, k AS (SELECT DISTINCT cell, ((cell & {(1 << 29) - 1}) + 0.5) / 16 * 360 - 180 AS x, degrees(asin((((cell >> 29) & {(1 << 29) - 1}) + 0.5) / 16 * 2 - 1)) AS y FROM c) SELECT cell FROM k WHERE x >= -50 AND x < 75 AND y >= -30 AND y < 61")
def cell_centred_in(spark, d):
    return regions.cells_centred_in(cells(spark, d).select("cell").distinct(), (-50, -30, 75, 61))


N = 64
GRID = f"SELECT i // {N} AS row, i % {N} AS col, CASE WHEN (i * 37) % 101 <> 0 THEN CAST((i * 7919) % 1000 AS DOUBLE) / 10 END AS v FROM range({N * N}) t(i)"
POINTS = f"SELECT o_orderkey AS cell, CAST((o_orderkey * 7919) % {N * 100} AS DOUBLE) / 100 + 0.003 AS x, CAST((o_custkey * 104729) % {N * 100} AS DOUBLE) / 100 + 0.003 AS y FROM orders"


def pixel_grid(spark):
    i = F.col("id")
    return spark.range(N * N).select(F.floor(i / N).alias("row"), (i % N).alias("col"), F.when((i * 37) % 101 != 0, ((i * 7919) % 1000).cast("double") / 10).alias("v"))


def sample_points(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    at = lambda c, m: ((F.col(c) * m) % (N * 100)).cast("double") / 100 + 0.003
    return o.select(F.col("o_orderkey").alias("cell"), at("o_orderkey", 7919).alias("x"), at("o_custkey", 104729).alias("y"))


@query("centroid_nearest", f"WITH g AS ({GRID}), k AS ({POINTS}) SELECT cell, v FROM k JOIN g ON row = CAST(floor(y) AS BIGINT) AND col = CAST(floor(x) AS BIGINT) WHERE v IS NOT NULL")
def centroid_nearest(spark, d):
    return assign.sample(sample_points(spark, d), pixel_grid(spark), ["v"], "nearest")


BILINEAR = "greatest(0, 1 - abs(x - 0.5 - col)) * greatest(0, 1 - abs(y - 0.5 - row))"


@query(
    "centroid_bilinear",
    f"WITH g AS ({GRID}), k AS ({POINTS}), j AS (SELECT cell, v, {BILINEAR} AS w FROM k JOIN g ON row BETWEEN CAST(floor(y - 0.5) AS BIGINT) AND CAST(floor(y - 0.5) AS BIGINT) + 1 AND col BETWEEN CAST(floor(x - 0.5) AS BIGINT) AND CAST(floor(x - 0.5) AS BIGINT) + 1 WHERE v IS NOT NULL) SELECT cell, round(sum(w * v) / sum(w), 4) AS v FROM j GROUP BY cell HAVING abs(sum(w)) > 1e-9",
)
def centroid_bilinear(spark, d):
    return rounded(assign.sample(sample_points(spark, d), pixel_grid(spark), ["v"], "bilinear"), "v")


def cubic_sql(t: str) -> str:
    return f"(CASE WHEN abs({t}) <= 1 THEN 1.5 * pow(abs({t}), 3) - 2.5 * pow(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -0.5 * pow(abs({t}), 3) + 2.5 * pow(abs({t}), 2) - 4 * abs({t}) + 2 ELSE 0 END)"


def lanczos_sql(t: str) -> str:
    return f"(CASE WHEN abs({t}) < 1e-12 THEN 1 WHEN abs({t}) >= 3 THEN 0 ELSE 3 * sin(pi() * ({t})) * sin(pi() * ({t}) / 3) / pow(pi() * ({t}), 2) END)"


def add_wide(interp: str, reach: int, kernel) -> None:
    near = lambda p, q: f"{q} BETWEEN CAST(floor({p} - 0.5) AS BIGINT) - {reach - 1} AND CAST(floor({p} - 0.5) AS BIGINT) + {reach}"

    @query(
        f"centroid_{interp}",
        f"""WITH g AS ({GRID}), k AS ({POINTS}), j AS (SELECT cell, v, {kernel("(x - 0.5 - col)")} * {kernel("(y - 0.5 - row)")} AS w, {BILINEAR} AS b FROM k JOIN g ON {near("y", "row")} AND {near("x", "col")}),
        s AS (SELECT cell, count(v) = {4 * reach * reach} AS whole, sum(w * v) / sum(w) AS wide, sum(b * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN b END), 0) AS narrow, coalesce(sum(CASE WHEN v IS NOT NULL THEN b END), 0) AS nb FROM j GROUP BY cell)
        SELECT cell, round(CASE WHEN whole THEN wide ELSE narrow END, 4) AS v FROM s WHERE whole OR nb > 1e-9""",
    )
    def run(spark, d):
        return rounded(assign.sample(sample_points(spark, d), pixel_grid(spark), ["v"], interp), "v")


add_wide("bicubic", 2, cubic_sql)
add_wide("lanczos", 3, lanczos_sql)


@query("overview_mean", f"WITH g AS ({GRID}), o AS (SELECT row // 2 AS row, col // 2 AS col, avg(v) AS v FROM g GROUP BY 1, 2) SELECT row // 8 AS r8, col // 8 AS c8, round(avg(v), 6) AS v FROM o GROUP BY 1, 2")
def overview_mean(spark, d):
    from gridloom.operators.overviews import reduce_grid

    out = reduce_grid(reduce_grid(pixel_grid(spark), ["v"], 2), ["v"], 8)
    return out.select(F.col("row").alias("r8"), F.col("col").alias("c8"), r(F.col("v"), 6).alias("v"))


@query(
    "tile_index_filter",
    "SELECT event_type, regexp_replace(event_type, '^.*_', '') AS tail, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE year(ts) = 2024 AND month(ts) = 1 AND user_id % 360 - 180 < 20 AND user_id % 360 - 180 >= -100 GROUP BY 1, 2",
)
def tile_index_filter(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where((F.year("ts") == 2024) & (F.month("ts") == 1))
    lon = F.col("user_id") % 360 - 180
    kept = e.where((lon < 20) & (lon >= -100))
    return kept.groupBy("event_type", F.regexp_replace("event_type", "^.*_", "").alias("tail")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("v"))


@query("source_labels", "SELECT DISTINCT url, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\\.[^.]*$', '') AS label FROM pages")
def source_labels(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("url").distinct().select("url", values.source_label(F.col("url")).alias("label"))


@query("haversine", "SELECT c_custkey, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(10.0) / 2), 2) + cos(radians(c_nationkey * 3.0)) * cos(radians(c_nationkey * 3.0 + 10.0)) * pow(sin(radians(5.0) / 2), 2)))), 2) AS metres FROM customer")
def haversine(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    lat = F.col("c_nationkey") * F.lit(3.0)
    return c.select("c_custkey", r(values.haversine(F.lit(0.0), lat, F.lit(5.0), lat + 10.0), 2).alias("metres"))


@query("box_area", "SELECT n_nationkey, round(pow(6371007.180918475, 2) * radians(10.0) * (sin(radians(n_nationkey * 3.0 + 5.0)) - sin(radians(n_nationkey * 3.0))), 0) AS area FROM nation")
def box_area(spark, d):
    lat = F.col("n_nationkey") * F.lit(3.0)
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", r(values.box_area(F.lit(0.0), lat, F.lit(10.0), lat + 5.0), 0).alias("area"))
