"""From pixels to cells: by centre, by overlapped area, or by sampling at cell centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError
from gridloom.functions.grid import RES_UNIT, ROW_UNIT, column_of, lonlat_to_cell, row_of, wrap_lon
from gridloom.functions.values import KERNELS

MIN_WEIGHT = 1e-9
#: Sub-points a side up to which overlay_even writes them out one by one.
WRITTEN_OUT = 8


def forward(pixels: DataFrame, resolution: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Each pixel goes to the cell that holds its centre."""
    return pixels.withColumn("cell", lonlat_to_cell(F.col(lon), F.col(lat), resolution)).where("cell IS NOT NULL")


def sub_points(k: int, lon: Column, lat: Column, dlon: Column, dlat: Column) -> Column:
    """Array of the k x k points that cut a pixel of size dlon x dlat into equal parts, each at its part's centre.

    Longitudes wrap to [-180, 180). A point past a pole lies as far behind it, on the opposite meridian.
    """

    def point(i: Column) -> Column:
        x, y = lon + dlon * ((i % k + 0.5) / k - 0.5), lat + dlat * ((F.floor(i / k) + 0.5) / k - 0.5)
        past = F.abs(y) > 90
        return F.struct(wrap_lon(F.when(past, x + 180.0).otherwise(x)).alias("lon"), F.when(past, F.signum(y) * 180.0 - y).otherwise(y).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), point)


def overlay(pixels: DataFrame, resolution: int, subsamples: int, points: Column, keep: Column | None = None) -> DataFrame:
    """Each pixel goes to every cell that its sub-points hit, with the share of its points as weight w.

    Points are counted inside the row, so no shuffle separates this from the partial aggregate. keep, a condition on columns
    lon and lat of a point, leaves points out without changing the share of the others.
    """
    if not 2 <= subsamples <= 64:
        raise ArgumentError("subsamples must be from 2 to 64")
    cells = F.transform(points, lambda p: lonlat_to_cell(p["lon"], p["lat"], resolution) if keep is None else F.when(keep(p["lon"], p["lat"]), lonlat_to_cell(p["lon"], p["lat"], resolution)))
    with_cells = pixels.withColumn("_cells", F.filter(cells, lambda c: c.isNotNull()))
    part = lambda n: n / F.lit(float(subsamples**2))
    pair = lambda c, n: F.struct(c.alias("cell"), part(n).alias("w"))
    # Most pixels lie in one cell; only those that straddle an edge are counted cell by cell.
    single = F.array(pair(F.array_min("_cells"), F.size("_cells")))
    several = F.transform(F.array_distinct("_cells"), lambda c: pair(c, F.size(F.filter("_cells", lambda x: x == c))))
    hits = F.when(F.array_min("_cells") == F.array_max("_cells"), single).otherwise(several)
    return with_cells.withColumn("_hit", F.explode(hits)).select(*pixels.columns, "_hit.cell", "_hit.w")


def counted(parts: list[Column]) -> Column:
    """Array of part + 2^30 * (how many are equal) at the first of equal parts; null at the others and at null parts."""
    out = []
    for i, p in enumerate(parts):
        n = F.shiftleft(sum((F.when(p == q, 1).otherwise(0) for q in parts[i + 1 :]), F.lit(1)).cast("long"), 30)
        seen = [p == q for q in parts[:i]]
        out.append(F.when(~F.greatest(*seen, F.lit(False)), p + n) if seen else p + n)
    return F.array(*out)


def overlay_even(pixels: DataFrame, resolution: int, subsamples: int, lon: Column, lat: Column, dlon: Column, dlat: Column) -> DataFrame:
    """overlay with sub_points of pixels whose sides follow meridians and parallels.

    Such points form k rows by k columns, so latitudes and longitudes are counted apart, 2k in place of k x k, by plain expressions that
    Spark compiles (functions on arrays it interprets). A pixel at a pole gets two rows for a cell that it meets on both sides of the pole; their w add up.
    """
    k = subsamples
    if not 2 <= k <= WRITTEN_OUT:
        return overlay(pixels, resolution, k, sub_points(k, lon, lat, dlon, dlat))
    low, past = F.lit((1 << 30) - 1), F.lit(1 << 29)
    offset = [(i + 0.5) / k - 0.5 for i in range(k)]
    named = lambda what: [f"_{what}{i}" for i in range(k)]
    on_rows = pixels.select(*pixels.columns, lon.alias("_lon"), dlon.alias("_dlon"), *[(lat + dlat * o).alias(c) for o, c in zip(offset, named("y"))])
    # A row beyond a pole is marked, as its longitudes are turned.
    y = [F.col(c) for c in named("y")]
    folded = [F.when(F.abs(a) > 90, F.signum(a) * 180.0 - a).otherwise(a) for a in y]
    # Clamping to the grid takes null and NaN for its last row or column, so they are left out before.
    rows = [F.when(a.isNotNull() & ~F.isnan(a), row_of(f, resolution) + F.when(F.abs(a) > 90, past).otherwise(0)).alias(c) for a, f, c in zip(y, folded, named("r"))]
    by_row = on_rows.select(*pixels.columns, "_lon", "_dlon", *rows)
    by_row = by_row.select(*pixels.columns, "_lon", "_dlon", F.explode(counted([F.col(c) for c in named("r")])).alias("_row")).where("_row IS NOT NULL")
    turn = F.when(F.col("_row").bitwiseAND(past) != 0, 180.0).otherwise(0.0)
    by_row = by_row.select(*pixels.columns, "_row", *[(F.col("_lon") + F.col("_dlon") * o + turn).alias(c) for o, c in zip(offset, named("x"))])
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    columns = [F.when(real(F.col(c)), column_of(wrap_lon(F.col(c)), resolution)).alias(a) for c, a in zip(named("x"), named("c"))]
    by_cell = by_row.select(*pixels.columns, "_row", *columns)
    by_cell = by_cell.select(*pixels.columns, "_row", F.explode(counted([F.col(c) for c in named("c")])).alias("_column")).where("_column IS NOT NULL")
    part = lambda c: F.col(c).bitwiseAND(low)
    cell = F.lit(resolution * RES_UNIT) + part("_row").bitwiseAND(past - 1) * F.lit(ROW_UNIT) + part("_column")
    w = F.shiftright("_row", 30) * F.shiftright("_column", 30) / F.lit(float(k * k))
    return by_cell.select(*pixels.columns, cell.alias("cell"), w.alias("w"))


def stencil(cells: DataFrame, keys: tuple[str, ...], interp: str) -> DataFrame:
    """keys, x, y, row, col of the pixels around each point in pixel coordinates (pixel centres at half-numbers).

    A fixed list of numbers is exploded and rows and columns follow from it, so that Spark compiles the whole.
    """
    at = [F.col(c) for c in (*keys, "x", "y")]
    if interp == "nearest":
        return cells.select(*at, F.floor("y").cast("long").alias("row"), F.floor("x").cast("long").alias("col"))
    reach = KERNELS[interp][0]
    n = 2 * reach
    first = lambda c: F.floor(F.col(c) - 0.5) - (reach - 1)
    numbered = cells.select(*at, first("y").alias("_top"), first("x").alias("_left"), F.explode(F.array(*map(F.lit, range(n * n)))).alias("_i"))
    return numbered.select(*at, (F.col("_top") + F.floor(F.col("_i") / n)).cast("long").alias("row"), (F.col("_left") + F.col("_i") % n).cast("long").alias("col"))


def sample(cells: DataFrame, pixels: DataFrame, bands: list[str], interp: str = "nearest", keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Values of pixels (row, col, bands) at cells (keys, x, y in pixel coordinates), one row per cell with any valid band.

    Weights are normalised over valid pixels. Bicubic and Lanczos need their whole stencil valid in every band; where it is not, the
    cell takes the bilinear value. The stencil is joined on (row, col), an equi-join that grows with cells, not with cells times pixels.
    """
    if interp not in ("nearest", *KERNELS):
        raise ArgumentError("interp must be nearest, bilinear, bicubic or lanczos")
    wide = interp in ("bicubic", "lanczos")
    joined = stencil(cells, keys, interp).join(pixels.select("row", "col", *bands), ["row", "col"], "left" if wide else "inner")
    kernel = KERNELS[interp][1] if interp in KERNELS else None
    joined = joined.select(*keys, "x", "y", "row", "col", *bands, (kernel(F.col("x") - 0.5 - F.col("col")) * kernel(F.col("y") - 0.5 - F.col("row")) if kernel else F.lit(1.0)).alias("k"))
    both = []
    whole = F.min(F.when(F.greatest(*[F.col(b).isNull().cast("int") for b in bands], F.lit(0)) == 1, 0).otherwise(1)) == 1
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("x") - 0.5 - F.col("col"))) * F.greatest(F.lit(0.0), 1 - F.abs(F.col("y") - 0.5 - F.col("row")))
    for b in bands:
        def mean(weight: Column, b: str = b) -> Column:
            w = F.sum(F.when(F.col(b).isNotNull(), weight))
            return F.when(F.abs(w) > MIN_WEIGHT, F.sum(weight * F.col(b)) / w)

        both.append((F.when(whole, mean(F.col("k"))).otherwise(mean(near)) if wide else mean(F.col("k"))).alias(b))
    out = joined.groupBy(*keys).agg(*both)
    return out.where(F.coalesce(*[F.col(b) for b in bands]).isNotNull())
