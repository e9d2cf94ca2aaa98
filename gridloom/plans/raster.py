"""read_raster: statistics of raster pixels per grid cell.

The driver opens headers, prunes tiles and chooses a level; the pixel source decodes tiles on the executors; everything after it is
built-in operators, so filters, partial aggregation, spilling and the exchange by cell are Spark's.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError, GeometryError, SourceError
from gridloom.functions import values
from gridloom.functions.grid import SPHERE_RADIUS, cell_edge, cell_lat, cell_lon, check_resolution
from gridloom.operators import assign, composite, regions, stats
from gridloom.operators.coverings import check_containment, cover
from gridloom.sources import pixels as px
from gridloom.sources.projection import from_keys
from gridloom.sources.sink import provenance, write_parquet
from gridloom.sources.store import check_options, resolve
from gridloom.sources.tiff import Raster

OVERSAMPLE = 4
SIZE_TOLERANCE = 0.02


def label_of(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", os.path.basename(re.sub(r"[?#].*$", "", resolve(path))))


def named_sources(src) -> dict[str, str]:
    """Labels and paths of a path, a list of paths, or a mapping from label to path."""
    if isinstance(src, str):
        return {label_of(src): src}
    if isinstance(src, dict):
        return dict(src)
    out: dict[str, str] = {}
    for i, p in enumerate(src):
        name = label_of(p)
        out[name if name not in out else f"{name}_{i + 1}"] = p
    if not out:
        raise ArgumentError("no source is given")
    return out


def pick_bands(raster: Raster, bands: None | int | str | Sequence) -> list[int]:
    """Zero-based numbers of bands given by name or by number from 1, in the order asked for."""
    if bands is None:
        return list(range(raster.levels[0].bands))
    want = [bands] if isinstance(bands, (int, str)) else list(bands)
    if not want or len({type(b) for b in want}) > 1 or len(set(want)) != len(want):
        raise ArgumentError("bands are distinct names or distinct numbers")
    out = []
    for b in want:
        if isinstance(b, str):
            if b not in raster.band_names:
                raise ArgumentError(f"there is no band {b!r}")
            out.append(raster.band_names.index(b))
        elif isinstance(b, bool) or not 1 <= b <= raster.levels[0].bands:
            raise ArgumentError(f"band {b} is out of range")
        else:
            out.append(b - 1)
    return out


def pixel_metres(raster: Raster, k: int = 0) -> float:
    """Larger side of a level's pixel on the ground, along great circles from the middle of the image."""
    level, t = raster.levels[k], raster.level_transform(k)
    row, col = np.array([0.0, 0.0, 1.0]) + level.height // 2, np.array([0.0, 1.0, 0.0]) + level.width // 2
    lon, lat = (np.radians(x) for x in px.lonlat_of(from_keys(raster.keys, raster.epsg), t, row, col))
    half = np.sin((lat[1:] - lat[0]) / 2) ** 2 + np.cos(lat[0]) * np.cos(lat[1:]) * np.sin((lon[1:] - lon[0]) / 2) ** 2
    sides = 2 * SPHERE_RADIUS * np.arcsin(np.minimum(1, np.sqrt(half)))
    return float(np.nanmax(sides)) if np.isfinite(sides).any() else max(math.hypot(t[1], t[4]), math.hypot(t[2], t[5]))


def choose_level(raster: Raster, resolution: int, allowed: bool) -> int:
    """The coarsest image whose pixels are at most a quarter of a cell's side."""
    best = 0
    if allowed:
        for k in range(1, len(raster.levels)):
            if pixel_metres(raster, k) * OVERSAMPLE <= cell_edge(resolution):
                best = k
    return best


def common_levels(rasters: dict[str, Raster], resolution: int, allowed: bool) -> dict[str, int]:
    """Levels of one pixel size for pooled sources: the coarsest suitable one that all have, or their full images."""
    sizes = {name: [pixel_metres(r, k) for k in range(len(r.levels))] for name, r in rasters.items()}
    first = next(iter(rasters))
    for k in range(choose_level(rasters[first], resolution, allowed), 0, -1):
        alike = {name: next((i for i, x in enumerate(found) if abs(x - sizes[first][k]) <= SIZE_TOLERANCE * sizes[first][k]), None) for name, found in sizes.items()}
        if None not in alike.values():
            return alike
    return dict.fromkeys(rasters, 0)


def tiles_in(raster: Raster, k: int, boxes: list[regions.Box] | None, align: str) -> list[tuple[int, int]]:
    """Tiles of a level that can hold pixels of the boxes; by block, those whose first pixel's centre is inside."""
    level, t = raster.levels[k], raster.level_transform(k)
    across, down = level.grid
    every = [(x, y) for y in range(down) for x in range(across)]
    if boxes is None:
        return every
    w, h = level.tile
    p, kept = from_keys(raster.keys, raster.epsg), []
    for tx, ty in every:
        if align == "block":
            lon, lat = px.lonlat_of(p, t, np.array([ty * h + 0.5]), np.array([tx * w + 0.5]))
            if any(b[0] <= lon[0] < b[2] and b[1] <= lat[0] < b[3] for b in boxes):
                kept.append((tx, ty))
            continue
        r1, c1 = min(level.height, (ty + 1) * h), min(level.width, (tx + 1) * w)
        s = np.linspace(0, 1, 33)
        rows, cols = ty * h + s * (r1 - ty * h), tx * w + s * (c1 - tx * w)
        er = np.concatenate([rows, rows, np.full(33, ty * h), np.full(33, r1)])
        ec = np.concatenate([np.full(33, tx * w), np.full(33, c1), cols, cols])
        lon, lat = px.lonlat_of(p, t, er, ec)
        if not np.isfinite(lon).all() or lon.max() - lon.min() > 180:
            kept.append((tx, ty))
            continue
        pad = 0.01 + 0.01 * max(lon.max() - lon.min(), lat.max() - lat.min())
        if any(lon.min() - pad <= b[2] and lon.max() + pad >= b[0] and lat.min() - pad <= b[3] and lat.max() + pad >= b[1] for b in boxes) or np.abs(lat).max() > 85:
            kept.append((tx, ty))
    return kept


def polygons_of(mask) -> list[list[list[tuple[float, float]]]]:
    """Polygons, each a list of rings, of WKT (POLYGON or MULTIPOLYGON, also Z), a GeoJSON geometry, or the rings of one polygon."""
    if isinstance(mask, str):
        m = re.fullmatch(r"\s*(MULTI)?POLYGON\s*(?:Z|M|ZM)?\s*(\(.*\))\s*", mask, re.I | re.S)
        if not m:
            raise GeometryError("a mask is a POLYGON or MULTIPOLYGON that isn't empty")
        # Written with brackets and commas, WKT is nested lists of points.
        text = re.sub(r"\s*([(),])\s*", r"\1", m[2])
        text = re.sub(r"[^(),]+", lambda p: str([float(x) for x in p[0].split()]), text)
        mask = {"type": "MultiPolygon" if m[1] else "Polygon", "coordinates": json.loads(text.replace("(", "[").replace(")", "]"))}
    if isinstance(mask, dict):
        if mask.get("type") not in ("Polygon", "MultiPolygon"):
            raise GeometryError("only polygons can be masks")
        found = [mask["coordinates"]] if mask["type"] == "Polygon" else mask["coordinates"]
    else:
        found = [mask]
    out = [[[(float(point[0]), float(point[1])) for point in ring] for ring in rings] for rings in found]
    if not out or any(len(ring) < 3 for rings in out for ring in rings or [[]]):
        raise GeometryError("a mask's rings need three points at least")
    return out


def covering_of(spark: SparkSession, aoi, resolution: int, containment: str) -> DataFrame:
    """The covering that an area of interest stands for: itself, or that of a box or polygons."""
    if not isinstance(aoi, DataFrame):
        if not isinstance(aoi, (str, dict)) and len(aoi) == 4 and all(isinstance(x, (int, float)) for x in aoi):
            polygons = [[[(a, b), (c, b), (c, d), (a, d)]] for a, b, c, d in regions.split_box(aoi)]
        else:
            polygons = polygons_of(aoi)
        aoi = cover(spark, polygons, resolution, containment)
    if aoi.isEmpty():
        raise GeometryError("the area of interest holds no cell")
    return aoi


def padded(boxes: list[regions.Box] | None, raster: Raster) -> list[regions.Box] | None:
    """Boxes widened by the reach of the resampling kernels; all longitudes near the poles."""
    if boxes is None:
        return None
    out = []
    for xmin, ymin, xmax, ymax in boxes:
        dy = 8 * math.degrees(pixel_metres(raster) / SPHERE_RADIUS)
        widest = max(abs(ymin - dy), abs(ymax + dy))
        dx = dy / math.cos(math.radians(widest)) if widest < 85 else 360.0
        spans = [(xmin - dx, xmax + dx)]
        spans += [(xmin - dx + 360, 180.0)] if xmin - dx < -180 else []
        spans += [(-180.0, xmax + dx - 360)] if xmax + dx > 180 else []
        out += [(max(-180.0, a), max(-90.0, ymin - dy), min(180.0, b), min(90.0, ymax + dy)) for a, b in spans]
    return out


def separate_bands(rasters: dict[str, Raster], bands: None | int | str | Sequence) -> tuple[dict[str, list[int]], list[tuple[str, int, str]]]:
    """Bands of sources side by side: zero-based numbers per source, and (label, place among them, output name) in order.

    A source of one band is named by its label, the bands of others <label>_<band>; bands picks from the list of all, by these names or by number from 1.
    """
    every = [(label, i, label if r.levels[0].bands == 1 else f"{label}_{r.band_names[i]}") for label, r in rasters.items() for i in range(r.levels[0].bands)]
    if bands is not None:
        want = [bands] if isinstance(bands, (int, str)) else list(bands)
        by_name = {name: x for x in every for name in (x[2],)}
        if not want or len(set(want)) != len(want) or len({type(b) for b in want}) > 1:
            raise ArgumentError("bands are distinct names or distinct numbers")
        for b in want:
            if (b not in by_name) if isinstance(b, str) else (isinstance(b, bool) or not 1 <= b <= len(every)):
                raise ArgumentError(f"there is no band {b!r} among {len(every)}")
        every = [by_name[b] if isinstance(b, str) else every[b - 1] for b in want]
    numbers: dict[str, list[int]] = {label: [] for label in rasters}
    columns = []
    for label, i, name in every:
        columns.append((label, len(numbers[label]), name))
        numbers[label].append(i)
    return numbers, columns


def read_raster(
    spark: SparkSession, src, resolution: int, stat="mean", bands=None, bbox=None, bbox_align: str = "pixel", aoi=None, mask=None, src_nodata: float | None = None, mode: str = "forward",
    subsamples: int | None = None, interp: str = "nearest", scoff: bool = False, dequant: Callable | None = None, as_vector: bool = False, use_overviews: bool | None = None, store_opts: dict | None = None,
    separate: bool = False, composite_by: str | None = None, value_type: str = "double", sort: bool = True, containment: str = "centre",
) -> DataFrame:
    """Cells of `resolution` with statistics of the pixels of one or more rasters.

    aoi is a covering, a DataFrame of (res, cell), or a box or polygons, of which containment takes the cells whose centre is inside or that overlap; it
    keeps whole cells, and one without cells is an error. mask is polygons in longitude and latitude. Missing values are null.
    """
    check_resolution(resolution)
    if check_containment(containment) != "centre" and (aoi is None or isinstance(aoi, DataFrame)):
        raise ArgumentError("containment other than centre needs an aoi of polygons or a box")
    wanted = stats.check_stats(stat)
    if mode not in ("forward", "overlay", "centroid"):
        raise ArgumentError("mode must be forward, overlay or centroid")
    if bbox_align not in ("pixel", "block") or (bbox_align == "block" and (bbox is None or mode == "centroid")):
        raise ArgumentError("bbox_align is pixel or block; block needs a bbox and not the centroid mode")
    if subsamples is not None and (mode != "overlay" or not 2 <= subsamples <= 64):
        raise ArgumentError("subsamples is from 2 to 64 and for the overlay mode")
    if interp != "nearest" and mode != "centroid":
        raise ArgumentError("interp is for the centroid mode")
    if scoff and dequant is not None:
        raise ArgumentError("scoff and dequant exclude each other")
    if mask is not None and mode == "centroid":
        raise ArgumentError("the centroid mode takes no mask")
    if separate and (composite_by or "npix" in wanted) or (composite_by and ({"npix", "fractions"} & set(wanted) or len(wanted) > 1)):
        raise ArgumentError("separate and composite exclude each other, npix, and composites take one statistic but fractions")
    sources = named_sources(src)
    rasters = {name: px.open_source(path, check_options(path, store_opts)) for name, path in sources.items()}
    first = next(iter(rasters.values()))
    if separate:
        of_source, columns = separate_bands(rasters, bands)
        rasters = {label: r for label, r in rasters.items() if of_source[label]}
        names = [f"_{i}" for i in range(max(map(len, of_source.values())))]
    else:
        of_source = {label: pick_bands(first, bands) for label in rasters}
        names = [first.band_names[i] for i in of_source[next(iter(rasters))]]
        sizes = [pixel_metres(r) for r in rasters.values()]
        if max(sizes) > min(sizes) * (1 + SIZE_TOLERANCE):
            raise SourceError("pooled sources differ in pixel size")
        if any(r.levels[0].bands < first.levels[0].bands for r in rasters.values()) or any([r.band_names[i] for i in pick_bands(r, bands)] != names for r in rasters.values()):
            raise SourceError("pooled sources differ in bands")
        if not scoff and len({(tuple(r.scale), tuple(r.offset)) for r in rasters.values()}) > 1:
            raise SourceError("pooled sources differ in scale or offset; read them with scoff")
    if (dequant is not None or {"majority", "fractions"} & set(wanted)) and any(r.levels[0].dtype.kind == "f" or r.levels[0].dtype.itemsize > 2 for r in rasters.values()):
        raise ArgumentError("dequant, majority and fractions need integer codes of at most 16 bits")
    overviews = (dequant is None if use_overviews is None else use_overviews) and wanted == ["mean"] and mode != "centroid"
    boxes = regions.split_box(bbox) if bbox is not None else None
    if aoi is not None:
        aoi = covering_of(spark, aoi, resolution, containment)
    k = subsamples or 0
    if mode == "overlay" and not k:
        k = max(2, min(16, math.ceil(2 * max(map(pixel_metres, rasters.values())) / cell_edge(resolution))))
    levels = {name: choose_level(r, resolution, overviews) for name, r in rasters.items()} if separate else common_levels(rasters, resolution, overviews)
    plan = []
    for name, r in rasters.items():
        at = levels[name]
        nodata = r.nodata if src_nodata is None else float(src_nodata)
        plan.append({"path": sources[name], "label": name, "level": r.levels[at], "keys": r.keys, "epsg": r.epsg, "transform": r.level_transform(at), "bands": of_source[name], "nodata": nodata, "mask": r.masks.get(at), "tiles": tiles_in(r, at, padded(boxes, r) if mode == "centroid" else boxes, bbox_align), "options": check_options(sources[name], store_opts)})
    pixels = px.scan(spark, plan, names, k if mode == "overlay" else 0)
    if scoff:
        for j, b in enumerate(names):
            scaled = [(label, values.scale_offset(F.col(b), rasters[label].scale[of_source[label][j]], rasters[label].offset[of_source[label][j]])) for label in rasters if j < len(of_source[label])]
            by_label = scaled[0][1]
            for label, one in scaled if len(scaled) > 1 else []:
                by_label = F.when(F.col("src") == label, one).otherwise(by_label)
            pixels = pixels.withColumn(b, by_label)
    elif dequant is not None:
        pixels = values.decode_codes(pixels, names, dequant)
    if mask is not None:
        pixels = pixels.where(regions.in_polygons(F.col("lon"), F.col("lat"), polygons_of(mask)))
    weight = None
    if mode == "centroid":
        return _centroid(spark, pixels, plan, names, resolution, boxes, bbox, aoi, interp, as_vector, value_type, sort)
    pixel_box = bbox is not None and bbox_align == "pixel"
    if mode == "forward":
        if pixel_box:
            pixels = pixels.where(regions.in_box(F.col("lon"), F.col("lat"), bbox))
        placed = assign.forward(pixels, resolution)
    else:
        points = F.arrays_zip(F.col("sub_lon").alias("lon"), F.col("sub_lat").alias("lat"))
        points = F.zip_with("sub_lon", "sub_lat", lambda x, y: F.struct(x.alias("lon"), y.alias("lat")))
        keep = (lambda x, y: regions.in_box(x, y, bbox)) if pixel_box else None
        placed, weight = assign.overlay(pixels, resolution, k, points, keep).drop("sub_lon", "sub_lat"), "w"
    if aoi is not None:
        placed = regions.keep_covered(placed, aoi, resolution)
    if separate:
        if len(wanted) > 1 or wanted[0] not in stats.CONTINUOUS:
            raise ArgumentError("separate takes one statistic of continuous values")
        out = composite.separate_columns(placed, [(label, names[j], name) for label, j, name in columns], wanted[0], weight=weight)
    elif composite_by:
        out = None
        for b in names:
            one = composite.composite(placed, b, wanted[0], composite_by, weight=weight)
            out = one if out is None else out.join(one, "cell", "full")
    else:
        out = stats.summarise(placed, names, wanted, weight, as_vector=as_vector, value_type=value_type)
    return stats.by_cell(out) if sort else out


def candidate_cells(spark: SparkSession, resolution: int, boxes: list[regions.Box]) -> DataFrame:
    """Cells of a resolution whose centres can lie in the boxes, generated from row and column ranges."""
    n = 1 << resolution
    out = None
    for xmin, ymin, xmax, ymax in boxes:
        x0, x1 = (max(0, min(n - 1, math.floor((x + 180) / 360 * n))) for x in (xmin, xmax))
        y0, y1 = (max(0, min(n - 1, math.floor((math.sin(math.radians(y)) + 1) / 2 * n))) for y in (ymin, ymax))
        across = x1 - x0 + 1
        cells = spark.range(across * (y1 - y0 + 1)).select((F.lit(resolution * (1 << 58)) + (F.lit(y0) + F.floor(F.col("id") / across)) * F.lit(1 << 29) + F.lit(x0) + F.col("id") % across).alias("cell"))
        out = cells if out is None else out.unionByName(cells)
    return out.distinct() if len(boxes) > 1 else out


def _centroid(spark, pixels, plan, names, resolution, boxes, bbox, aoi, interp, as_vector, value_type, sort) -> DataFrame:
    """Each cell centre is projected into each raster and sampled there; several sources are averaged."""
    out = None
    for s in plan:
        level, t, p = s["level"], s["transform"], from_keys(s["keys"], s["epsg"])
        edge = np.linspace(0, 1, 33)
        rows = np.concatenate([edge * level.height, edge * level.height, np.zeros(33), np.full(33, level.height)])
        cols = np.concatenate([np.zeros(33), np.full(33, level.width), edge * level.width, edge * level.width])
        lon, lat = px.lonlat_of(p, t, rows, cols)
        good = np.isfinite(lon)
        if good.all() and np.ptp(lon) <= 180:
            foot = [(max(-180.0, lon.min() - 0.01), max(-90.0, lat.min() - 0.01), min(180.0, lon.max() + 0.01), min(90.0, lat.max() + 0.01))]
        else:
            foot = [(-180.0, -90.0, 180.0, 90.0)]
        wanted = foot if boxes is None else regions.intersect(foot, boxes)
        if not wanted:
            continue
        cells = candidate_cells(spark, resolution, wanted)
        if bbox is not None:
            cells = regions.cells_centred_in(cells, bbox)
        if aoi is not None:
            cells = regions.keep_covered(cells, aoi, resolution)
        keys, epsg = s["keys"], s["epsg"]
        det = t[1] * t[5] - t[2] * t[4]

        def locate(batches, keys=keys, epsg=epsg, t=t, det=det):
            import pyarrow as pa

            proj = from_keys(keys, epsg)
            for b in batches:
                lon, lat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
                with np.errstate(all="ignore"):
                    x, y = proj.from_lonlat(lon, lat)
                u, v = x - t[0], y - t[3]
                col, row = (t[5] * u - t[2] * v) / det, (t[1] * v - t[4] * u) / det
                ok = np.isfinite(col) & np.isfinite(row)
                yield pa.RecordBatch.from_arrays([b.column("cell").filter(pa.array(ok)), pa.array(col[ok]), pa.array(row[ok])], ["cell", "x", "y"])

        at = cells.select("cell", cell_lon(F.col("cell")).alias("lon"), cell_lat(F.col("cell")).alias("lat")).mapInArrow(locate, "cell long, x double, y double")
        inside = at.where((F.col("x") >= 0) & (F.col("x") < level.width) & (F.col("y") >= 0) & (F.col("y") < level.height))
        one = assign.sample(inside, pixels.where(F.col("src") == s["label"]), names, interp)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ArgumentError("no cell centre lies in the region")
    if len(plan) > 1:
        out = out.groupBy("cell").agg(*[F.avg(b).alias(b) for b in names])
    out = stats.pack_vectors(out, names, ["mean"], value_type=value_type) if as_vector else out.select("cell", *[F.col(b).cast(value_type).alias(b) for b in names])
    return stats.by_cell(out) if sort else out


def raster_info(spark: SparkSession, src, store_opts: dict | None = None) -> DataFrame:
    """One row per source with what its header says."""
    rows = [px.info_row(px.open_source(path, check_options(path, store_opts)), name) for name, path in named_sources(src).items()]
    schema = (
        "label string, path string, width int, height int, n_bands int, dtype string, nodata double, scale array<double>, offset array<double>, band_names array<string>, band_metadata array<map<string,string>>, "
        "metadata map<string,string>, interleave string, compression string, block array<int>, n_blocks int, overviews array<array<int>>, crs string, geotransform array<double>"
    )
    return spark.createDataFrame(rows, schema)


def raster_to_parquet(spark: SparkSession, src, dest: str, resolution: int, stat="mean", compression: str = "zstd", **more) -> None:
    """read_raster written as Parquet with its provenance."""
    wanted = stats.check_stats(stat)
    if "fractions" in wanted:
        raise ArgumentError("fractions have no Parquet form")
    table = read_raster(spark, src, resolution, stat, **more)
    decode = "scoff" if more.get("scoff") else "dequant" if more.get("dequant") else "none"
    mode = more.get("mode", "forward")
    eligible = wanted == ["mean"] and mode != "centroid" and decode != "dequant" and more.get("use_overviews") is not False
    named = [c for c in table.columns if c not in ("cell", "npix")]
    about = provenance(resolution, ["centroid"] if mode == "centroid" else wanted, named, mode, decode, "allowed" if eligible else "off", more.get("src_nodata"), "vector" if more.get("as_vector") else "wide")
    write_parquet(table, dest, compression, about)
