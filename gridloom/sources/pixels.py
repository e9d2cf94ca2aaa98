"""A Spark data source of raster pixels: one partition per run of tiles, rows as Arrow batches."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from gridloom.sources.projection import Projection, from_keys
from gridloom.sources.store import Ranges
from gridloom.sources.tiff import Level, Pieces, Raster, open_raster, read_tile

FORMAT = "gridloom_pixels"


class Tiles(InputPartition):
    def __init__(self, source: int, tiles: list[tuple[int, int]]):
        self.source, self.tiles = source, tiles


def open_source(path: str, options: dict | None = None) -> Raster:
    ranges = Ranges(path, options)
    try:
        return open_raster(path, lambda _: Pieces(ranges.get))
    finally:
        ranges.close()


def lonlat_of(p: Projection, t: tuple[float, ...], rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of fractional pixel positions; NaN where the projection has none."""
    x, y = t[0] + t[1] * cols + t[2] * rows, t[3] + t[4] * cols + t[5] * rows
    with np.errstate(all="ignore"):
        lon, lat = p.to_lonlat(x, y)
    bad = ~(np.isfinite(lon) & np.isfinite(lat))
    lon = np.where((lon >= -180) & (lon < 180), lon, np.mod(lon + 180, 360) - 180)
    return np.where(bad, np.nan, lon), np.where(bad, np.nan, lat)


class PixelReader(DataSourceReader):
    """Sources with fewer bands than the scan has columns get nulls in the rest. plan: per source a dict of path, label, level, tags, keys, epsg, transform, bands, nodata, mask, tiles and the store's options."""

    def __init__(self, schema: StructType, plan: list[dict], subsamples: int):
        self.schema, self.plan, self.subsamples = schema, plan, subsamples
        self.n_columns = len(schema.fields) - 5 - 2 * bool(subsamples)

    def partitions(self) -> list[Tiles]:
        return [Tiles(i, s["tiles"][a : a + 4]) for i, s in enumerate(self.plan) for a in range(0, len(s["tiles"]), 4)]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        s = self.plan[partition.source]
        level, mask = s["level"], s["mask"]
        projection = from_keys(s["keys"], s["epsg"])
        ranges = Ranges(s["path"], s["options"])
        names = [f.name for f in self.schema.fields]
        n_bands = len(s["bands"])
        k = self.subsamples
        try:
            for tx, ty in partition.tiles:
                values = read_tile(level, tx, ty, s["bands"], ranges.get)
                rows, cols, _ = values.shape
                valid = np.isfinite(values)
                if s["nodata"] is not None and not np.isnan(s["nodata"]):
                    valid &= values != s["nodata"]
                valid |= np.isinf(values) & (values != s["nodata"])
                if mask is not None:
                    valid &= (read_tile(mask, tx, ty, [0], ranges.get) > 0)[:, :, :1]
                keep = valid.any(axis=2)
                r, c = np.nonzero(keep)
                if not len(r):
                    continue
                w, h = level.tile
                row, col = r + ty * h, c + tx * w
                lon, lat = lonlat_of(projection, s["transform"], row + 0.5, col + 0.5)
                columns = [pa.array([s["label"]] * len(r), pa.string()), pa.array(row.astype(np.int64)), pa.array(col.astype(np.int64)), pa.array(lon, from_pandas=True), pa.array(lat, from_pandas=True)]
                for b in range(n_bands):
                    columns.append(pa.array(values[r, c, b], mask=~valid[r, c, b]))
                for _ in range(self.n_columns - n_bands):
                    columns.append(pa.nulls(len(r), pa.float64()))
                if k:
                    i = np.arange(k * k)
                    plon, plat = lonlat_of(projection, s["transform"], (row[:, None] + (i // k + 0.5) / k).ravel(), (col[:, None] + (i % k + 0.5) / k).ravel())
                    cuts = pa.array(np.arange(0, len(r) * k * k + 1, k * k, dtype=np.int32))
                    columns += [pa.ListArray.from_arrays(cuts, pa.array(plon, from_pandas=True)), pa.ListArray.from_arrays(cuts, pa.array(plat, from_pandas=True))]
                yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            ranges.close()


class PixelSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _plan(self) -> dict:
        return pickle.loads(bytes.fromhex(self.options["plan"]))

    def schema(self) -> StructType:
        plan = self._plan()
        fields = [StructField("src", StringType()), StructField("row", LongType()), StructField("col", LongType()), StructField("lon", DoubleType()), StructField("lat", DoubleType())]
        fields += [StructField(b, DoubleType()) for b in plan["names"]]
        if plan["subsamples"]:
            fields += [StructField("sub_lon", ArrayType(DoubleType())), StructField("sub_lat", ArrayType(DoubleType()))]
        return StructType(fields)

    def reader(self, schema: StructType) -> PixelReader:
        plan = self._plan()
        return PixelReader(schema, plan["sources"], plan["subsamples"])


def scan(spark: SparkSession, sources: list[dict], names: list[str], subsamples: int = 0):
    """Pixels with any valid band: src, row, col, lon, lat, bands by name, and the sub-points' positions where asked for."""
    spark.dataSource.register(PixelSource)
    plan = pickle.dumps({"sources": sources, "names": names, "subsamples": subsamples}).hex()
    return spark.read.format(FORMAT).option("plan", plan).load()


def level_of(raster: Raster, k: int) -> Level:
    return raster.levels[k]


def info_row(raster: Raster, label: str) -> dict:
    """What a header says, as one row of raster_info."""
    from gridloom.sources.tiff import COMPRESSION, NAMES

    x = raster.levels[0]
    t = raster.transform
    return {
        "label": label, "path": raster.path, "width": x.width, "height": x.height, "n_bands": x.bands, "dtype": str(np.dtype(x.dtype.newbyteorder("="))), "nodata": raster.nodata,
        "scale": raster.scale, "offset": raster.offset, "band_names": raster.band_names, "band_metadata": raster.band_metadata, "metadata": raster.metadata,
        "interleave": "band" if x.planar else "pixel", "compression": NAMES.get(x.one(COMPRESSION, 1), str(x.one(COMPRESSION))), "block": list(x.tile), "n_blocks": x.grid[0] * x.grid[1],
        "overviews": [[o.width, o.height] for o in raster.levels[1:]], "crs": f"EPSG:{raster.epsg}" if raster.epsg else json.dumps({str(k): v for k, v in raster.keys.items()}), "geotransform": list(t) if t else None,
    }
