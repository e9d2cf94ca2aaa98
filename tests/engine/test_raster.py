import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import ArgumentError, GeometryError, ResolutionError, SourceError
from gridloom.functions import grid
from gridloom.plans import raster
from gridloom.sources import projection, sink, store, tiff

R = 9


def cell_of(lon, lat, r=R):
    n = 1 << r
    x = np.clip(np.floor((lon + 180) / 360 * n), 0, n - 1).astype(np.int64)
    y = np.clip(np.floor((np.sin(np.radians(lat)) + 1) / 2 * n), 0, n - 1).astype(np.int64)
    return r * (1 << 58) + y * (1 << 29) + x


@pytest.fixture(scope="module")
def codes(tmp_path_factory):
    """128 x 128 signed bytes in two bands, 10 x 10 missing."""
    r, c = np.mgrid[0:128, 0:128]
    a = np.stack([(3 * c + 7 * r) % 255 - 127, (5 * c + 2 * r) % 255 - 127], axis=2).astype(np.int8)
    a[:10, :10] = -128
    path = str(tmp_path_factory.mktemp("r") / "codes.tif")
    tiff.write_raster(path, a, (12.0, 0.1 / 128, 0, 48.1, 0, -0.1 / 128), nodata="-128", names=["A01", "A02"], overviews=[2, 4], scale=[0.5, 2.0], offset=[1.0, 0.0])
    lon, lat = 12 + (c + 0.5) * 0.1 / 128, 48.1 - (r + 0.5) * 0.1 / 128
    return path, a, lon, lat


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.DEFLATE, tiff.ZSTD, tiff.PACKBITS])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind,predictor", [("u2", 1), ("u2", 2), ("f4", 1), ("f4", 3), ("i1", 2)])
def test_tiles_round_trip(tmp_path, compression, planar, order, kind, predictor):
    a = (np.arange(50 * 70 * 2) % 251).reshape(50, 70, 2).astype(kind)
    path = str(tmp_path / "x.tif")
    tiff.write_raster(path, a, (0, 1, 0, 0, 0, -1), tile=32, compression=compression, planar=planar, order=order, predictor=predictor)
    data = open(path, "rb").read()
    x = tiff.open_raster(path, lambda p: data)
    level = x.levels[0]
    for ty in range(2):
        for tx in range(3):
            got = tiff.read_tile(level, tx, ty, [1, 0], lambda o, n: data[o : o + n])
            assert np.array_equal(got, a[ty * 32 : ty * 32 + 32, tx * 32 : tx * 32 + 32][:, :, [1, 0]].astype(float))


def test_lzw():
    # The worked example of the TIFF 6.0 specification.
    assert tiff.unpack_lzw(lzw_codes([256, 7, 258, 8, 8, 258, 6, 6, 257])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def lzw_codes(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_forward_matches_numpy(spark, codes):
    path, a, lon, lat = codes
    got = {x["cell"]: x for x in raster.read_raster(spark, path, R + 3, ["mean", "sum", "count", "min", "max", "npix"], use_overviews=False).collect()}
    cells = cell_of(lon, lat, R + 3)
    valid = a[:, :, 0] != -128
    for c in np.unique(cells[valid]):
        v = a[:, :, 0][(cells == c) & valid].astype(float)
        x = got.pop(int(c))
        assert x["A01_mean"] == pytest.approx(v.mean()) and x["A01_sum"] == v.sum() and x["A01_count"] == len(v) == x["npix"]
        assert (x["A01_min"], x["A01_max"]) == (v.min(), v.max())
    assert not got


def test_scale_offset_commutes_with_the_mean(spark, codes):
    path = codes[0]
    plain = raster.read_raster(spark, path, R, use_overviews=False).toPandas()
    scaled = raster.read_raster(spark, path, R, scoff=True, use_overviews=False).toPandas()
    assert np.allclose(scaled.A01, plain.A01 * 0.5 + 1) and np.allclose(scaled.A02, plain.A02 * 2)


def test_dequant_and_majority_and_fractions(spark, codes):
    path, a, lon, lat = codes
    got = raster.read_raster(spark, path, R, dequant=lambda x: np.where(x > 0, x / 127.5, np.nan), bands="A02").toPandas()
    v = a[:, :, 1].astype(float)
    cells = cell_of(lon, lat)
    for row in got.itertuples():
        m = (cells == row.cell) & (v > 0)
        assert row.A02 == pytest.approx((v[m] / 127.5).mean())
    shares = raster.read_raster(spark, path, R, "fractions", bands=[1]).collect()
    assert all(sum(x["A01"].values()) == pytest.approx(1) for x in shares)
    top = {x["cell"]: x["A01"] for x in raster.read_raster(spark, path, R, "majority", bands=[1]).collect()}
    for x in shares:
        best = max(x["A01"].values())
        assert top[x["cell"]] == min(k for k, s in x["A01"].items() if s == best)


def test_overlay_conserves_mass(spark, codes):
    path, a, _, _ = codes
    got = raster.read_raster(spark, path, R + 4, ["sum", "count"], mode="overlay", subsamples=3, bands="A01").toPandas()
    v = a[:, :, 0][a[:, :, 0] != -128].astype(float)
    assert got.A01_count.sum() == pytest.approx(len(v)) and got.A01_sum.sum() == pytest.approx(v.sum())


def test_boxes_partition_pixels(spark, codes):
    path = codes[0]
    whole = raster.read_raster(spark, path, R, ["sum", "npix"], bands="A01").toPandas()
    parts = [raster.read_raster(spark, path, R, ["sum", "npix"], bands="A01", bbox=b).toPandas() for b in ((-180, -90, 12.04, 90), (12.04, -90, 180, 90))]
    assert sum(p.npix.sum() for p in parts) == whole.npix.sum() and sum(p.A01.sum() for p in parts) == whole.A01.sum()
    blocks = [raster.read_raster(spark, path, R, ["sum", "npix"], bands="A01", bbox=b, bbox_align="block").toPandas() for b in ((-180, -90, 12.04, 90), (12.04, -90, 180, 90))]
    assert sum(p.npix.sum() for p in blocks) == whole.npix.sum()


def test_mask_and_covering(spark, codes):
    path, a, lon, lat = codes
    ring = [(12.01, 48.01), (12.09, 48.02), (12.05, 48.09)]
    got = raster.read_raster(spark, path, R, ["npix", "mean"], mask=f"POLYGON(({', '.join(f'{x} {y}' for x, y in [*ring, ring[0]])}))").toPandas()
    inside = np.zeros(lon.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        inside ^= ((y1 > lat) != (y2 > lat)) & (lon < (lat - y1) * (x2 - x1) / (y2 - y1) + x1)
    assert got.npix.sum() == (inside & (a[:, :, 0] != -128)).sum()
    cells = cell_of(lon, lat, R)
    some = int(np.unique(cells)[0])
    cover = spark.createDataFrame([(R, some)], "res int, cell long")
    kept = raster.read_raster(spark, path, R + 3, "npix", aoi=cover).toPandas()
    assert kept.npix.sum() == ((cells == some) & (a[:, :, 0] != -128)).sum()


def test_area_of_interest(spark, codes):
    """Areas keep whole cells, by their centre or where they overlap; an area without cells, or containment without an area, is an error."""
    path, a, lon, lat = codes
    ring = [(12.01, 48.01), (12.09, 48.02), (12.05, 48.09), (12.01, 48.01)]
    text = f"POLYGON(({', '.join(f'{x} {y}' for x, y in ring)}))"
    cells, n = cell_of(lon, lat, R + 3), 2.0 ** (R + 3)
    real = a[:, :, 0] != -128
    x, y = (cells & (1 << 29) - 1) + 0.5, (cells >> 29 & (1 << 29) - 1) + 0.5
    centre_lon, centre_lat = x / n * 360 - 180, np.degrees(np.arcsin(y / n * 2 - 1))
    inside = np.zeros(lon.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        inside ^= ((y1 > centre_lat) != (y2 > centre_lat)) & (centre_lon < (centre_lat - y1) * (x2 - x1) / (y2 - y1) + x1)
    got = raster.read_raster(spark, path, R + 3, "npix", aoi=text).toPandas()
    assert set(got.cell) == set(cells[inside & real].tolist()) and got.npix.sum() == (inside & real).sum()
    more = raster.read_raster(spark, path, R + 3, "npix", aoi=text, containment="overlapping").toPandas()
    assert set(got.cell) < set(more.cell)
    with pytest.raises(GeometryError):
        raster.read_raster(spark, path, 3, "npix", aoi="POLYGON((0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))")
    with pytest.raises(ArgumentError):
        raster.read_raster(spark, path, R, "npix", containment="overlapping")


def test_centroid_kernels_on_a_plane(spark, tmp_path):
    r, c = np.mgrid[0:64, 0:64]
    path = str(tmp_path / "plane.tif")
    tiff.write_raster(path, (2.0 * c + 3.0 * r).astype(np.float32), (10, 0.01, 0, 50, 0, -0.01), tile=32)
    for interp in ("bilinear", "bicubic"):
        got = raster.read_raster(spark, path, 14, mode="centroid", interp=interp, bbox=(10.1, 49.5, 10.5, 49.9))
        got = got.select("band_01", grid.cell_lon(F.col("cell")).alias("lon"), grid.cell_lat(F.col("cell")).alias("lat")).toPandas()
        want = 2 * ((got.lon - 10) / 0.01 - 0.5) + 3 * ((50 - got.lat) / 0.01 - 0.5)
        assert len(got) > 20 and np.allclose(got.band_01, want, atol=1e-3)


def test_overview_choice_and_info(spark, codes):
    path = codes[0]
    x = raster.px.open_source(path)
    assert [raster.choose_level(x, r, True) for r in (8, 16, 20)] == [2, 1, 0] or raster.choose_level(x, 8, True) == 2
    assert raster.choose_level(x, 8, False) == 0
    row = raster.raster_info(spark, path).first()
    assert (row["width"], row["n_bands"], row["dtype"], row["nodata"], row["crs"]) == (128, 2, "int8", -128.0, "EPSG:4326") and row["band_names"] == ["A01", "A02"]


def test_several_sources(spark, codes, tmp_path):
    path, a, _, _ = codes
    twice = raster.read_raster(spark, {"a": path, "b": path}, R, "npix").toPandas()
    once = raster.read_raster(spark, path, R, "npix").toPandas()
    assert (twice.npix == 2 * once.npix).all()
    side = raster.read_raster(spark, {"a": path, "b": path}, R, "mean", separate=True)
    assert side.columns == ["cell", "a_A01", "a_A02", "b_A01", "b_A02"]
    assert side.where("a_A01 <> b_A01").count() == 0
    both = raster.read_raster(spark, {"a": path, "b": path}, R, "mean", composite_by="count").toPandas()
    assert (both.A01 == 2).all()


def test_parquet_and_arrow(spark, codes, tmp_path):
    dest = str(tmp_path / "out")
    raster.raster_to_parquet(spark, codes[0], dest, R, as_vector=True, value_type="float")
    back = spark.read.parquet(dest)
    assert dict(back.dtypes)["value"] == "array<float>"
    about = sink.read_metadata(back)
    assert about["layout"] == "vector" and about["stat"] == "mean" and about["overviews"] == "allowed"
    assert sink.to_arrow(back).num_rows == back.count()
    with pytest.raises(ArgumentError):
        sink.write_parquet(raster.read_raster(spark, codes[0], R, "fractions"), str(tmp_path / "no"))


def test_arguments(spark, codes):
    path = codes[0]
    for bad in ({"stat": "mode"}, {"stat": ["mean", "mean"]}, {"bands": [3]}, {"bands": "zz"}, {"mode": "x"}, {"subsamples": 4}, {"interp": "bicubic"}, {"scoff": True, "dequant": abs}, {"separate": True, "composite_by": "mean"}):
        with pytest.raises(ArgumentError):
            raster.read_raster(spark, path, R, **bad)
    with pytest.raises(ResolutionError):
        raster.read_raster(spark, path, 30)
    with pytest.raises(GeometryError):
        raster.read_raster(spark, path, R, bbox=(0, 10, 0, 20))
    with pytest.raises(SourceError):
        raster.read_raster(spark, "/nowhere.tif", R)
    with pytest.raises(ArgumentError):
        raster.read_raster(spark, path, R, store_opts={"region": "x"})


@pytest.mark.parametrize("code", [3857, 32633, 32733, 3035, 5070])
def test_projections_invert(code):
    p = projection.from_epsg(code)
    lon0 = {3857: 10, 32633: 15, 32733: 15, 3035: 10, 5070: -96}[code]
    lon, lat = np.meshgrid(np.linspace(lon0 - 2.5, lon0 + 2.5, 9), np.linspace(-50, -10, 9) if code == 32733 else np.linspace(25, 60, 9))
    x, y = p.from_lonlat(lon.ravel(), lat.ravel())
    back = p.to_lonlat(x, y)
    assert np.allclose(back[0], lon.ravel(), atol=1e-8) and np.allclose(back[1], lat.ravel(), atol=1e-6)


def test_known_points():
    x, y = projection.from_epsg(32633).from_lonlat(np.array([15.0]), np.array([0.0]))
    assert (x[0], y[0]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    x, y = projection.from_epsg(3035).from_lonlat(np.array([5.0]), np.array([50.0]))
    assert (x[0], y[0]) == (pytest.approx(3962799.45, abs=0.5), pytest.approx(2999718.85, abs=0.5))


def test_store():
    assert store.resolve("/vsis3/b/k.tif") == "s3://b/k.tif" and store.resolve("/vsicurl/https://x/y.tif") == "https://x/y.tif"
    with pytest.raises(SourceError):
        store.resolve("/vsizip/x")
    shown = store.store_config("s3://b/k", {"secret_access_key": "s", "region": "eu-1"})
    assert shown["region"] == "eu-1" and shown["secret_access_key"] == "<set>"
    assert store.coalesce([(0, 10), (20, 5), (5_000_000, 1)]) == [(0, 25), (5_000_000, 1)]


def test_plan_has_no_python_after_the_scan(spark, codes):
    plan = raster.read_raster(spark, codes[0], R)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_avg" in plan


def test_streaming_sums(spark, tmp_path):
    from gridloom.streaming.incremental import running_cells

    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(float(i), 10.0, float(i + k)) for i in range(5)], "lon double, lat double, v double").coalesce(1).write.mode("append").parquet(src)
    stream = running_cells(spark.readStream.schema("lon double, lat double, v double").option("maxFilesPerTrigger", 1).parquet(src), ["v"], 3)
    q = stream.writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("sums").agg(F.sum("v_sum"), F.sum("v_count")).first()
    assert tuple(got) == (sum(i + k for k in range(3) for i in range(5)), 15)


def test_weighted_variance_keeps_its_digits(spark):
    """Values of 10^9 that differ by 1: unshifted squares would lose every digit."""
    from gridloom.operators import composite, stats

    rows = [(c, 1e9 + v + 1e6 * c, w, f"s{v}") for c in range(3) for v, w in enumerate((1.0, 2.0, 1.0, 1.0))]
    px = spark.createDataFrame(rows, "cell long, b double, w double, src string")
    v, w = np.arange(4.0), np.array([1.0, 2, 1, 1])
    spread = (w * (v - (w * v).sum() / w.sum()) ** 2).sum()
    for r in stats.summarise(px, ["b"], ["var", "sd"], weight="w").collect():
        assert r["b_var"] == pytest.approx(spread / (w.sum() - 1), rel=1e-3) and r["b_sd"] == pytest.approx(r["b_var"] ** 0.5)
    for r in composite.reduce_sources(px.select("cell", F.col("b").alias("v"), "w"), "var").collect():
        assert r["value"] == pytest.approx(spread / (w.sum() - (w * w).sum() / w.sum()))


def test_separate_goes_by_names(spark, tmp_path):
    a = np.arange(32 * 32, dtype=np.float32).reshape(32, 32)
    t = (0, 0.01, 0, 10, 0, -0.01)
    tiff.write_raster(str(tmp_path / "a.tif"), np.stack([a, a + 5000], 2), t, tile=32, names=["x", "y"], scale=[2.0, 1.0], offset=[0.0, 0.0])
    tiff.write_raster(str(tmp_path / "b.tif"), np.stack([a + 5000, a], 2), t, tile=32, names=["y", "x"], scale=[1.0, 3.0], offset=[0.0, 7.0])
    tiff.write_raster(str(tmp_path / "c.tif"), a + 9000, t, tile=32)
    src = {k: str(tmp_path / f"{k}.tif") for k in "abc"}
    got = raster.read_raster(spark, src, 8, separate=True)
    assert got.columns == ["cell", "a_x", "a_y", "b_y", "b_x", "c"]
    for r in got.collect():
        assert r["a_x"] == r["b_x"] == pytest.approx(r["a_y"] - 5000) == pytest.approx(r["c"] - 9000) and r["a_y"] == r["b_y"]
    some = raster.read_raster(spark, src, 8, separate=True, bands=["c", "b_x"], scoff=True)
    plain = {r["cell"]: r["a_x"] for r in got.collect()}
    assert some.columns == ["cell", "c", "b_x"] and all(r["b_x"] == pytest.approx(3 * plain[r["cell"]] + 7) for r in some.collect())
    assert raster.read_raster(spark, src, 8, separate=True, bands=[5, 1]).columns == ["cell", "c", "a_x"]
    with pytest.raises(ArgumentError):
        raster.read_raster(spark, src, 8, separate=True, bands="z")


def test_masks_are_unions(spark):
    two = "MULTIPOLYGON Z (((0 0 1, 4 0 1, 4 4 1, 0 4 1, 0 0 1), (1 1 1, 2 1 1, 2 2 1, 1 2 1, 1 1 1)), ((3 3 1, 6 3 1, 6 6 1, 3 6 1, 3 3 1)))"
    from gridloom.operators.regions import in_polygons

    points = spark.createDataFrame([(3.5, 3.5, True), (0.5, 0.5, True), (1.5, 1.5, False), (5.0, 5.0, True), (7.0, 1.0, False)], "x double, y double, want boolean")
    parts = raster.polygons_of(two)
    assert len(parts) == 2 and len(parts[0]) == 2
    assert points.where(in_polygons(F.col("x"), F.col("y"), parts) != F.col("want")).count() == 0
    assert raster.polygons_of({"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}) == [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]]
    for bad in ("POLYGON EMPTY", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 1))", {"type": "Point", "coordinates": [0, 0]}):
        with pytest.raises((GeometryError, ArgumentError)):
            raster.polygons_of(bad)


def test_pooled_sources_share_a_level(spark, tmp_path):
    a = np.random.default_rng(1).random((128, 128)).astype(np.float32)
    t = (0, 0.001, 0, 10, 0, -0.001)
    for name, overviews in (("a", [2, 4]), ("b", [2]), ("c", [])):
        tiff.write_raster(str(tmp_path / f"{name}.tif"), a, t, tile=32, overviews=overviews)
    opened = {n: raster.px.open_source(str(tmp_path / f"{n}.tif")) for n in "abc"}
    assert raster.choose_level(opened["a"], 9, True) == 2
    assert raster.common_levels({n: opened[n] for n in "ab"}, 9, True) == {"a": 1, "b": 1}
    assert raster.common_levels(opened, 9, True) == {"a": 0, "b": 0, "c": 0}


def test_pixel_size_is_measured_on_the_ground(tmp_path):
    for lat in (0, 60):
        path = str(tmp_path / f"{lat}.tif")
        tiff.write_raster(path, np.zeros((4, 8), np.uint8), (0, 0.02, 0, lat + 0.02, 0, -0.01), tile=16)
        assert raster.pixel_metres(raster.px.open_source(path)) == pytest.approx(max(0.02 * np.cos(np.radians(lat)), 0.01) * 111_195, rel=1e-3)


def test_headers_are_read_in_pieces(tmp_path):
    path = str(tmp_path / "wide.tif")
    tiff.write_raster(path, np.random.default_rng(2).random((1024, 1024, 2)), (0, 1e-3, 0, 10, 0, -1e-3), tile=256, compression=tiff.NONE)
    data, asked = open(path, "rb").read(), []

    def get(at, size):
        asked.append(size)
        return data[at : at + size]

    assert tiff.open_raster(path, lambda _: tiff.Pieces(get)).levels[0].tags == tiff.open_raster(path, lambda _: data).levels[0].tags
    assert sum(asked) < len(data) / 8


def test_centroids_read_only_tiles_near_the_box(codes):
    x = raster.px.open_source(codes[0])
    box = [(12.001, 48.05, 12.002, 48.052)]
    assert 0 < len(raster.tiles_in(x, 0, raster.padded(box, x), "pixel")) <= len(raster.tiles_in(x, 0, None, "pixel"))
    assert raster.padded([(-180.0, 10.0, -179.99, 11.0)], x)[1][2] == 180.0
