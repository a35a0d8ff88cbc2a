"""Sinks read back and rerun, rasters, outlines, the report and counted ranks."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewise.functions import wkt
from galewise.operators import overlay, ranks, statistics
from galewise.operators import rasters as rs
from galewise.plans import obstacles as plan
from galewise.plans import report
from galewise.sources import files, geotiff, rasters, tables

SF = "/root/testdata/sf0.001"
SQUARE = "POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 0.0))"


def obstacles(spark, *rows):
    df = spark.createDataFrame(rows, "time_key string, " + ", ".join(f"{c} string" for c in files.SHAPES))
    return df.select("time_key", *[wkt.polygons(F.col(c)).alias(c) for c in files.SHAPES])


def test_obstacles_read_back_and_rerun(spark, tmp_path):
    folder = str(tmp_path / "scene")
    files.write_obstacles(obstacles(spark, ("2024_01_01_00_00_00", SQUARE, SQUARE, None, None), ("2024_01_01_00_05_00", SQUARE, None, None, SQUARE)), folder)
    files.write_obstacles(obstacles(spark, ("2024_01_01_00_05_00", SQUARE, SQUARE, SQUARE, SQUARE)), folder)  # a rerun of one key
    back = files.read_obstacles(spark, folder).orderBy("time_key").collect()
    assert [r["time_key"] for r in back] == ["2024_01_01_00_00_00", "2024_01_01_00_05_00"]
    assert back[0]["convex"] is None and back[1]["convex"] is not None and len(back[0]["geometry"][0][0]) == 4
    assert [r["time_key"] for r in files.time_keys(spark, folder).collect()] == ["2024_01_01_00_00_00", "2024_01_01_00_05_00"]
    assert files.read_obstacles(spark, folder, ["2024_01_01_00_05_00"]).count() == 1


def test_files_named_by_time_key(spark, tmp_path):
    for key in ("2024_01_01_00_00_00", "2024_01_01_00_05_00"):
        (tmp_path / f"{key}.csv").write_text(",".join(files.SHAPES) + f'\n"{SQUARE}",,,\n')
    assert [r["time_key"] for r in files.read_obstacles(spark, str(tmp_path)).orderBy("time_key").collect()] == ["2024_01_01_00_00_00", "2024_01_01_00_05_00"]


def test_months_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2024, m, 3), m) for m in (1, 2, 2)], "hour timestamp_ntz, v int")
    for _ in range(2):
        files.write_months(rows, str(tmp_path / "m"))
    files.write_months(rows.filter("v = 1"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_results_and_static_results(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "timestamp string, length double")
    files.append_results(rows, str(tmp_path / "r"))
    files.append_results(rows.filter("timestamp = 'b'").withColumn("length", F.lit(5.0)), str(tmp_path / "r"))
    assert sorted((r["timestamp"], r["length"]) for r in files.read_results(spark, {"x": str(tmp_path / "r"), "y": str(tmp_path / "none")}).collect()) == [("a", 1.0), ("b", 5.0)]
    static = spark.createDataFrame([("2024", "convex", [(0.0, 0.0), (3.0, 4.0)], 5.0)], "timestamp string, strategy string, paths array<struct<x:double,y:double>>, length double")
    for _ in range(2):
        files.write_static_results(static, str(tmp_path / "s"))
    back = files.read_static_results(spark, str(tmp_path / "s")).collect()
    assert len(back) == 1 and [(p["x"], p["y"]) for p in back[0]["paths"]] == [(0, 0), (3, 4)] and back[0]["length"] == 5


def test_progress(spark, tmp_path):
    path, first = str(tmp_path / "p"), datetime.datetime(2020, 12, 31, 23, 55)
    assert files.load_progress(spark, path, first).first()["done"] == first
    for day in ("2021-02-03 10:00:00", "2021-02-01 00:00:00"):
        files.save_progress(spark.createDataFrame([(day,)], "day string"), path)
    assert files.load_progress(spark, path, first).first()["done"] == datetime.datetime(2021, 2, 3, 23, 55)


def tiff(band, order="<", deflate=False, tile=None):
    """A GeoTIFF of one band, as the format's description has it."""
    rows, cols = band.shape
    blocks = [band[y : y + 3].tobytes() for y in range(0, rows, 3)]
    if tile:
        padded = np.pad(band, ((0, -rows % tile), (0, -cols % tile)))
        blocks = [padded[y : y + tile, x : x + tile].tobytes() for y in range(0, rows, tile) for x in range(0, cols, tile)]
    blocks = [zlib.compress(b) if deflate else b for b in blocks]
    kind = {"u": 1, "i": 2, "f": 3}[band.dtype.kind]
    where = [(322, "H", [tile]), (323, "H", [tile]), (324, "I", None), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", None), (278, "H", [3]), (279, "I", [len(b) for b in blocks])]
    entries = sorted([(256, "H", [cols]), (257, "H", [rows]), (258, "H", [band.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1]), (339, "H", [kind]), (33550, "d", [250.0, 250.0, 0.0]), (33922, "d", [0, 0, 0, 1000.0, 2000.0, 0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 3067]), *where])
    at = 8 + 2 + 12 * len(entries) + 4
    starts, extra, head = [], b"", b""
    data_at = at + 1000
    for b in blocks:
        starts.append(data_at)
        data_at += len(b)
    for tag, form, values in entries:
        values = starts if values is None else values
        packed = struct.pack(f"{order}{len(values)}{form}", *values)
        head += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values))
        if len(packed) <= 4:
            head += packed.ljust(4, b"\0")
        else:
            head += struct.pack(order + "I", at + len(extra))
            extra += packed
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries)) + head + b"\0" * 4 + extra.ljust(1000, b"\0") + b"".join(blocks)


def decoded(raw):
    h = geotiff.header(lambda at, n: raw[at : at + n])
    band = np.zeros((h.rows, h.cols))
    for k, (start, size) in enumerate(h.blocks):
        y, x, high, wide = h.place(k)
        part = geotiff.block(h, k, raw[start : start + size])
        band[y : y + len(part), x : x + wide] = part
    return h, band


@pytest.mark.parametrize(("order", "kind", "deflate", "tile"), [("<", "u1", False, None), (">", "u2", True, None), ("<", "f4", True, 16), (">", "i2", False, 16)])
def test_rasters(order, kind, deflate, tile):
    band = np.arange(70).reshape(7, 10).astype(np.dtype(order + kind))
    h, got = decoded(tiff(band, order, deflate, tile))
    assert (h.rows, h.cols, h.crs) == (7, 10, 3067) and got.ravel().tolist() == list(range(70))
    assert h.transform == {"a": 250.0, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -250.0, "f": 2000.0}


def test_lzw_of_the_formats_description():
    """The codes that the description of the format gives for its example, and long runs in which widths grow and tables are begun anew."""
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert geotiff.packed_lzw(raw) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 253, 254, 255, 256, 257, 509, 510, 511, 512, 1021, 1023, 4000, 4096, 70_000):
        for own in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(0, 2, n, dtype=np.uint8).tobytes(), bytes(n)):
            assert geotiff.unpacked_lzw(geotiff.packed_lzw(own)) == own
    with pytest.raises(ValueError):
        geotiff.unpacked_lzw(bytes([0x80, 0x7F, 0xFF, 0xFF]))


@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("shape", [(1, 1), (16, 16), (300, 257)])
def test_written_rasters(kind, shape):
    rng = np.random.default_rng(4)
    band = (rng.normal(size=shape) if kind[0] == "f" else rng.integers(np.iinfo(kind).min, np.iinfo(kind).max, shape)).astype(kind)
    ground = {"a": 250.0, "b": 0.0, "c": -1e6, "d": 0.0, "e": -200.0, "f": 7e6}
    h, got = decoded(geotiff.encoded(band, ground, 3067, 256))
    assert (got == band).all() and h.transform == ground and h.crs == 3067 and (h.packing, h.high, h.wide, h.predictor) == (5, 256, 256, 1 if kind[0] == "f" else 2)
    with pytest.raises(ValueError):
        geotiff.encoded(band, ground | {"b": 1.0})


def test_tiles_are_read_as_needed(spark, tmp_path):
    rng = np.random.default_rng(6)
    band = rng.integers(0, 255, (70, 50)).astype(np.uint8)
    ground = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0, "f": 0.0}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tif").write_bytes(geotiff.encoded(band, ground, tile=16))
    (tmp_path / "b.tif").write_bytes(b"no raster")
    raw = bytearray(geotiff.encoded(band, ground, tile=16))
    raw[-30:] = b"\xff" * 30  # the last block is broken
    (tmp_path / "c.TIF").write_bytes(raw)
    for split in (1 << 20, 1_000):
        tiles = rasters.read_tiles(spark, str(tmp_path), split=split)
        rows = {(r["path"].rsplit("/", 1)[-1], r["block"]): r for r in tiles.collect()}
        assert len([k for k in rows if k[0] == "a.tif"]) == 20 and "TIFF" in rows["b.tif", None]["error"]
        assert [k for k, r in rows.items() if r["error"]] == [("b.tif", None), ("c.TIF", 19)] and rows["c.TIF", 19]["band"] is None
        got = {(r["row"], r["col"]): r["value"] for r in rasters.pixels_of(tiles.filter("path like '%a.tif'")).collect()}
        assert got == {(y, x): band[y, x] for y in range(70) for x in range(50)}
    part = rasters.read_tiles(spark, str(tmp_path / "deep"), window=(20, 33, 47, 50))
    assert sorted((r["row"], r["col"]) for r in part.collect()) == [(16, 32), (16, 48), (32, 32), (32, 48)]
    assert rasters.read_tiles(spark, str(tmp_path), pixels=False).filter("band is not null").count() == 0
    (tmp_path / "none").mkdir()
    assert rasters.read_tiles(spark, str(tmp_path / "none")).count() == 0


def test_copies_are_compressed(spark, tmp_path):
    band = np.repeat(np.arange(64, dtype=">i2"), 64).reshape(64, 64)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.tif").write_bytes(tiff(band, ">", False, None))
    (tmp_path / "in" / "y.tif").write_bytes(b"broken")
    report = {r["path"].rsplit("/", 1)[-1]: r for r in rasters.recompressed(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert report["x.tif"]["error"] is None and report["x.tif"]["bytes"] < report["x.tif"]["before"] and "TIFF" in report["y.tif"]["error"]
    h, got = decoded((tmp_path / "out" / "x.tif").read_bytes())
    assert (got == band).all() and h.packing == 5 and h.kind == np.dtype("<i2") and h.crs == 3067
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["x.tif"]


def test_from_files_to_groups_of_obstacles(spark, tmp_path):
    """Two storms that meet when grown are one obstacle of two parts, one far away its own; a hole stays."""
    band = np.zeros((40, 60), dtype=np.uint8)
    band[2:8, 2:8] = 150
    band[4:6, 4:6] = 255  # no data: a hole
    band[2:5, 12:15] = 101
    band[30:33, 50:53] = 254
    band[20, 20] = 100
    ground = spark.createDataFrame([("m", 40, 60, band.ravel().astype(float).tolist(), (1_000.0, 0.0, 5_000.0, 0.0, -1_000.0, 9_000.0), 3067), ("bad", 1, 2, [1.0], (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), None)], "name string, rows int, cols int, band array<double>, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, crs int")
    report = {r["name"]: r for r in rasters.write_rasters(ground, str(tmp_path / "r"), "uint8", tile=16).collect()}
    assert report["m"]["error"] is None and "reshape" in report["bad"]["error"]
    tiles = rasters.read_tiles(spark, str(tmp_path / "r"))
    got = overlay.measures(plan.obstacles(tiles, reach=2_500.0, cell=10_000.0), ["grp"]).collect()
    assert sorted((r["area"], r["n_parts"], r["n_holes"]) for r in got) == [(9e6, 1, 0), (41e6, 2, 1)]
    assert sorted(r["area"] for r in overlay.measures(plan.obstacles(tiles, reach=1_000.0, cell=10_000.0), ["grp"]).collect()) == [9e6, 9e6, 32e6]


def test_resampling_at_its_edges(spark):
    """A crop that is its raster gives it back; half a pixel aside it is the mean of two; off the raster it is 0."""
    pixels = spark.createDataFrame([("p", r, c, float(10 * r + c)) for r in range(3) for c in range(4)], "path string, row int, col int, value double")
    kind = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    known = spark.createDataFrame([("p", 3, 4, (2.0, 0.0, 0.0, 0.0, -2.0, 0.0))], f"path string, rows int, cols int, transform {kind}")
    asked = spark.createDataFrame([(1, "p", (2.0, 0.0, 0.0, 0.0, -2.0, 0.0), 3, 4), (2, "p", (2.0, 0.0, 1.0, 0.0, -2.0, 0.0), 3, 4), (3, "p", (2.0, 0.0, 900.0, 0.0, -2.0, 0.0), 1, 1)], f"crop_id int, path string, transform {kind}, rows int, cols int")
    got = {(r["crop_id"], r["row"], r["col"]): r["value"] for r in rs.resampled(pixels, known, asked).collect()}
    assert all(got[1, r, c] == 10 * r + c for r in range(3) for c in range(4)) and got[3, 0, 0] == 0
    assert got[2, 1, 0] == 10.5 and got[2, 1, 3] == 13  # its right neighbour is off the raster


def test_rasters_to_obstacles_and_bad_files(spark, tmp_path):
    mask = np.zeros((8, 8), dtype=np.uint8)
    mask[1:6, 1:6] = 200
    mask[2:4, 2:4] = mask[4, 4] = 0  # two holes that touch at a corner are one
    mask[6, 6] = 200  # touches at a corner only: a region of its own
    (tmp_path / "a.tif").write_bytes(tiff(mask))
    (tmp_path / "b.tif").write_bytes(b"no raster")
    read = rasters.read_tiles(spark, str(tmp_path))
    rows = {r["path"][-5:]: r for r in rasters.read_rasters(spark, str(tmp_path)).withColumn("res", rasters.resolution(F.col("transform"))).collect()}
    assert rows["b.tif"]["rows"] is None and "TIFF" in rows["b.tif"]["error"] and rows["a.tif"]["error"] is None and rows["a.tif"]["res"] == 250
    pixels = rasters.pixels_of(read).withColumn("frame_id", F.lit(0).cast("long"))
    shapes = rs.outlines(rs.regions(pixels, (F.col("value") > 100) & (F.col("value") < 255), 8)).collect()
    assert sorted((r["n_pixels"], len(r["rings"])) for r in shapes) == [(1, 1), (20, 2)]
    big = max(shapes, key=lambda r: r["n_pixels"])["rings"]
    assert [(p["x"], p["y"]) for p in big[0]] == [(1, 1), (1, 6), (6, 6), (6, 1)] and len(big[1]) == 8
    world = spark.createDataFrame([(big,)], "rings array<array<struct<x:double,y:double>>>").select(rs.to_world(F.col("rings"), F.struct(*[F.lit(x).alias(k) for k, x in zip("abcdef", (250.0, 0.0, 1000.0, 0.0, -250.0, 2000.0))])).alias("w")).first()["w"]
    assert (world[0][0]["x"], world[0][0]["y"]) == (1250.0, 1750.0)


def test_ranks_of_one_family_over_many_ranges(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 4_000)
    rows = spark.createDataFrame([("one", int(x)) for x in values] + [("two", 5)], "f string, v long").repartition(7)
    got = {r["v"]: r["rank"] for r in ranks.ranked_values(rows, ["f"], "v").filter("f = 'one'").collect()}
    order = np.sort(values)
    for v in (int(order[0]), 5, 150, int(order[-1])):
        places = np.flatnonzero(order == v) + 1
        assert got[v] == pytest.approx(places.mean())
    q = {r["f"]: r for r in ranks.quantiles(rows, ["f"], "v", {"a": 0.25, "b": 0.5, "c": 0.999}).collect()}
    assert [q["one"][c] for c in "abc"] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.999])) and q["two"]["b"] == 5


def test_report(spark):
    runs = tables.runs(spark, SF)
    rows = [r.asDict() for r in report.stat_results(runs).collect()]
    kinds = {r["test"] for r in rows}
    assert {"shapiro_wilk", "zero_inflation", "mcnemar", "friedman", "conover", "jonckheere", "spearman", "degradation", "levene"} <= kinds and len(kinds & {"wilcoxon", "paired_t"}) == 1
    for r in rows:
        assert r["p_value"] is None or 0 <= r["p_value"] <= r["p_corrected"] + 1e-12 <= 1 + 1e-9 and r["is_significant"] == (r["p_corrected"] < 0.05)
    bad = any(r["test"] == "shapiro_wilk" and not r["p_value"] > 0.05 for r in rows) or any(r["test"] == "zero_inflation" and r["statistic"] > 0.05 for r in rows)
    assert ("wilcoxon" in kinds) == bad


def test_bootstrap_medians_are_those_of_resamples(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2, 10, 81), 3)
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x[:40])], "algorithm string, subject_id long, length double")
    got = {r["algorithm"]: r for r in statistics.bootstrap_medians(rows, ["algorithm"], 2_000).collect()}
    for name, own in (("a", x), ("b", x[:40])):
        medians = np.median(rng.choice(own, (4_000, len(own))), axis=1)
        assert got[name]["median"] == pytest.approx(medians.mean(), rel=0.03)
        assert [got[name]["low"], got[name]["high"]] == pytest.approx(np.quantile(medians, [0.025, 0.975]), rel=0.08)
