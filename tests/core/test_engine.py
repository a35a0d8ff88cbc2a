import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from galewise.functions import geometry as g
from galewise.functions import vectors as v
from galewise.functions import wkt
from galewise.operators import graphs, spatial, statistics, temporal
from galewise.plans import report, routing
from galewise.sources import files, shared, tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def line(*points):
    return F.array(*[v.point(x, y) for x, y in points])


def test_densify_boundary(spark):
    assert one(spark, F.size(v.densified(line((0, 0), (20_000, 0)), 20_000))) == 2
    assert one(spark, F.size(v.densified(line((0, 0), (20_001, 0)), 20_000))) == 3


def test_degenerate_paths(spark):
    assert one(spark, v.length(line((1, 1)))) == 0.0
    assert one(spark, v.last_direction(line((1, 1), (1, 1)))) is None
    assert one(spark, v.turn(v.point(0, 0), v.point(0, 0), v.point(1, 0))) == 180.0
    assert one(spark, F.size(v.pieces(line((1, 1)), 10))) == 1
    assert one(spark, v.point_at(line((0, 0), (5, 0)), 10)) is None


def test_polygons_with_holes(spark):
    shape = F.array(line((0, 0), (10, 0), (10, 10), (0, 10)), line((4, 4), (6, 4), (6, 6), (4, 6)))
    assert one(spark, g.strictly_inside(v.point(2, 2), shape))
    assert not one(spark, g.strictly_inside(v.point(5, 5), shape))
    assert not one(spark, g.strictly_inside(v.point(0, 5), shape))
    assert one(spark, g.covered(v.point(4, 5), shape))
    assert not one(spark, g.segment_meets_polygon(v.point(4.5, 4.5), v.point(5.5, 5.5), shape))


def test_text_of_shapes(spark):
    text = "MULTIPOLYGON (((0.0 0.0, 1.0 0.0, 1.0 1.0)), ((5.0 5.0, 6.0 5.0, 6.0 6.0), (5.2 5.1, 5.3 5.1, 5.3 5.2)))"
    assert one(spark, wkt.multipolygon_text(wkt.polygons(F.lit(text)))) == text
    assert one(spark, wkt.polygons(F.lit("POLYGON EMPTY"))) == []
    assert one(spark, wkt.polygons(F.lit(None).cast("string"))) is None


def test_obstacle_files(spark, tmp_path):
    shape = "array<array<array<struct<x:double,y:double>>>>"
    rows = spark.createDataFrame([("2024_01_01_00_00_00", "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0))"), ("2024_01_01_00_05_00", None)], "time_key string, w string")
    rows = rows.select("time_key", wkt.polygons(F.col("w")).alias("geometry"), *[F.lit(None).cast(shape).alias(c) for c in files.SHAPES[1:]])
    for key in ("2024_01_01_00_00_00", "2024_01_01_00_05_00"):
        out = tmp_path / "scene"
        out.mkdir(exist_ok=True)
        text = rows.filter(F.col("time_key") == key).select(wkt.multipolygon_text(F.col("geometry")).alias("geometry")).first()["geometry"]
        (out / f"{key}.csv").write_text('geometry,buffer,convex,concave\n"%s",,,\n' % (text or ""))
    back = files.read_obstacles(spark, str(tmp_path / "scene"))
    assert [r["time_key"] for r in files.time_keys(spark, str(tmp_path / "scene")).collect()] == ["2024_01_01_00_00_00", "2024_01_01_00_05_00"]
    first = back.filter("time_key = '2024_01_01_00_00_00'").first()
    assert first["geometry"][0][0][1]["x"] == 1.0 and first["buffer"] is None


def test_array_files(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "2024-01.npy", np.arange(2 * 3 * 2 * 2).reshape(2, 3, 2, 2, 1))
    np.save(tmp_path / "odd.npy", np.zeros(3))
    rows = files.read_arrays(spark, str(tmp_path)).orderBy("index").collect()
    assert len(rows) == 2 and rows[1]["frames"][0] == [12, 13, 14, 15]


def test_result_sources_that_are_missing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    rows = files.read_results(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")})
    assert rows.count() == 3 and rows.first()["algorithm"] == "a"


def test_preprocessing_bounds(spark):
    rows = spark.createDataFrame([("t1", "A->B", 1, 1000.0), ("t2", "A->B", 2, 999.9), ("bad", "A->B", 1, 5000.0), ("t3", "B->A", 3, float("nan"))], "timestamp string, direction string, window_size int, length double")
    out = statistics.preprocessed(rows, 1_000, 2_000_000, ["bad"]).collect()
    assert [(r["subject_id"], r["window_size"], r["success"]) for r in out] == [("t1_A->B", 0, True)]


def test_wilcoxon_of_zeros(spark):
    rows = spark.createDataFrame([("a", "b", 0.0), ("a", "b", 0.0)], "first string, second string, delta double")
    r = statistics.wilcoxon(rows).first()
    assert (r["n"], r["w"], r["effect"]) == (0, 0.0, 0.0)


def test_holm_and_bh(spark):
    rows = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03), ("f", 0.005)], "fam string, p double")
    holm = {r["p"]: round(r["p_holm"], 6) for r in statistics.holm(rows, ["fam"]).collect()}
    assert holm == {0.005: 0.02, 0.01: 0.03, 0.03: 0.06, 0.04: 0.06}
    bh = {r["p"]: round(r["p_bh"], 6) for r in statistics.benjamini_hochberg(rows, ["fam"]).collect()}
    assert bh == {0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04}


def test_groups_49_and_51_km(spark):
    boxes = [(0, 0.0), (1, 10_000 + 49_000.0), (2, 20_000 + 49_000 + 51_000.0)]
    rows = spark.createDataFrame([(i, x, 0.0, x + 10_000, 10_000.0) for i, x in boxes], "obstacle_id long, xmin double, ymin double, xmax double, ymax double")
    found = graphs.groups(rows.select(F.col("obstacle_id").alias("id")), spatial.close_pairs(rows, 50_000))
    assert sorted((r["id"], r["grp"]) for r in found.collect()) == [(0, 0), (1, 0), (2, 2)]


def test_components_of_a_long_chain(spark):
    n = 300
    rows = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graphs.components(rows)
    assert found.filter("root <> 0").count() == 0 and found.count() == n - 1 + (1 if found.filter("node = 0").count() else 0)


def test_nearest_over_scales(spark):
    rows = [(i, float(10**i), 0.0) for i in range(6)]
    p = spark.createDataFrame(rows, "id long, x double, y double")
    got = spatial.nearest(p.select(F.col("id").alias("qid"), "x", "y"), p, 2, exclude_self=True)
    want = {(i, j) for i, x, _ in rows for _, j in sorted((abs(x - y), k) for k, y, _ in rows if k != i)[:2]}
    assert {(r["qid"], r["id"]) for r in got.collect()} == want


def test_bounded_gap_fill(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,5*cast(id as int)) as slot, if(id in (0, 5), cast(id as double), null) as v from range(8)")
    out = {r["slot"].minute: r["v_filled"] for r in temporal.carried_within(rows, [], "slot", "v", 2).collect()}
    assert out == {0: 0.0, 5: 0.0, 10: 0.0, 15: None, 20: None, 25: 5.0, 30: 5.0, 35: 5.0}


def test_flights_report_errors_as_rows(spark):
    scenes = routing.packed(spark.createDataFrame([("s", 0, 1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "scene string, t_idx int, obstacle_id long, ring array<struct<x:double,y:double>>"), 3)
    runs = routing.experiments(spark.createDataFrame([("s", -50_000.0, 0.0, 100_000.0, 0.0)], "scene string, ax double, ay double, bx double, by double"), (1, 9), ("master",))
    out = {r["run_id"]: r for r in routing.fly(runs, scenes, masking="wide", mode="unheard").collect()}
    assert len(out) == 4 and all("unheard" in r["error"] for r in out.values())
    ok = {r["run_id"]: r for r in routing.fly(runs, scenes).collect()}
    assert ok["s|A->B|1|master"]["success"] and ok["s|A->B|1|master"]["length"] >= 150_000
    assert not ok["s|A->B|9|master"]["success"]


def test_report_text(spark):
    text = report.markdown(report.stat_results(tables.runs(spark, "/root/testdata/sf0.001")))
    assert text.startswith("# Comparison") and "## Phase 6" in text and "friedman" in text


def test_live_hours_and_flights(spark, tmp_path):
    from galewise.streaming import flights

    src = tmp_path / "in"
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,5*cast(id as int)) as ts, cast(id as double) as value from range(40)").write.parquet(str(src))
    q = flights.hourly(spark.readStream.schema("ts timestamp, value double").parquet(str(src))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["hour"].hour, r["n"]) for r in spark.table("hours").collect()) == [(0, 12), (1, 12), (2, 12), (3, 4)]

    frames = tmp_path / "frames"
    schema = "run_id string, t_idx int, sx double, sy double, ex double, ey double, rings array<array<array<double>>>"
    ring = [[[40_000.0, -5_000.0], [60_000.0, -5_000.0], [60_000.0, 5_000.0], [40_000.0, 5_000.0]]]
    spark.createDataFrame([("r", t, 0.0, 0.0, 100_000.0, 0.0, ring) for t in range(4)], schema).write.parquet(str(frames))
    q = flights.fly(spark.readStream.schema(schema).parquet(str(frames))).writeStream.format("memory").queryName("flown").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("flown").orderBy("t").collect()
    assert rows and rows[-1]["done"] and rows[-1]["x"] == pytest.approx(100_000) and all(r["success"] for r in rows)


def test_the_engine_works_without_the_corpus_operators(tmp_path):
    """In a copy without their folder and the pipeline; with the folder, an error of its own is not hidden."""
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "galewise", tmp_path / "galewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); assert 'window_deltas' in q and not any(k.startswith('op1_') for k in q)"
    (tmp_path / "galewise/llm/__pycache__").mkdir(parents=True)  # what is left of a removed package
    assert subprocess.run([sys.executable, "-c", ask], cwd=tmp_path).returncode == 0
    (tmp_path / "galewise/llm/__init__.py").touch()
    (tmp_path / "galewise/llm/queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, stderr=subprocess.DEVNULL).returncode == 1


def test_shared_tables_need_a_shared_folder():
    """On a cluster without spark.checkpoint.dir nothing is written to a disk of one machine."""
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
