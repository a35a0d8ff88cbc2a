"""Flights, static routes, and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import vectors as v
from galewise.functions import wkt
from galewise.kernels import routes
from galewise.plans import report, routing
from galewise.queries.registry import registry, rounded
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
N_KEYS = 8


def _scenes(spark, sf_dir):
    """Scenes of fifty points; the storms among them are 30 km wide and drift east by 10 km a key."""
    p = tb.points(spark, sf_dir).withColumn("scene", F.floor(F.col("id") / 50).cast("string")).filter(F.col("label") == tb.STORM)
    rows = p.select("scene", F.col("id").alias("obstacle_id"), "x", "y", F.explode(F.sequence(F.lit(0), F.lit(N_KEYS - 1))).alias("t_idx")).withColumn("x", F.col("x") + 10_000 * F.col("t_idx"))
    corner = lambda dx, dy: v.point(F.col("x") + dx, F.col("y") + dy)
    ring = F.array(corner(-15_000, -15_000), corner(15_000, -15_000), corner(15_000, 15_000), corner(-15_000, 15_000))
    return routing.packed(rows.select("scene", "t_idx", "obstacle_id", ring.alias("ring")), N_KEYS)


def _scenarios(spark, sf_dir):
    bounds = tb.points(spark, sf_dir).groupBy(F.floor(F.col("id") / 50).cast("string").alias("scene")).agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by"))
    return bounds.select("scene", (F.col("ax") - 50_000).alias("ax"), F.col("ay"), (F.col("bx") + 50_000).alias("bx"), "by")


def _flown(spark, sf_dir, **kw):
    runs = routing.experiments(_scenarios(spark, sf_dir), (1, 3), kw.pop("configs", ("master",)))
    out = routing.fly(runs, _scenes(spark, sf_dir), **kw)
    return out.select("run_id", "success", "success_intermediate", "is_pred_path_valid", "num_segments", F.round("length", 3).alias("length"), "error")


@query()
def fly_dynamic(spark, sf_dir):
    return _flown(spark, sf_dir)


@query()
def fly_tuned(spark, sf_dir):
    return _flown(spark, sf_dir, configs=("greedy", "smooth"))


@query()
def fly_corrected(spark, sf_dir):
    """Ends of steps are led out of obstacles that the next key brings."""
    return _flown(spark, sf_dir, configs=("corrected",))


@query()
def fly_masked(spark, sf_dir):
    return _flown(spark, sf_dir, masking="wide")


@query()
def fly_masked_predictive(spark, sf_dir):
    return _flown(spark, sf_dir, masking="wide", mode="predictive")


@query()
def static_routes(spark, sf_dir):
    pairs = _scenarios(spark, sf_dir).withColumn("name", F.lit("diagonal"))
    return routing.static_routes(pairs, _scenes(spark, sf_dir), routes.Rules()).select("scene", "name", F.size("path").alias("n"), F.round("length", 3).alias("length"))


@query(f"with {tb.POINTS}, s as (select (id // 50)::varchar as scene, id from points), m as (select * from range(1, 8) t(w)), d as (select * from (values ('A->B'), ('B->A')) t(direction)) select distinct scene || '|' || direction || '|' || w || '|master' as run_id, scene, direction, w as window_size from s, m, d")
def experiment_grid(spark, sf_dir):
    return routing.experiments(_scenarios(spark, sf_dir), tuple(range(1, 8)), ("master",)).select("run_id", "scene", "direction", "window_size")


@query(f"with {tb.POINTS}, {tb.paths_sql()} select path_id, 'LINESTRING (' || string_agg(x::bigint || '.0 ' || y::bigint || '.0', ', ' order by i) || ')' as wkt, count(*) as n_back, sum(x) as sum_x from path_points group by 1")
def wkt_round_trip(spark, sf_dir):
    p = F.transform("path", lambda q: F.struct(q["x"].cast("decimal(18,1)").alias("x"), q["y"].cast("decimal(18,1)").alias("y")))
    rows = tb.paths(spark, sf_dir).select("path_id", wkt.line_text(p).alias("wkt"))
    back = rows.withColumn("back", wkt.line(F.col("wkt")))
    return back.select("path_id", "wkt", F.size("back").cast("long").alias("n_back"), F.aggregate("back", F.lit(0.0), lambda s, q: s + q["x"]).alias("sum_x"))


@query()
def stat_report(spark, sf_dir):
    return rounded(report.stat_results(tb.runs(spark, sf_dir)))


@query()
def report_conclusions(spark, sf_dir):
    """What is significant, by phase and test."""
    return report.conclusions(report.stat_results(tb.runs(spark, sf_dir)))


@query()
def optimal_windows(spark, sf_dir):
    """The best windows of each algorithm, by bootstrap and by the ratio of changes."""
    return rounded(report.optimal_windows(tb.runs(spark, sf_dir)))
