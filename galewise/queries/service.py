"""What a flight experiment asks for: layers, bounds, status, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import boxes as bx
from galewise.functions import vectors as v
from galewise.operators import spatial as sp
from galewise.operators.ranks import numbered
from galewise.queries.registry import registry, rounded
from galewise.queries.spatial import BASE
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()


@query(f"{BASE}, k as (select t_idx, t_idx - 1 as colour from boxes where t_idx between 1 and 3) select b.t_idx, (b.t_idx - 1)::integer as colour_index, count(*) as n from boxes b where b.t_idx between 1 and 3 and b.xmin <= 200000 and b.xmax >= -200000 and b.ymin <= 150000 and b.ymax >= -150000 group by all")
def window_layers(spark, sf_dir):
    """Layers of the keys [1, 4) that meet a box, the colour by place in the window."""
    b = tb.boxes(spark, sf_dir).filter(F.col("t_idx").between(1, 3))
    inside = b.filter("xmin <= 200000 and xmax >= -200000 and ymin <= 150000 and ymax >= -150000")
    return inside.groupBy("t_idx").agg(F.count("*").alias("n")).select("t_idx", (F.col("t_idx") - 1).alias("colour_index"), "n")


@query(f"{BASE} select seg_id, (round(sqrt((bx - ax) ** 2 + (yb - ay) ** 2) / 1000))::bigint as km, round(sqrt((bx - ax) ** 2 + (yb - ay) ** 2), 4) >= 75000 as can_confirm, sqrt((bx - ax) ** 2 + (yb - ay) ** 2) <= 10000 as snaps from segments")
def flight_status(spark, sf_dir):
    a, b = v.point(F.col("ax"), F.col("ay")), v.point(F.col("bx"), F.col("by"))
    return tb.segments(spark, sf_dir).select("seg_id", F.round(v.distance(a, b) / 1000).cast("long").alias("km"), (F.round(v.distance(a, b), 4) >= 75_000).alias("can_confirm"), v.within(a, b, 10_000).alias("snaps"))


@query(f"with {tb.POINTS}, {tb.paths_sql()}, l as (select path_id, i, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as d from path_points window w as (partition by path_id order by i)), p as (select path_id, count(*) as n, coalesce(sum(d), 0) as d from l group by 1) select (path_id // 10) as experiment, sum(n)::bigint as total_waypoints, round(sum(d), 3) as total_distance_m from p group by 1")
def experiment_totals(spark, sf_dir):
    p = tb.paths(spark, sf_dir).groupBy(F.floor(F.col("path_id") / 10).alias("experiment")).agg(F.collect_list("path").alias("all_paths"))
    waypoints = F.aggregate("all_paths", F.lit(0), lambda s, q: s + F.size(q)).cast("long")
    total = F.aggregate("all_paths", F.lit(0.0), lambda s, q: s + v.length(q))
    return rounded(p.select("experiment", waypoints.alias("total_waypoints"), total.alias("total_distance_m")), 3)


@query("select distinct strftime(o_orderdate, '%Y_%m_%d') as scene, dense_rank() over (order by strftime(o_orderdate, '%Y_%m_%d')) as place from orders")
def list_scenes(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy_MM_dd").alias("scene")).distinct()
    return numbered(rows, ["scene"], "place").withColumn("place", F.col("place") + 1)


@query(f"""{BASE}, s as (select * from segments), b as (select seg_id, least(ax, bx) - sqrt((bx - ax) ** 2 + (yb - ay) ** 2) / 2 as x0, greatest(ax, bx) + sqrt((bx - ax) ** 2 + (yb - ay) ** 2) / 2 as x1, least(ay, yb) - sqrt((bx - ax) ** 2 + (yb - ay) ** 2) / 2 as y0, greatest(ay, yb) + sqrt((bx - ax) ** 2 + (yb - ay) ** 2) / 2 as y1 from s)
select seg_id, round(x0 - (x1 - x0) * 0.1, 3) as xmin, round(y0 - (y1 - y0) * 0.1, 3) as ymin, round(x1 + (x1 - x0) * 0.1, 3) as xmax, round(y1 + (y1 - y0) * 0.1, 3) as ymax from b""")
def corridor_bounds(spark, sf_dir):
    """Bounds of an experiment without obstacles."""
    none = F.array().cast("array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>")
    s = tb.segments(spark, sf_dir)
    return rounded(s.select("seg_id", bx.grown_bounds(none, v.point(F.col("ax"), F.col("ay")), v.point(F.col("bx"), F.col("by"))).alias("g")).select("seg_id", "g.*"), 3)


@query(f"{BASE} select obstacle_id, count(*) as n from boxes b join points p on p.x between b.xmin and b.xmax and p.y between b.ymin and b.ymax group by 1")
def points_per_obstacle(spark, sf_dir):
    return sp.points_inside(tb.points(spark, sf_dir), tb.boxes(spark, sf_dir), closed=True).groupBy("obstacle_id").agg(F.count("*").alias("n"))
