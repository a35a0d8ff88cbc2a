"""Places: points and segments against obstacles, near pairs, bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import boxes as bx
from galewise.functions import geometry as g
from galewise.functions import vectors as v
from galewise.operators import overlay
from galewise.operators import spatial as sp
from galewise.operators.ranks import numbered
from galewise.queries.registry import registry, rounded
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
BASE = f"with {tb.POINTS}, {tb.boxes_sql()}, {tb.SEGMENTS}"
#: A closed segment meets a closed box: bounds overlap and the corners are not all strictly on one side of its line.
MEETS = """(least(ax, bx) <= xmax and greatest(ax, bx) >= xmin and least(ay, yb) <= ymax and greatest(ay, yb) >= ymin and
 not (least(c1, c2, c3, c4) > 0 or greatest(c1, c2, c3, c4) < 0))"""
CROSS = """(bx - ax) * (ymin - ay) - (yb - ay) * (xmin - ax) as c1, (bx - ax) * (ymin - ay) - (yb - ay) * (xmax - ax) as c2,
 (bx - ax) * (ymax - ay) - (yb - ay) * (xmin - ax) as c3, (bx - ax) * (ymax - ay) - (yb - ay) * (xmax - ax) as c4"""
HITS = f"{BASE}, x as (select s.*, b.*, {CROSS} from segments s, boxes b), hits as (select * from x where {MEETS})"


@query(f"{BASE} select p.id, b.obstacle_id, b.t_idx from points p join boxes b on x > xmin and x < xmax and y > ymin and y < ymax")
def points_inside(spark, sf_dir):
    b = tb.boxes(spark, sf_dir)
    return sp.points_inside(tb.points(spark, sf_dir), b).join(b.select("obstacle_id", "t_idx"), "obstacle_id").select("id", "obstacle_id", "t_idx")


@query(f"{BASE} select p.id, min(b.obstacle_id) as obstacle_id from points p join boxes b on x > xmin and x < xmax and y > ymin and y < ymax group by 1")
def first_containing(spark, sf_dir):
    return sp.points_inside(tb.points(spark, sf_dir), tb.boxes(spark, sf_dir)).groupBy("id").agg(F.min("obstacle_id").alias("obstacle_id"))


@query(f"{BASE} select id, x, y, label from points p where not exists (select 1 from boxes b where x between xmin and xmax and y between ymin and ymax)")
def outside_prohibited(spark, sf_dir):
    p = tb.points(spark, sf_dir)
    return p.join(sp.points_inside(p, tb.boxes(spark, sf_dir), closed=True).select("id").distinct(), "id", "left_anti")


@query(f"{HITS} select seg_id, obstacle_id, t_idx from hits")
def segment_hits(spark, sf_dir):
    return sp.segment_hits(tb.segments(spark, sf_dir), tb.boxes(spark, sf_dir), [], carry=["t_idx"]).select("seg_id", "obstacle_id", "t_idx")


@query(f"{HITS} select s.seg_id from segments s anti join hits h on s.seg_id = h.seg_id")
def valid_segments(spark, sf_dir):
    return sp.valid_segments(tb.segments(spark, sf_dir), tb.boxes(spark, sf_dir), [], ["seg_id"]).select("seg_id")


@query(f"{HITS} select s.seg_id // 5 as path_id, s.seg_id % 5 as seg_idx, count(h.obstacle_id) = 0 as is_valid from segments s left join hits h on s.seg_id = h.seg_id and h.t_idx = s.seg_id % 5 group by all")
def segment_validation(spark, sf_dir):
    """Segment i against the obstacles of key i."""
    s = tb.segments(spark, sf_dir).withColumn("t_idx", (F.col("seg_id") % 5).cast("int"))
    bad = sp.blocked_segments(s, tb.boxes(spark, sf_dir), ["t_idx"], ["seg_id"]).select("seg_id").withColumn("bad", F.lit(True))
    return s.join(bad, "seg_id", "left").select(F.floor(F.col("seg_id") / 5).alias("path_id"), (F.col("seg_id") % 5).alias("seg_idx"), F.col("bad").isNull().alias("is_valid"))


@query(f"{HITS}, v as (select s.seg_id // 5 as path_id, s.seg_id % 5 as i, count(h.obstacle_id) = 0 as ok from segments s left join hits h on s.seg_id = h.seg_id and h.t_idx = s.seg_id % 5 group by all) select path_id, bool_and(ok) as path_valid, coalesce(string_agg(i::varchar, ',' order by i) filter (where not ok), '') as invalid from v group by 1")
def path_validation(spark, sf_dir):
    rows = segment_validation(spark, sf_dir)
    bad = F.array_sort(F.collect_list(F.when(~F.col("is_valid"), F.col("seg_idx"))))
    return rows.groupBy("path_id").agg(F.bool_and("is_valid").alias("path_valid"), F.array_join(F.transform(bad, lambda x: x.cast("string")), ",").alias("invalid"))


GAP = "sqrt(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax) ** 2 + greatest(0, a.ymin - b.ymax, b.ymin - a.ymax) ** 2)"


@query(f"{BASE} select a.obstacle_id as a, b.obstacle_id as b from boxes a join boxes b on a.obstacle_id <> b.obstacle_id and {GAP} <= 50000")
def overlap_pairs(spark, sf_dir):
    return sp.close_pairs(tb.boxes(spark, sf_dir), 50_000)


@query(f"{BASE}, d as (select p.id as qid, q.id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as d from points p join points q on p.id <> q.id), k as (select *, row_number() over (partition by qid order by d, id) as place from d) select least(qid, id) as i, greatest(qid, id) as j, round(min(d), 5) as w from k where place <= 10 group by 1, 2")
def knn_edges(spark, sf_dir):
    return rounded(sp.knn_edges(tb.points(spark, sf_dir), 10), 5)


ANCHORS = f"{BASE}, q as (select id as qid, x, y from points where label = 1), d as (select qid, id, q.x as ax, q.y as ay, p.x as bx, p.y as yb, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) as d from q, points p), k as (select * from d qualify row_number() over (partition by qid order by d, id) <= 10), x as (select k.*, b.*, {CROSS} from k, boxes b where t_idx = 0), bad as (select distinct qid, id from x where {MEETS})"


@query(f"{ANCHORS} select qid, id, round(d, 5) as d from k anti join bad using (qid, id)")
def visible_anchors(spark, sf_dir):
    """The ten nearest points of each query, without those that an obstacle hides."""
    p = tb.points(spark, sf_dir)
    q = p.filter("label = 1").select(F.col("id").alias("qid"), "x", "y")
    near = sp.nearest(q, p, 10)
    seg = near.join(q.select("qid", F.col("x").alias("ax"), F.col("y").alias("ay")), "qid").join(p.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    return rounded(sp.valid_segments(seg, tb.boxes(spark, sf_dir).filter("t_idx = 0").drop("t_idx"), [], ["qid", "id"]).select("qid", "id", "d"), 5)


VIS = f"{BASE}, vx as (select * from points), d as (select a.id as i, b.id as j, a.x as ax, a.y as ay, b.x as bx, b.y as yb from vx a join vx b on a.label = b.label and a.id < b.id), x as (select d.*, b.*, {CROSS} from d, boxes b where t_idx = 1), bad as (select distinct i, j from x where {MEETS})"


@query(f"{VIS} select i, j, round(sqrt((ax - bx) ** 2 + (ay - yb) ** 2), 5) as w from d anti join bad using (i, j)")
def visibility_graph(spark, sf_dir):
    """All pairs of the vertices of each scene (a label stands for one) that see each other."""
    seen = sp.visible_pairs(tb.points(spark, sf_dir), tb.boxes(spark, sf_dir).filter("t_idx = 1").drop("t_idx"), "label")
    return rounded(seen.select("i", "j", v.distance(v.point(F.col("ax"), F.col("ay")), v.point(F.col("bx"), F.col("by"))).alias("w")), 5)


@query(f"{BASE}, q as (select id as qid, x, y from points where label = 1), f as (select * from points p where not exists (select 1 from boxes b where p.x > xmin and p.x < xmax and p.y > ymin and p.y < ymax)) select qid, f.id, round(sqrt((q.x - f.x) ** 2 + (q.y - f.y) ** 2), 5) as d from q, f qualify row_number() over (partition by qid order by sqrt((q.x - f.x) ** 2 + (q.y - f.y) ** 2), f.id) = 1")
def closest_valid_vertex(spark, sf_dir):
    p = tb.points(spark, sf_dir)
    q = p.filter("label = 1").select(F.col("id").alias("qid"), "x", "y")
    return rounded(sp.closest_valid_vertex(q, p, tb.boxes(spark, sf_dir)).select("qid", "id", "d"), 5)


@query(f"{BASE}, {tb.paths_sql()}, free as (select * from path_points p where not exists (select 1 from boxes b where p.x > xmin and p.x < xmax and p.y > ymin and p.y < ymax)) select p.path_id, min(f.i)::integer as first_free, max(f.i)::integer as last_free from (select distinct path_id from path_points) p left join free f using (path_id) group by 1")
def free_waypoints(spark, sf_dir):
    """The first and the last waypoint of each path that is inside no obstacle."""
    p = tb.points(spark, sf_dir).select(F.floor(F.col("id") / 8).alias("path_id"), (F.col("id") % 8).cast("int").alias("i"), "id", "x", "y")
    return sp.free_ends(p, tb.boxes(spark, sf_dir), "path_id", "i")


@query(f"{BASE} select row_number() over (order by x, y) - 1 as node_id, x, y from (select distinct x, y from points)")
def sorted_vertices(spark, sf_dir):
    return numbered(tb.points(spark, sf_dir).select("x", "y").distinct(), ["x", "y"], "node_id").select("node_id", "x", "y")


@query(f"""{BASE}, b as (select t_idx, min(xmin) - 50000 as x0, min(ymin) - 50000 as y0, max(xmax) + 50000 as x1, max(ymax) + 50000 as y1 from boxes group by 1)
select t_idx, k.name, k.ax as ax, k.ay as ay, k.bx as bx, k.bby as b_y from b, lateral (values ('bottom-top', (x0 + x1) / 2, y0, (x0 + x1) / 2, y1), ('left-right', x0, (y0 + y1) / 2, x1, (y0 + y1) / 2), ('diagonal', x0, y0, x1, y1), ('antidiagonal', x1, y0, x0, y1)) k(name, ax, ay, bx, bby)""")
def scene_bounds(spark, sf_dir):
    """Four pairs of points across the padded bounds of each key's obstacles."""
    b = tb.boxes(spark, sf_dir).groupBy("t_idx").agg((F.min("xmin") - 50_000).alias("x0"), (F.min("ymin") - 50_000).alias("y0"), (F.max("xmax") + 50_000).alias("x1"), (F.max("ymax") + 50_000).alias("y1"))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    pair = lambda name, ax, ay, zx, zy: F.struct(F.lit(name).alias("name"), ax.alias("ax"), ay.alias("ay"), zx.alias("bx"), zy.alias("b_y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return b.select("t_idx", F.explode(F.array(pair("bottom-top", mx, y0, mx, y1), pair("left-right", x0, my, x1, my), pair("diagonal", x0, y0, x1, y1), pair("antidiagonal", x1, y0, x0, y1))).alias("p")).select("t_idx", "p.*")


@query("""with recursive pts as (select vec_id as id, round(embedding[1]::double * 1000000) as x, round(embedding[2]::double * 1000000) as y, label from embeddings),
o as (select id, x - 9000 as xmin, y - 9000 as ymin, x + 9000 as xmax, y + 9000 as ymax, row_number() over (order by id) as n from pts where label = 0),
f(n, x0, y0, x1, y1) as (select 0::bigint, -100000.0::double, -50000.0::double, 100000.0::double, 50000.0::double
 union all select o.n, case when xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0 then least(x0, xmin) else x0 end, case when xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0 then least(y0, ymin) else y0 end, case when xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0 then greatest(x1, xmax) else x1 end, case when xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0 then greatest(y1, ymax) else y1 end
 from f join o on o.n = f.n + 1)
select round(x0 - (x1 - x0) * 0.1, 3) as xmin, round(y0 - (y1 - y0) * 0.1, 3) as ymin, round(x1 + (x1 - x0) * 0.1, 3) as xmax, round(y1 + (y1 - y0) * 0.1, 3) as ymax from f order by n desc limit 1""")
def total_bounds(spark, sf_dir):
    """Bounds of A (-50 km, 0) and B (50 km, 0), padded by half their distance and grown box by box in order."""
    b = tb.boxes(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("obstacle_id", "xmin", "ymin", "xmax", "ymax"))).alias("b"))
    return rounded(b.select(bx.grown_bounds(F.col("b"), v.point(-50_000, 0), v.point(50_000, 0)).alias("g")).select("g.*"), 3)


@query(f"{BASE}, w as (select obstacle_id, t_idx, greatest(xmin, -60000) as x0, least(xmax, 60000) as x1, greatest(ymin, -60000) as y0, least(ymax, 60000) as y1 from boxes) select obstacle_id, t_idx, round((x1 - x0) * (y1 - y0), 3) as area from w where x0 < x1 and y0 < y1")
def clip_candidates(spark, sf_dir):
    """Obstacles cut to a box, and the areas that are left."""
    window = F.array(v.point(-60_000, -60_000), v.point(60_000, -60_000), v.point(60_000, 60_000), v.point(-60_000, 60_000))
    b = tb.boxes(spark, sf_dir).filter("xmin < 60000 and xmax > -60000 and ymin < 60000 and ymax > -60000")
    cut = b.select("obstacle_id", "t_idx", g.clipped(F.get(g.box_polygon(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]), F.lit(0)), window).alias("ring"))
    return rounded(cut.filter(F.size("ring") > 2).select("obstacle_id", "t_idx", g.area(F.col("ring")).alias("area")).filter("area > 0"), 3)


#: Cells between all coordinates of a group's boxes; those with a box and without a taker are what is left. Edges are counted where a neighbour is out.
CELLS = """xs as (select distinct k, unnest([xmin, xmax]) as v from every), ys as (select distinct k, unnest([ymin, ymax]) as v from every),
xi as (select k, v, lead(v) over (partition by k order by v) as w, row_number() over (partition by k order by v) as i from xs), yi as (select k, v, lead(v) over (partition by k order by v) as w, row_number() over (partition by k order by v) as j from ys),
c as (select k, i, j, any_value(x.w - x.v) as dx, any_value(y.w - y.v) as dy from every e join xi x using (k) join yi y using (k) where x.v >= e.xmin and x.w <= e.xmax and y.v >= e.ymin and y.w <= e.ymax group by all having bool_or(role = 0) and not bool_or(role = 1)),
m as (select c.k, sum(c.dx * c.dy) as area, sum(c.dy * ((l.i is null)::int + (r.i is null)::int) + c.dx * ((d.i is null)::int + (u.i is null)::int)) as perimeter
 from c left join c l on l.k = c.k and l.i = c.i - 1 and l.j = c.j left join c r on r.k = c.k and r.i = c.i + 1 and r.j = c.j left join c d on d.k = c.k and d.i = c.i and d.j = c.j - 1 left join c u on u.k = c.k and u.i = c.i and u.j = c.j + 1 group by all)"""
WIDE, VIEW = 60_000, 40_000


def _boxed(df):
    return df.withColumn("polygon", g.box_polygon(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))


@query(f"with {tb.POINTS}, {tb.boxes_sql(WIDE)}, every as (select t_idx as k, 0 as role, xmin, ymin, xmax, ymax from boxes), {CELLS} select k as t_idx, round(area, 3) as area, round(perimeter, 3) as perimeter from m")
def dissolved(spark, sf_dir):
    """The obstacles of each key as one: area and outline of their union."""
    parts = overlay.dissolved(_boxed(tb.boxes(spark, sf_dir, WIDE)), ["t_idx"], cell=50_000.0)
    return rounded(overlay.measures(parts, ["t_idx"]).select("t_idx", "area", "perimeter"), 3)


@query(f"""with {tb.POINTS}, {tb.boxes_sql(WIDE)}, every as (select t_idx + 1 as t, obstacle_id as o, struct_pack(t := t_idx + 1, o := obstacle_id) as k, 0 as role, xmin, ymin, xmax, ymax from boxes
union all select a.t_idx + 1, a.obstacle_id, struct_pack(t := a.t_idx + 1, o := a.obstacle_id), 1, greatest(b.xmin, a.xmin), greatest(b.ymin, a.ymin), least(b.xmax, a.xmax), least(b.ymax, a.ymax)
 from boxes a join (select t_idx, (xmin + xmax) / 2 - {VIEW} as xmin, (ymin + ymax) / 2 - {VIEW} as ymin, (xmin + xmax) / 2 + {VIEW} as xmax, (ymin + ymax) / 2 + {VIEW} as ymax from boxes) b on b.t_idx = a.t_idx + 1 and b.xmin < a.xmax and b.xmax > a.xmin and b.ymin < a.ymax and b.ymax > a.ymin),
{CELLS} select k.t as t_idx, k.o as obstacle_id, round(area, 3) as area, round(perimeter, 3) as perimeter from m""")
def difference(spark, sf_dir):
    """What is left of each obstacle at the next key, without the boxes seen there."""
    b = tb.boxes(spark, sf_dir, WIDE)
    earlier = _boxed(b).withColumn("t_idx", F.col("t_idx") + 1)
    seen = tb.boxes(spark, sf_dir, VIEW).select("t_idx", F.col("obstacle_id").alias("taker_id"), "xmin", "ymin", "xmax", "ymax")
    parts = overlay.difference(earlier.select("t_idx", "obstacle_id", "polygon"), _boxed(seen).select("t_idx", "taker_id", "polygon"), ["t_idx"], cell=50_000.0)
    return rounded(overlay.measures(parts, ["t_idx", "obstacle_id"]).select("t_idx", "obstacle_id", "area", "perimeter"), 3)


REACH, QUARTER = 25_000, 8


@query(f"with {tb.POINTS}, {tb.boxes_sql()} select obstacle_id, t_idx, round((18000.0 * 18000 + 4 * 18000.0 * {REACH} + {2 * QUARTER} * {REACH}::double * {REACH} * sin(pi() / {2 * QUARTER})) / 1e6, 3) as km2, round((4 * 18000.0 + {8 * QUARTER} * {REACH} * sin(pi() / {4 * QUARTER})) / 1e3, 3) as km from boxes")
def buffered(spark, sf_dir):
    """Each obstacle grown by 25 km, circles as polygons of 32 edges."""
    b = _boxed(tb.boxes(spark, sf_dir))
    parts = overlay.measures(overlay.buffered(b.select("t_idx", "obstacle_id", "polygon"), ["t_idx"], float(REACH), QUARTER, cell=20_000.0), ["t_idx", "obstacle_id"])
    return rounded(parts.select("obstacle_id", "t_idx", (F.col("area") / 1e6).alias("km2"), (F.col("perimeter") / 1e3).alias("km")), 3)
