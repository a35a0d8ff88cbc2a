"""Vectors, paths, boxes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import boxes as bx
from galewise.functions import text as tx
from galewise.functions import vectors as v
from galewise.operators import counting
from galewise.queries.registry import registry, rounded
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
SEG = f"with {tb.POINTS}, {tb.SEGMENTS}, dir as (select *, sqrt((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)) as d from segments)"
PATH = f"with {tb.POINTS}, {tb.paths_sql()}"
CUM = f"""{PATH}, legs as (select *, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as d from path_points window w as (partition by path_id order by i)),
cum as (select *, coalesce(sum(d) over (partition by path_id order by i rows unbounded preceding), 0) as s from legs)"""


def _a():
    return v.point(F.col("ax"), F.col("ay"))


def _b():
    return v.point(F.col("bx"), F.col("by"))


def _paths(spark, sf_dir):
    return tb.paths(spark, sf_dir)


@query(f"{SEG} select seg_id, round(case when d > 0 then (bx - ax) / d else 0 end, 6) as ux, round(case when d > 0 then (yb - ay) / d else 0 end, 6) as uy, round(d, 6) as d, d <= 200000 as near, round(degrees(atan2(yb - ay, bx - ax)), 6) as heading from dir")
def unit_direction(spark, sf_dir):
    u = v.unit_direction(_a(), _b())
    return rounded(tb.segments(spark, sf_dir).select("seg_id", u["x"].alias("ux"), u["y"].alias("uy"), v.distance(_a(), _b()).alias("d"), v.within(_a(), _b(), 200_000).alias("near"), v.heading(_a(), _b()).alias("heading")))


@query(f"{SEG} select seg_id, round(bx + (bx - ax) / d * 25000, 4) as x, round(yb + (yb - ay) / d * 25000, 4) as y from dir")
def shift_point(spark, sf_dir):
    p = v.moved(_b(), v.unit_direction(_a(), _b()), 25_000)
    return rounded(tb.segments(spark, sf_dir).select("seg_id", p["x"].alias("x"), p["y"].alias("y")), 4)


@query(f"""{PATH}, t as (select path_id, i, x - lag(x) over w as bx, y - lag(y) over w as yb, lead(x) over w - x as cx, lead(y) over w - y as cy from path_points window w as (partition by path_id order by i)),
a as (select path_id, i::integer as idx, round(degrees(acos(greatest(-1, least(1, (-bx * cx - yb * cy) / (sqrt(bx * bx + yb * yb) * sqrt(cx * cx + cy * cy)))))), 5) as angle from t where bx is not null and cx is not null)
select path_id, idx, angle, row_number() over (partition by path_id order by angle, idx) as place from a""")
def turn_angles(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("path_id", F.posexplode(v.turns(F.col("path"))).alias("place", "t"))
    return rows.select("path_id", F.col("t.idx").alias("idx"), F.round("t.angle", 5).alias("angle"), (F.col("place") + 1).cast("long").alias("place"))


@query(f"{CUM} select path_id, round(max(s), 5) as length, count(*) as n from cum group by 1")
def path_length(spark, sf_dir):
    return rounded(_paths(spark, sf_dir).select("path_id", v.length(F.col("path")).alias("length"), F.size("path").cast("long").alias("n")), 5)


@query(f"{CUM} select path_id, i::integer as i, round(s, 5) as s, least(floor(s / 75000), 9)::integer as step from cum")
def cumulative_length(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("path_id", F.posexplode(v.measured(F.col("path"))).alias("i", "p"))
    return rows.select("path_id", "i", F.round("p.s", 5).alias("s"), v.step_of(F.col("p.s"), 75_000, F.lit(10)).cast("int").alias("step"))


@query(f"{CUM}, l as (select *, lag(x) over w as px, lag(y) over w as py from cum window w as (partition by path_id order by i)) select path_id, round((x - px) / d, 6) as dx, round((y - py) / d, 6) as dy from l where d > 1e-6 qualify row_number() over (partition by path_id order by i desc) = 1")
def direction_vector(spark, sf_dir):
    d = v.last_direction(F.col("path"))
    return rounded(_paths(spark, sf_dir).select("path_id", d.alias("d")).select("path_id", F.col("d.x").alias("dx"), F.col("d.y").alias("dy")).filter("dx is not null"))


@query(f"{SEG}, n as (select *, greatest(1, ceil(d / 20000))::integer as n from dir) select seg_id, i::integer as i, round(ax + (bx - ax) * i / n, 4) as x, round(ay + (yb - ay) * i / n, 4) as y from n, lateral (select unnest(range(0, n + 1)) as i)")
def interpolate(spark, sf_dir):
    rows = tb.segments(spark, sf_dir).select("seg_id", F.posexplode(v.interpolated(_a(), _b(), 20_000)).alias("i", "p"))
    return rounded(rows.select("seg_id", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y")), 4)


@query(f"""{CUM}, l as (select *, lead(x) over w as nx, lead(y) over w as ny from cum window w as (partition by path_id order by i)),
n as (select *, greatest(1, ceil(sqrt((nx - x) ** 2 + (ny - y) ** 2) / 20000))::integer as n from l where nx is not null)
select path_id, sum(n)::bigint + 1 as n_points from n group by 1""")
def densify(spark, sf_dir):
    rows = _paths(spark, sf_dir).filter(F.size("path") > 1)
    return rows.select("path_id", F.size(v.densified(F.col("path"), 20_000)).cast("long").alias("n_points"))


@query(f"""{CUM}, t as (select path_id, max(s) as total from cum group by 1), k as (select path_id, total, k from t, lateral (select unnest(range(0, ceil(total / 75000)::bigint)) as k) where total > 0)
select k.path_id, k.k::integer as piece, round(least((k + 1) * 75000, total) - k * 75000, 4) as length, 2 + (select count(*) from cum c where c.path_id = k.path_id and c.s > k.k * 75000 and c.s < least((k.k + 1) * 75000, total))::bigint as n_points from k""")
def split_segments(spark, sf_dir):
    rows = _paths(spark, sf_dir).filter(F.size("path") > 1).select("path_id", F.posexplode(v.pieces(F.col("path"), 75_000)).alias("piece", "p"))
    # a leg's length may be measured with an error in the last digit: lengths are rounded
    return rows.select("path_id", "piece", F.round(v.length(F.col("p")), 4).alias("length"), F.size("p").cast("long").alias("n_points"))


@query(f"""{CUM}, l as (select path_id, s, x, y, lead(s) over w as ns, lead(x) over w as nx, lead(y) over w as ny from cum window w as (partition by path_id order by i)), t as (select path_id, max(s) as total from cum group by 1)
select path_id, round(x + (nx - x) * (75000 - s) / (ns - s), 3) as x, round(y + (ny - y) * (75000 - s) / (ns - s), 3) as y, round(total - 75000, 3) as rest from l join t using (path_id) where s < 75000 and ns >= 75000""")
def point_at_distance(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("path_id", v.point_at(F.col("path"), 75_000).alias("q")).filter("q is not null")
    return rounded(rows.select("path_id", F.col("q.point.x").alias("x"), F.col("q.point.y").alias("y"), v.length(F.col("q.rest")).alias("rest")), 3)


@query(f"{PATH}, r as (select path_id, i, floor(x / 250000) as gx, floor(y / 250000) as gy from path_points), k as (select *, lag(gx) over w as px, lag(gy) over w as py from r window w as (partition by path_id order by i)) select path_id, count(*) as n from k where px is null or px <> gx or py <> gy group by 1")
def consecutive_dedup(spark, sf_dir):
    coarse = F.transform("path", lambda p: v.point(F.floor(p["x"] / 250_000), F.floor(p["y"] / 250_000)))
    return _paths(spark, sf_dir).select("path_id", coarse.alias("path")).select("path_id", F.size(v.without_repeats(F.col("path"))).cast("long").alias("n"))


@query(f"""{PATH}, t as (select *, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from path_points window w as (partition by path_id order by i)),
d as (select *, sqrt((x - px) ** 2 + (y - py) ** 2) as d1, sqrt((nx - x) ** 2 + (ny - y) ** 2) as d2 from t where i = 3 and nx is not null)
select path_id, round(case when d1 > 25000 then x - (x - px) / d1 * 25000 end, 3) as ax, round(case when d2 > 25000 then x + (nx - x) / d2 * 25000 end, 3) as bx, 7 + (d1 > 25000)::integer + (d2 > 25000)::integer as n from d""")
def replace_point(spark, sf_dir):
    rows = _paths(spark, sf_dir).filter(F.size("path") == 8)
    d1, d2 = v.distance(F.get("path", F.lit(2)), F.get("path", F.lit(3))), v.distance(F.get("path", F.lit(3)), F.get("path", F.lit(4)))
    new = rows.withColumn("new", v.smoothed_at(F.col("path"), F.lit(3), 25_000)).withColumn("near1", d1 > 25_000).withColumn("near2", d2 > 25_000)
    second = F.when(F.col("near2"), F.get("new", F.when(F.col("near1"), 4).otherwise(3))["x"])
    return rounded(new.select("path_id", F.when(F.col("near1"), F.get("new", F.lit(3))["x"]).alias("ax"), second.alias("bx"), F.size("new").alias("n")), 3)


@query(f"{PATH} select path_id, x, y from path_points where i = 0")
def simplify_min_distance(spark, sf_dir):
    """With a reach beyond the scene, the first point alone stays."""
    rows = _paths(spark, sf_dir).select("path_id", F.explode(v.thinned(F.col("path"), 1e9)).alias("p"))
    return rows.select("path_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


BOX = f"{SEG}, st as (select * from (values ('center', 1.0, 0.5, 0.0), ('left', 1.0, 0.5, 0.5), ('right', 1.0, 0.5, -0.5), ('wide', 2.0, 0.5, 0.0)) t(strategy, w, f, l)), u as (select *, (bx - ax) / d as ux, (yb - ay) / d as uy from dir)"


def _ahead(spark, sf_dir):
    rows = tb.segments(spark, sf_dir).withColumn("strategy", F.explode(F.array(*[F.lit(k) for k in bx.STRATEGIES])))
    return rows.withColumn("p", _a()).withColumn("u", v.unit_direction(_a(), _b()))


@query(f"""{BOX}, c as (select *, ax + ux * f * 250000 - uy * l * 250000 as cx, ay + uy * f * 250000 + ux * l * 250000 as cy from u, st),
k as (select * from (values (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) t(corner, s, t))
select seg_id, strategy, corner::integer as corner, round(cx + cos(atan2(uy, ux) - pi() / 2) * s * w * 125000 - sin(atan2(uy, ux) - pi() / 2) * t * 125000, 3) as x, round(cy + sin(atan2(uy, ux) - pi() / 2) * s * w * 125000 + cos(atan2(uy, ux) - pi() / 2) * t * 125000, 3) as y from c, k""")
def oriented_bbox(spark, sf_dir):
    rows = _ahead(spark, sf_dir).select("seg_id", "strategy", F.posexplode(bx.oriented_box(F.col("p"), F.col("u"), F.col("strategy"), 250_000)).alias("corner", "q"))
    return rounded(rows.select("seg_id", "strategy", "corner", F.col("q.x").alias("x"), F.col("q.y").alias("y")), 3)


@query(f"""{BOX}, g as (select seg_id, strategy, (p.x - ax) * ux + (p.y - ay) * uy as f1, (p.x - ax) * -uy + (p.y - ay) * ux as s1, l, w from u, st, points p)
select seg_id, strategy, count(*) as n from g where f1 between 0 and 250000 and s1 between l * 250000 - w * 125000 and l * 250000 + w * 125000 group by all""")
def points_in_box(spark, sf_dir):
    """How many points are in each box ahead of a segment; boxes without any, and segments without a direction, have no row."""
    d = v.distance(_a(), _b())
    ahead = tb.segments(spark, sf_dir).filter(d > 0).select("seg_id", "ax", "ay", ((F.col("bx") - F.col("ax")) / d).alias("ux"), ((F.col("by") - F.col("ay")) / d).alias("uy"))
    return counting.points_in_boxes(ahead, tb.points(spark, sf_dir), "seg_id", bx.STRATEGIES, 250_000)


@query(f"""{BOX}, c as (select *, ax + ux * f * 250000 - uy * l * 250000 as cx, ay + uy * f * 250000 + ux * l * 250000 as cy, atan2(uy, ux) - pi() / 2 as r, 250000 / 256.0 as res from u, st)
select seg_id, strategy, round(cos(r) * res, 4) as a, round(sin(r) * res, 4) as b, round(cx + cos(r) * (-w * 125000) - sin(r) * 125000, 3) as c, round(sin(r) * res, 4) as d, round(-cos(r) * res, 4) as e, round(cy + sin(r) * (-w * 125000) + cos(r) * 125000, 3) as f from c""")
def raster_transform(spark, sf_dir):
    t = _ahead(spark, sf_dir).select("seg_id", "strategy", bx.raster_transform(F.col("p"), F.col("u"), F.col("strategy"), 250_000, 256).alias("t"))
    return t.select("seg_id", "strategy", *[F.round(f"t.{k}", 3 if k in "cf" else 4).alias(k) for k in "abcdef"])


FIT = f"{SEG}, b as (select seg_id, least(ax, bx) - 1000 as x0, least(ay, yb) - 1000 as y0, greatest(ax, bx) + 1000 as x1, greatest(ay, yb) + 1000 as y1, ax, ay from segments), t as (select *, least(700 / (x1 - x0), 700 / (y1 - y0)) as k from b)"


def _canvas(spark, sf_dir):
    bounds = F.struct((F.least("ax", "bx") - 1000).alias("xmin"), (F.least("ay", "by") - 1000).alias("ymin"), (F.greatest("ax", "bx") + 1000).alias("xmax"), (F.greatest("ay", "by") + 1000).alias("ymax"))
    return tb.segments(spark, sf_dir).withColumn("t", bx.canvas(bounds, 800, 800, 50)).withColumn("a", _a())


@query(f"{FIT} select seg_id, round(k, 8) as scale, round(50 - x0 * k, 5) as offset_x, round(750 + y0 * k, 5) as offset_y, round(ax * k + 50 - x0 * k, 4) as px, round(750 + y0 * k - ay * k, 4) as py, ax as back_x from t")
def pixel_transform(spark, sf_dir):
    rows = _canvas(spark, sf_dir).withColumn("px", bx.to_pixel(F.col("a"), F.col("t"))).withColumn("back", bx.from_pixel(F.col("px"), F.col("t")))
    return rows.select("seg_id", F.round("t.scale", 8).alias("scale"), F.round("t.offset_x", 5).alias("offset_x"), F.round("t.offset_y", 5).alias("offset_y"), F.round("px.x", 4).alias("px"), F.round("px.y", 4).alias("py"), F.round("back.x").alias("back_x"))


@query(f"{FIT}, z as (select *, least(10, greatest(1, (1 + seg_id % 20))) as z from t) select seg_id, round(k * z, 7) as scale, round(case when z = 1 then 50 - x0 * k else 400 - ax * k * z end, 4) as offset_x, round(case when z = 1 then 750 + y0 * k else 400 + ay * k * z end, 4) as offset_y from z")
def zoom_transform(spark, sf_dir):
    rows = _canvas(spark, sf_dir).withColumn("z", bx.zoomed(F.col("t"), F.col("a"), (1 + F.col("seg_id") % 20).cast("double"), 800, 800))
    return rows.select("seg_id", F.round("z.scale", 7).alias("scale"), F.round("z.offset_x", 4).alias("offset_x"), F.round("z.offset_y", 4).alias("offset_y"))


@query("select c_custkey, ['#FF6B6B', '#FF8E53', '#FFA94D', '#FFD43B', '#A9E34B', '#69DB7C', '#38D9A9'][(c_custkey % 7) + 1] as colour, 'rgba(' || ('0x' || substr(['#FF6B6B', '#FF8E53', '#FFA94D', '#FFD43B', '#A9E34B', '#69DB7C', '#38D9A9'][(c_custkey % 7) + 1], 2, 2))::integer || ', ' || ('0x' || substr(['#FF6B6B', '#FF8E53', '#FFA94D', '#FFD43B', '#A9E34B', '#69DB7C', '#38D9A9'][(c_custkey % 7) + 1], 4, 2))::integer || ', ' || ('0x' || substr(['#FF6B6B', '#FF8E53', '#FFA94D', '#FFD43B', '#A9E34B', '#69DB7C', '#38D9A9'][(c_custkey % 7) + 1], 6, 2))::integer || ', 0.5)' as fill from customer")
def layer_colours(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "customer").select("c_custkey", tx.colour_of(F.col("c_custkey")).alias("colour"))
    return rows.withColumn("fill", tx.rgba(F.col("colour"), 0.5))


@query("select window_size, flag, 'w' || window_size as label, case when flag = 'N' then '—' else printf('%.4f', p) end as p_text, case when n % 2 = 0 then '✓' else '—' end as mark, case when flag = 'A' then 'ConvGRU' else 'GRU' end || '.pt' as checkpoint, flag = 'A' as convolutional from (select l_linenumber as window_size, l_returnflag as flag, avg(l_discount) as p, count(*) as n from lineitem group by all)")
def labels_and_formats(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("window_size"), F.col("l_returnflag").alias("flag")).agg(F.avg("l_discount").alias("p"), F.count("*").alias("n"))
    model = F.when(F.col("flag") == "A", "ConvGRU").otherwise("GRU")
    return rows.select("window_size", "flag", tx.window_label(F.col("window_size")).alias("label"), tx.p_text(F.when(F.col("flag") != "N", F.col("p"))).alias("p_text"), tx.mark(F.col("n") % 2 == 0).alias("mark"), tx.checkpoint_name(model).alias("checkpoint"), tx.is_convolutional(model).alias("convolutional"))


@query(f"""with {tb.POINTS}, {tb.boxes_sql()}, f as (select *, row_number() over (partition by t_idx order by obstacle_id) - 1 as i from boxes),
j as (select t_idx, i, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || xmin::bigint || ',' || ymin::bigint || '],[' || xmax::bigint || ',' || ymin::bigint || '],[' || xmax::bigint || ',' || ymax::bigint || '],[' || xmin::bigint || ',' || ymax::bigint || '],[' || xmin::bigint || ',' || ymin::bigint || ']]]}},"properties":{{"id":' || i || '}}}}' as feature from f)
select t_idx, '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' order by i) || ']}}' as geojson from j group by 1""")
def geojson_layers(spark, sf_dir):
    ring = F.array(v.point(F.col("xmin"), F.col("ymin")), v.point(F.col("xmax"), F.col("ymin")), v.point(F.col("xmax"), F.col("ymax")), v.point(F.col("xmin"), F.col("ymax")), v.point(F.col("xmin"), F.col("ymin")))
    rows = tb.boxes(spark, sf_dir).select("t_idx", "obstacle_id", F.array(ring).alias("polygon"))
    layers = rows.groupBy("t_idx").agg(F.array_sort(F.collect_list(F.struct("obstacle_id", "polygon"))).alias("p"))
    return layers.select("t_idx", tx.feature_collection(F.transform("p", lambda x: x["polygon"])).alias("geojson"))
