"""Frames: masks, crops, pooling, regions, nowcasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import boxes as bx
from galewise.functions import geometry as g
from galewise.functions import vectors as v
from galewise.operators import rasters as rs
from galewise.queries.registry import registry, rounded
from galewise.sources import rasters as src
from galewise.sources import shared
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
PX = f"with {tb.PIXELS}"


@query(f"{PX} select frame_id, row, col, value from pixels where value > 100 and value < 255")
def pixel_mask(spark, sf_dir):
    return tb.pixels(spark, sf_dir).filter(rs.masked(F.col("value"), 100, 255))


@query(f"{PX} select frame_id, row, col, case when value > 100 then value else 0 end as value from pixels")
def threshold_to_zero(spark, sf_dir):
    return tb.pixels(spark, sf_dir).withColumn("value", rs.to_zero(F.col("value"), 100))


@query(f"{PX} select frame_id, count(*) filter (where value > 100) as n from pixels group by 1 having count(*) filter (where value > 100) > 9")
def informative_frames(spark, sf_dir):
    return tb.pixels(spark, sf_dir).groupBy("frame_id").agg(F.count_if(F.col("value") > 100).alias("n")).filter("n > 9")


BORDERS = [(0, 0, 4, 0, 4), (1, 2, 6, 4, 8), (2, 4, 8, 1, 5)]


@query(f"{PX}, b as (select * from (values (0, 0, 4, 0, 4), (1, 2, 6, 4, 8), (2, 4, 8, 1, 5)) t(border_id, y0, y1, x0, x1)) select frame_id, border_id, (row - y0)::integer as row, (col - x0)::integer as col, value from pixels join b on row >= y0 and row < y1 and col >= x0 and col < x1")
def frame_crops(spark, sf_dir):
    borders = spark.createDataFrame(BORDERS, "border_id int, y_start int, y_end int, x_start int, x_end int")
    return rs.crops(tb.pixels(spark, sf_dir), borders).select("frame_id", "border_id", "row", "col", "value")


@query(f"{PX}, t as (select unnest(range(0, 3))::integer as r), u as (select unnest(range(0, 5))::integer as c) select frame_id, r as row, c as col, max(value) as value from pixels, t, u where row >= floor(r * 8 / 3.0) and row < ceil((r + 1) * 8 / 3.0) and col >= floor(c * 8 / 5.0) and col < ceil((c + 1) * 8 / 5.0) group by all")
def max_pool(spark, sf_dir):
    return rs.max_pooled(tb.pixels(spark, sf_dir), (8, 8), (3, 5))


@query(f"""{PX}, t as (select unnest(range(0, 3))::integer as r), u as (select unnest(range(0, 3))::integer as c),
w as (select frame_id, r, c, value, greatest(0, least((row + 1) * 3 / 8.0, r + 1) - greatest(row * 3 / 8.0, r)) * greatest(0, least((col + 1) * 3 / 8.0, c + 1) - greatest(col * 3 / 8.0, c)) as w from pixels, t, u)
select frame_id, r as row, c as col, round(sum(w * value) / sum(w), 4) as value from w where w > 0 group by all""")
def area_resize(spark, sf_dir):
    return rounded(rs.area_resized(tb.pixels(spark, sf_dir), (8, 8), (3, 3)), 4)


@query(f"{PX} select frame_id, row, (case when frame_id % 2 = 0 then col else col + 8 end)::integer as col, value from pixels")
def left_right_concat(spark, sf_dir):
    p = tb.pixels(spark, sf_dir)
    return rs.side_by_side(p.filter("frame_id % 2 = 0"), p.filter("frame_id % 2 = 1"), 8)


@query("""with recursive px as (select vec_id as frame_id, (i - 1)::integer as p from embeddings, range(1, 65) t(i) where round(embedding[i]::double * 1000)::integer > 50),
near as (select a.frame_id, a.p as a, b.p as b from px a join px b on a.frame_id = b.frame_id and ((a.p // 8 = b.p // 8 and abs(a.p - b.p) = 1) or abs(a.p - b.p) = 8)),
reach(frame_id, p, other) as (select frame_id, p, p from px union select r.frame_id, r.p, n.b from reach r join near n on n.frame_id = r.frame_id and n.a = r.other)
select frame_id, (p // 8)::integer as row, (p % 8)::integer as col, min(other)::integer as region from reach group by frame_id, p""")
def frame_components(spark, sf_dir):
    return rs.regions(tb.pixels(spark, sf_dir), F.col("value") > 50, 8).withColumn("region", F.col("region").cast("int"))


REGIONS = """with recursive px as (select vec_id as frame_id, (i - 1)::integer as p from embeddings, range(1, 65) t(i) where round(embedding[i]::double * 1000)::integer > 50),
near as (select a.frame_id, a.p as a, b.p as b from px a join px b on a.frame_id = b.frame_id and ((a.p // 8 = b.p // 8 and abs(a.p - b.p) = 1) or abs(a.p - b.p) = 8)),
reach(frame_id, p, other) as (select frame_id, p, p from px union select r.frame_id, r.p, n.b from reach r join near n on n.frame_id = r.frame_id and n.a = r.other),
regions as (select frame_id, p // 8 as y, p % 8 as x, min(other)::integer as region from reach group by frame_id, p)"""


OUTLINES = f"""{REGIONS}, own as (select a.frame_id, a.region, count(*) as n_pixels, sum((r.x is not null)::integer + (d.x is not null)::integer) as pairs, sum((r.x is not null and d.x is not null and q.x is not null)::integer) as fours
  from regions a left join regions r on r.frame_id = a.frame_id and r.region = a.region and r.y = a.y and r.x = a.x + 1 left join regions d on d.frame_id = a.frame_id and d.region = a.region and d.y = a.y + 1 and d.x = a.x
  left join regions q on q.frame_id = a.frame_id and q.region = a.region and q.y = a.y + 1 and q.x = a.x + 1 group by all)
select frame_id, region, n_pixels, (4 * n_pixels - 2 * pairs)::bigint as perimeter, (2 - (n_pixels - pairs + fours))::integer as n_rings, n_pixels::double as area from own"""


def _outlined(own):
    """Regions as polygons, by what their rings enclose and how long they are; a region has a ring for itself and one for each hole."""
    closed = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    outline = F.aggregate("rings", F.lit(0.0), lambda s, ring: s + v.length(closed(ring)))
    sizes = F.transform("rings", g.area)
    return own.select("frame_id", F.col("region").cast("int").alias("region"), "n_pixels", F.round(outline).cast("long").alias("perimeter"), F.size("rings").alias("n_rings"), (2 * F.get(sizes, F.lit(0)) - F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)).alias("area"))


@query(OUTLINES)
def mask_polygons(spark, sf_dir):
    return _outlined(rs.outlines(rs.regions(tb.pixels(spark, sf_dir), F.col("value") > 50, 8)))


def _files(spark, sf_dir):
    """The frames as raster files in the shared folder, and where they are."""
    folder = shared.new_path(spark, "rasters")
    ground = F.struct(*[F.lit(x).alias(k) for k, x in zip("abcdef", (250.0, 0.0, 0.0, 0.0, -250.0, 0.0), strict=True)])
    frames = tb.frames(spark, sf_dir).select(F.col("frame_id").alias("name"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.col("band").cast("array<double>").alias("band"), ground.alias("transform"), F.lit(3067).alias("crs"))
    src.write_rasters(frames, folder, tile=16)
    return folder


@query(OUTLINES)
def raster_polygons(spark, sf_dir):
    """The same from files: written in LZW tiles, read block by block."""
    pixels = src.pixels_of(src.read_tiles(spark, _files(spark, sf_dir))).withColumn("frame_id", F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long"))
    return _outlined(rs.outlines(rs.regions(pixels, F.col("value") > 50, 8)))


#: A crop of six pixels a side, 1,500 m, ahead of (700, -1,700) in the direction (0.6, 0.8), over the frames' edge.
CROP = """c as (select 0.8 * 250 as a, -0.6 * 250 as b, 700 + 0.6 * 750 - 0.8 * 750 + 0.6 * 750 as c, -0.6 * 250 as d, -0.8 * 250 as e, -1700 + 0.8 * 750 + 0.6 * 750 + 0.8 * 750 as f)"""


@query(f"""{PX}, {CROP}, o as (select r.r::integer as row, q.q::integer as col, (a * (q.q + 0.5) + b * (r.r + 0.5) + c) / 250 as u, (d * (q.q + 0.5) + e * (r.r + 0.5) + f) / -250 as v from c, range(0, 6) r(r), range(0, 6) q(q)),
n as (select *, floor(v - 0.5) + i as y, floor(u - 0.5) + j as x, abs(1 - i - (v - 0.5 - floor(v - 0.5))) * abs(1 - j - (u - 0.5 - floor(u - 0.5))) as w from o, range(0, 2) t(i), range(0, 2) s(j) where u between 0 and 8 and v between 0 and 8),
m as (select p.frame_id, n.row, n.col, sum(w * value) / sum(w) as value from n join pixels p on p.row = n.y and p.col = n.x where w > 0 group by all)
select f.frame_id as crop_id, o.row, o.col, round(coalesce(m.value, 0), 4) as value from (select distinct frame_id from pixels) f cross join o left join m on m.frame_id = f.frame_id and m.row = o.row and m.col = o.col""")
def resampled_crop(spark, sf_dir):
    """Rotated crops of raster files by bilinear weights; what is off the raster is 0."""
    folder = _files(spark, sf_dir)
    known = src.read_rasters(spark, folder)
    transform = bx.raster_transform(v.point(700, -1_700), v.point(0.6, 0.8), F.lit("center"), 1_500.0, 6)
    crops = known.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("crop_id"), "path", transform.alias("transform"), F.lit(6).alias("rows"), F.lit(6).alias("cols"))
    return rounded(rs.resampled(src.pixels_of(src.read_tiles(spark, folder)), known, crops), 4)


@query(f"{PX} select frame_id, min(col) as xmin, min(row) as ymin, max(col) + 1 as xmax, max(row) + 1 as ymax, count(*) as n from pixels where value > 100 group by 1")
def mask_bounds(spark, sf_dir):
    return tb.pixels(spark, sf_dir).filter("value > 100").groupBy("frame_id").agg(F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"), F.count("*").alias("n"))


@query()
def augmented_frames(spark, sf_dir):
    """Each frame and three rotations, by seeded angles."""
    return rs.rotated(tb.frames(spark, sf_dir), 8, ((60, 120), (150, 210), (240, 300))).select("frame_id", "k", "angle", F.aggregate("band", F.lit(0), lambda s, x: s + x).alias("total"))


def _sequences(spark, sf_dir):
    f = tb.frames(spark, sf_dir).withColumn("sequence_id", F.floor(F.col("frame_id") / 20))
    return rs.sequences(f, 6), f


@query()
def nowcast(spark, sf_dir):
    """Six frames in, two out, by a seeded convolutional GRU."""
    s, _ = _sequences(spark, sf_dir)
    return rs.nowcast(s, 8, 2, "ConvGRU").select("frame_id", "step", F.round(F.aggregate("band", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""with f as (select vec_id, [round(embedding[i]::double * 1000) for i in range(1, 65)] as b from embeddings),
p as (select a.vec_id as frame_id, 1 as step, a.b, t.b as tb from f a join f t on t.vec_id = a.vec_id + 1 where a.vec_id % 20 >= 5)
select frame_id, step, round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(b, tb)]) / 64, 4) as mse from p""")
def persistence_errors(spark, sf_dir):
    s, f = _sequences(spark, sf_dir)
    return rounded(rs.errors(rs.nowcast(s, 8, 1, "Persistence"), f), 4)


@query("""with f as (select vec_id, [round(embedding[i]::double * 1000) for i in range(1, 65)] as b from embeddings),
p as (select a.vec_id as frame_id, a.b, t.b as tb from f a join f t on t.vec_id = a.vec_id + 1 where a.vec_id % 20 >= 5),
m as (select list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(b, tb)]) / 64 as mse from p)
select round(sqrt(avg(mse)), 5) as rmse, count(*) as n from m""")
def nowcast_rmse(spark, sf_dir):
    s, f = _sequences(spark, sf_dir)
    return rs.errors(rs.nowcast(s, 8, 1, "Persistence"), f).agg(F.round(F.sqrt(F.avg("mse")), 5).alias("rmse"), F.count("*").alias("n"))
