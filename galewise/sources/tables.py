"""Views of the driver's tables as the engine's: results, observations, points, obstacles and frames. Each has its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENT = 1_000_000  # metres for one unit of an embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: algorithm, subject_id, window_size 0..6, length, success; one for each key."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("algorithm"), F.col("user_id").alias("subject_id"), (F.col("event_id") % 7).cast("int").alias("window_size"), "value")
    return e.groupBy("algorithm", "subject_id", "window_size").agg(F.round(F.avg("value"), 6).alias("length")).withColumn("success", F.col("length") > 50)


RUNS = """runs as (select event_type as algorithm, user_id as subject_id, (event_id % 7)::integer as window_size,
  round(avg(value), 6) as length, round(avg(value), 6) > 50 as success from events group by all)"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger result table: groups of lines by return flag and status, windows by line number."""
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("algorithm"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject_id"), F.col("l_linenumber").alias("window_size"), F.col("l_extendedprice").alias("length"))


PRICED = """priced as (select l_returnflag || '-' || l_linestatus as algorithm, l_orderkey * 10 + l_linenumber as subject_id,
  l_linenumber as window_size, l_extendedprice as length from lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times with their five-minute slot."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", F.window(F.col("ts").cast("timestamp_ntz"), "5 minutes")["start"].alias("slot"))


OBSERVATIONS = "observations as (select event_id, user_id, ts, event_type, value, time_bucket(interval '5 minutes', ts) as slot from events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on whole metres: id, x, y, label."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(e[0].cast("double") * EXTENT).alias("x"), F.round(e[1].cast("double") * EXTENT).alias("y"), "label")


POINTS = f"points as (select vec_id as id, round(embedding[1]::double * {EXTENT}) as x, round(embedding[2]::double * {EXTENT}) as y, label from embeddings)"


#: The class of points that stand for storms.
STORM = 0


def boxes(spark: SparkSession, sf_dir: str, half: int = 9_000) -> DataFrame:
    """An axis-aligned obstacle around each storm, valid at one of five time keys: obstacle_id, t_idx, bounds."""
    p = points(spark, sf_dir).filter(F.col("label") == STORM)
    return p.select(F.col("id").alias("obstacle_id"), (F.col("id") % 5).cast("int").alias("t_idx"), (F.col("x") - half).alias("xmin"), (F.col("y") - half).alias("ymin"), (F.col("x") + half).alias("xmax"), (F.col("y") + half).alias("ymax"))


def boxes_sql(half: int = 9_000) -> str:
    return f"boxes as (select id as obstacle_id, (id % 5)::integer as t_idx, x - {half} as xmin, y - {half} as ymin, x + {half} as xmax, y + {half} as ymax from points where label = {STORM})"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between points of consecutive ids: seg_id, ax, ay, bx, by."""
    p = points(spark, sf_dir)
    q = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return p.join(q, "id").select(F.col("id").alias("seg_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


SEGMENTS = "segments as (select p.id as seg_id, p.x as ax, p.y as ay, q.x as bx, q.y as yb from points p join points q on q.id = p.id + 1)"


def paths(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Paths of `size` points each: path_id and the ordered points."""
    p = points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("id") / size).alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("p")).select("path_id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("path"))


def paths_sql(size: int = 8) -> str:
    return f"path_points as (select id // {size} as path_id, id % {size} as i, id, x, y from points)"


def frames(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """Frames of side * side pixels in row order: frame_id and band, values times 1000 as whole numbers."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform(F.slice("embedding", 1, side * side), lambda v: F.round(v.cast("double") * 1000).cast("int")).alias("band"))


def pixels(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    return frames(spark, sf_dir, side).select("frame_id", F.posexplode("band").alias("at", "value")).select("frame_id", F.floor(F.col("at") / side).cast("int").alias("row"), (F.col("at") % side).cast("int").alias("col"), "value")


PIXELS = "pixels as (select vec_id as frame_id, ((i - 1) // 8)::integer as row, ((i - 1) % 8)::integer as col, round(embedding[i]::double * 1000)::integer as value from embeddings, range(1, 65) t(i))"
