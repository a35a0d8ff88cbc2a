"""From raster files to obstacles: masked pixels, regions, polygons on the ground, groups of near ones, and the union of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.functions import geometry as g
from galewise.operators import graphs, overlay
from galewise.operators import rasters as rs
from galewise.operators import spatial as sp
from galewise.sources import rasters as src

#: Strictly between these a pixel is part of a storm; obstacles are grown by so many metres, and grouped where they meet then.
LOW, HIGH, REACH = 100, 255, 25_000
#: No raster has as many columns.
SIDE = 1 << 24


def polygons(tiles: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(path, obstacle_id, n_pixels, polygon, xmin, ymin, xmax, ymax) of the regions of each raster whose blocks could be read."""
    known = tiles.filter("error is null").groupBy("path").agg(F.first("transform").alias("transform"))
    shapes = rs.outlines(rs.regions(src.pixels_of(tiles), rs.masked(F.col("value"), low, high), SIDE, "path"), ("path", "region"))
    ground = shapes.join(known, "path").select("path", F.col("region").alias("obstacle_id"), "n_pixels", rs.to_world(F.col("rings"), F.col("transform")).alias("polygon"))
    return ground.withColumn("_b", g.bounds(F.col("polygon"))).select("*", "_b.*").drop("_b")


def grouped(shapes: DataFrame, reach: float = REACH) -> DataFrame:
    """shapes and grp: the smallest obstacle of those that meet, one through the other, when each is grown by reach."""
    pairs = sp.close_pairs(shapes, 2 * reach, ["path"])
    own = F.struct("path", F.col("obstacle_id").alias("id"))
    found = graphs.components(pairs.select(F.struct("path", F.col("a").alias("id")).alias("a"), F.struct("path", F.col("b").alias("id")).alias("b")))
    return shapes.withColumn("node", own).join(found, "node", "left").withColumn("grp", F.coalesce("root.id", "obstacle_id")).drop("node", "root")


def obstacles(tiles: DataFrame, low: int = LOW, high: int = HIGH, reach: float = REACH, cell: float = 100_000.0) -> DataFrame:
    """(path, grp, part, polygon): the union of each group of a raster's storms, one row for each polygon that it is made of."""
    return overlay.dissolved(grouped(polygons(tiles, low, high), reach), ["path", "grp"], cell)
