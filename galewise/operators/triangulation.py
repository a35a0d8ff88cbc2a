"""Delaunay edges of one graph too large for a task, by tiles.

Tiles are the cells of a tree that follows the density of points. A task triangulates a tile's points and those around it; circles around
triangles of the tile's own points that leave the tile are looked up in the tiles they touch, and of the points found in a circle the deepest
join the tile, which is triangulated again. Once no circle holds a point the triangles of the tile's own points are those of the whole graph.
What one task holds are a tile's points and their neighbours, or a tile's points and the circles that touch it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.kernels import triangles
from galewise.operators import quadtree as qt
from galewise.sources.shared import drop_path, written

#: Points of a tile.
TILE = 2_000
_TILE = ["_td", "_tx", "_ty"]


def _meets_disc(frame: qt.Frame):
    """Keeps circles in cells that they meet; cells at the frame's ends have no end."""

    def keep(rows: DataFrame) -> DataFrame:
        x0, y0, x1, y1 = qt.box_of(frame)
        gap = lambda m, lo, hi: F.greatest(F.lit(0.0), F.coalesce(lo - F.col(m), F.lit(0.0)), F.coalesce(F.col(m) - hi, F.lit(0.0)))
        return rows.filter(F.hypot(gap("mx", x0, x1), gap("my", y0, y1)) <= F.col("r"))

    return keep


def _on_one_line(own: DataFrame) -> bool:
    """Whether all points (id, x, y) are on one line, to the rounding of their coordinates."""
    ends = own.agg(F.count("*").alias("n"), F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b")).first()
    dx, dy = F.col("x") - F.lit(ends.a.x), F.col("y") - F.lit(ends.a.y)
    ux, uy = ends.b.x - ends.a.x, ends.b.y - ends.a.y
    size = (ux * ux + uy * uy) ** 0.5 or 1.0
    off = (dx * uy - dy * ux) / size
    aside, along = own.agg(F.sum(off * off), F.sum(dx * dx + dy * dy)).first()
    return aside**0.5 <= along**0.5 * ends.n * 2.0**-52


def delaunay_edges(points: DataFrame, bound: int = TILE, most_rounds: int = 10_000) -> DataFrame:
    """(i, j), i < j, of the Delaunay triangulation of the points (id, x, y). Of points on one place the first is joined; fewer than four points, and
    points on one line, give all pairs. Points without both coordinates take no part."""
    spark = points.sparkSession
    every, _ = written(qt.placed(points).select("id", "x", "y"), "points")
    if every.limit(4).count() < 4 or _on_one_line(every):
        return every.select(F.col("id").alias("i")).join(every.select(F.col("id").alias("j")), F.col("i") < F.col("j"))
    own = every.groupBy("x", "y").agg(F.min("id").alias("id"))
    at = own.select("id", "x", "y", *[F.col(c).alias(f"{c}{e}") for c in ("x", "y") for e in ("min", "max")])
    splits, frame = qt.splits_of(at, bound)
    tiles, _ = written(qt.touched(at, splits, frame).select(*qt.NODE, "id", "x", "y"), "tiles")
    x0, x1, y0, y1 = own.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    far = triangles.corners(x0, y0, x1, y1)

    named = [F.col(c).alias(t) for c, t in zip(qt.NODE, _TILE, strict=True)]
    elsewhere = ~(F.struct(*_TILE) == F.struct(*qt.NODE))
    ends = tiles.groupBy(*qt.NODE).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{e}") for c in ("x", "y") for e, f in (("min", F.min), ("max", F.max))])
    margin = F.least(3 * F.sqrt((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / F.col("n")), F.lit(frame.side) / F.pow(F.lit(2.0), F.col("_depth")) / 2)
    wide = ends.select(*named, *[(F.col(f"{c}{e}") + s * margin).alias(f"{c}{e}") for c in ("x", "y") for e, s in (("min", -1), ("max", 1))])
    around = qt.touched(wide, splits, frame).filter(elsewhere).join(tiles, qt.NODE).filter("x between xmin and xmax and y between ymin and ymax")
    members, path = written(tiles.select(*named, "id", "x", "y", F.lit(True).alias("own")).unionByName(around.select(*_TILE, "id", "x", "y", F.lit(False).alias("own"))), "members")

    def star(key, rows):
        size = frame.side / 2.0 ** int(key[0])
        little = size * 1e-9 + (abs(frame.x) + abs(frame.y)) * 1e-14
        left, low = frame.x + int(key[1]) * size, frame.y + int(key[2]) * size
        out = triangles.stars(rows, far, (left + little, low + little, left + size - little, low + size - little))
        return out.assign(**{t: int(k) for t, k in zip(_TILE, key, strict=True)})

    def search(circles, points):
        if circles.empty or points.empty:
            return pd.DataFrame(columns=[*_TILE, "a", "b", "c", "id", "x", "y", "depth"])
        found = triangles.deepest(circles, points)
        return pd.concat([circles[[*_TILE, "a", "b", "c"]].iloc[found["row"]].reset_index(drop=True), found.drop(columns="row")], axis=1)

    keys = "_td int, _tx long, _ty long"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # tables are small, tasks are long
    edges = None
    for _ in range(most_rounds):
        stars, told = written(members.repartition(tasks, *_TILE).groupBy(*_TILE).applyInPandas(star, f"{triangles.STARS}, {keys}"), "stars")
        circles = qt.touched(stars.filter("circle").drop("circle"), splits, frame, keep=_meets_disc(frame)).filter(elsewhere)
        met = circles.repartition(tasks, *qt.NODE).groupBy(*qt.NODE).cogroup(tiles.repartition(tasks, *qt.NODE).groupBy(*qt.NODE)).applyInPandas(search, f"{keys}, a long, b long, c long, id long, x double, y double, depth double")
        best = F.row_number().over(W.partitionBy(*_TILE, "a", "b", "c").orderBy(F.desc("depth"), "id"))
        found, new = written(met.withColumn("_n", best).filter(F.col("_n") <= triangles.TOLD).select(*_TILE, "id", "x", "y", F.lit(False).alias("own")).distinct(), "found")
        grown = found.select(*_TILE).distinct()
        done, _ = written(stars.filter("not circle").join(grown, _TILE, "left_anti").select(F.col("a").alias("i"), F.col("b").alias("j")), "edges")
        edges = done if edges is None else edges.unionByName(done)
        if not found.head(1):
            break
        after, grown_path = written(members.join(grown, _TILE, "left_semi").unionByName(found), "members")
        for old in (path, told, new):
            drop_path(spark, old)
        members, path = after, grown_path
    else:
        raise RuntimeError(f"circles still hold points after {most_rounds} rounds")
    return edges.distinct()
