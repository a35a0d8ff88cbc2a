"""Predicates on segments, polygons and boxes as column expressions. A polygon is an array of rings, ring 0 the shell, others holes; rings are
closed or not. On whole coordinates the signs are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewise.functions.vectors import point


def cross(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a, b, c."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def on_segment(p: Column, a: Column, b: Column) -> Column:
    return (cross(a, b, p) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two closed segments have a point in common; touching counts."""
    s = lambda v: F.signum(v)
    proper = (s(cross(a, b, c)) * s(cross(a, b, d)) < 0) & (s(cross(c, d, a)) * s(cross(c, d, b)) < 0)
    return proper | on_segment(c, a, b) | on_segment(d, a, b) | on_segment(a, c, d) | on_segment(b, c, d)


def edges(ring: Column) -> Column:
    """Array of (a, b); the last point joins the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def all_edges(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, edges))


def on_boundary(p: Column, polygon: Column) -> Column:
    return F.exists(all_edges(polygon), lambda e: on_segment(p, e["a"], e["b"]))


def _odd_crossings(p: Column, polygon: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (F.when(b["y"] > a["y"], cross(a, b, p)).otherwise(-cross(a, b, p)) > 0)

    return F.size(F.filter(all_edges(polygon), crosses)) % 2 == 1


def strictly_inside(p: Column, polygon: Column) -> Column:
    """Inside and not on the boundary; holes are outside."""
    return ~on_boundary(p, polygon) & _odd_crossings(p, polygon)


def covered(p: Column, polygon: Column) -> Column:
    return on_boundary(p, polygon) | _odd_crossings(p, polygon)


def segment_meets_polygon(a: Column, b: Column, polygon: Column) -> Column:
    return F.exists(all_edges(polygon), lambda e: segments_meet(a, b, e["a"], e["b"])) | covered(a, polygon)


def box_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.array(F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax)))


def bounds(polygon: Column) -> Column:
    xs, ys = F.transform(F.flatten(polygon), lambda p: p["x"]), F.transform(F.flatten(polygon), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _point_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / n))).otherwise(0.0)
    ex, ey = p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def polygon_distance(p: Column, q: Column) -> Column:
    """Least distance of two polygons, 0 where they meet."""
    def of(e: Column, f: Column) -> Column:
        return F.when(segments_meet(e["a"], e["b"], f["a"], f["b"]), 0.0).otherwise(F.least(_point_segment(e["a"], f["a"], f["b"]), _point_segment(e["b"], f["a"], f["b"]), _point_segment(f["a"], e["a"], e["b"]), _point_segment(f["b"], e["a"], e["b"])))

    least = F.array_min(F.flatten(F.transform(all_edges(p), lambda e: F.transform(all_edges(q), lambda f: of(e, f)))))
    inside = covered(F.get(F.get(p, F.lit(0)), F.lit(0)), q) | covered(F.get(F.get(q, F.lit(0)), F.lit(0)), p)
    return F.when(inside, 0.0).otherwise(least)


def clipped(ring: Column, box: Column) -> Column:
    """A ring cut to a convex counter-clockwise box (Sutherland-Hodgman); empty where nothing is left."""
    def against(points: Column, e: Column) -> Column:
        n = F.size(points)

        def keep(p: Column, i: Column) -> Column:
            before = F.get(points, (i + n - 1) % n)
            sp, sb = cross(e["a"], e["b"], p), cross(e["a"], e["b"], before)
            t = sb / (sb - sp)
            cut = F.array(point(before["x"] + (p["x"] - before["x"]) * t, before["y"] + (p["y"] - before["y"]) * t))
            none = F.array().cast("array<struct<x:double,y:double>>")
            return F.when((sp >= 0) & (sb >= 0), F.array(p)).when(sp >= 0, F.concat(cut, F.array(p))).when(sb >= 0, cut).otherwise(none)

        return F.flatten(F.transform(points, keep))

    return F.aggregate(edges(box), ring, against)


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2

