"""Points, vectors and paths as column expressions. A point is struct<x,y>, a path an array of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 1e-6


def point(x, y) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def within(a: Column, b: Column, reach: float) -> Column:
    return distance(a, b) <= reach


def unit_direction(a: Column, b: Column) -> Column:
    """Direction from a to b; (0, 0) where they are one point."""
    d = distance(a, b)
    return point(F.when(d > 0, (b["x"] - a["x"]) / d).otherwise(0.0), F.when(d > 0, (b["y"] - a["y"]) / d).otherwise(0.0))


def normalized(v: Column) -> Column:
    """Unit vector; null where there is no direction."""
    d = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])
    return F.when(d > LEAST, point(v["x"] / d, v["y"] / d))


def moved(p: Column, direction: Column, by) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return point(p["x"] + direction["x"] * by, p["y"] + direction["y"] * by)


def heading(a: Column, b: Column) -> Column:
    """Degrees from the x axis."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def turn(a: Column, b: Column, c: Column) -> Column:
    """Angle at b in degrees, 180 where a leg has no length."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    n = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / n))))).otherwise(180.0)


def legs(path: Column) -> Column:
    """Array of (a, b) for consecutive points; empty below two points."""
    n = F.size(path)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(
        F.zip_with(F.slice(path, 1, F.greatest(n - 1, F.lit(1))), F.slice(path, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def length(path: Column) -> Column:
    return F.aggregate(legs(path), F.lit(0.0), lambda s, leg: s + distance(leg["a"], leg["b"]))


def last_direction(path: Column) -> Column:
    """Unit vector of the last leg that has a length; null where there is none."""
    with_length = F.filter(legs(path), lambda leg: distance(leg["a"], leg["b"]) > LEAST)
    return let(with_length, lambda f: F.when(F.size(f) > 0, unit_direction(F.element_at(f, -1)["a"], F.element_at(f, -1)["b"])))


def without_repeats(path: Column) -> Column:
    """The path without points equal to the one before."""
    return F.filter(path, lambda p, i: (i == 0) | (p != F.get(path, i - 1)))


def turns(path: Column) -> Column:
    """(angle, idx) at inner points, the sharpest first."""
    n = F.size(path)
    at = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(turn(F.get(path, i - 1), F.get(path, i), F.get(path, i + 1)).alias("angle"), i.alias("idx")))
    return F.when(n < 3, F.array().cast("array<struct<angle:double,idx:int>>")).otherwise(F.array_sort(at))


def interpolated(a: Column, b: Column, step: float) -> Column:
    """a and b with equal pieces of at most `step` between them."""
    d = distance(a, b)
    n = F.greatest(F.lit(1), F.ceil(d / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: point(a["x"] + (b["x"] - a["x"]) * i / n, a["y"] + (b["y"] - a["y"]) * i / n))


def densified(path: Column, step: float) -> Column:
    pieces = F.flatten(F.transform(legs(path), lambda leg: let(interpolated(leg["a"], leg["b"], step), lambda q: F.slice(q, 1, F.size(q) - 1))))
    return F.when(F.size(path) < 2, path).otherwise(F.concat(pieces, F.slice(path, -1, 1)))


def measured(path: Column) -> Column:
    """Array of (x, y, s) with the length so far."""
    start = F.struct(F.array().cast("array<struct<x:double,y:double,s:double>>").alias("out"), F.lit(0.0).alias("s"), F.element_at(path, 1).alias("p"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["s"] + distance(acc["p"], p)
        return F.struct(F.concat(acc["out"], F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"), s.alias("s")))).alias("out"), s.alias("s"), p.alias("p"))

    return F.aggregate(path, start, step, lambda acc: acc["out"])


def _at(marked: Column, s: Column) -> Column:
    """Point at length s of a measured path, clamped to its ends."""
    after = F.filter(marked, lambda q: q["s"] >= s)
    before = F.filter(marked, lambda q: q["s"] < s)

    def between(a: Column, b: Column) -> Column:
        return point(a["x"] + (b["x"] - a["x"]) * (s - a["s"]) / (b["s"] - a["s"]), a["y"] + (b["y"] - a["y"]) * (s - a["s"]) / (b["s"] - a["s"]))

    as_point = lambda q: point(q["x"], q["y"])
    return F.when(F.size(before) == 0, as_point(F.element_at(marked, 1))).when(F.size(after) == 0, as_point(F.element_at(marked, -1))).otherwise(between(F.element_at(before, -1), F.element_at(after, 1)))


def substring(path: Column, start, end) -> Column:
    """The part of a path between two lengths; inner points stay."""
    start, end = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))

    def cut(marked: Column) -> Column:
        inner = F.transform(F.filter(marked, lambda q: (q["s"] > start) & (q["s"] < end)), lambda q: point(q["x"], q["y"]))
        return F.concat(F.array(_at(marked, start)), inner, F.array(_at(marked, end)))

    return let(measured(path), cut)


def pieces(path: Column, most: float) -> Column:
    """The path in parts of at most `most` along it, in order. A path below two points is one part."""
    total = length(path)
    n = F.greatest(F.lit(1), F.ceil(total / most)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: substring(path, i * F.lit(float(most)), F.least((i + 1) * F.lit(float(most)), total)))
    return F.when((F.size(path) < 2) | (total == 0), F.array(path)).otherwise(cut)


def point_at(path: Column, s: float) -> Column:
    """(point, rest): the point after exactly s along the path and the path from there on; null where the path is shorter."""
    total = length(path)
    return F.when(total >= s, F.struct(let(measured(path), lambda m: _at(m, F.lit(float(s)))).alias("point"), substring(path, s, total).alias("rest")))


def smoothed_at(path: Column, i: Column, tolerance: float) -> Column:
    """The path with point i (from 0, an inner one) replaced by a point `tolerance` before it and one after it, each only where that
    neighbour is farther away."""
    a, b, c = F.get(path, i - 1), F.get(path, i), F.get(path, i + 1)
    none = F.array().cast("array<struct<x:double,y:double>>")
    first = F.when(distance(a, b) > tolerance, F.array(moved(b, unit_direction(a, b), -tolerance))).otherwise(none)
    second = F.when(distance(b, c) > tolerance, F.array(moved(b, unit_direction(b, c), tolerance))).otherwise(none)
    return F.when((i > 0) & (i < F.size(path) - 1), F.concat(F.slice(path, 1, i), first, second, F.slice(path, i + 2, F.size(path))))


def thinned(path: Column, least: float) -> Column:
    """The path without points closer than `least` to the last one kept."""
    start = F.slice(path, 1, 1)
    return F.aggregate(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), start, lambda kept, p: F.when(distance(F.element_at(kept, -1), p) >= least, F.concat(kept, F.array(p))).otherwise(kept))


def step_of(s: Column, step: float, n: Column) -> Column:
    """Slot in which a length along a path is flown."""
    return F.least(F.floor(s / step), n - 1)
