"""Overlays against areas by slabs, and their rings against what they must be."""

import math
import random
from fractions import Fraction as Fr

import pytest
from pyspark.sql import functions as F

from galewise.operators import overlay, spatial

POLYGONS = "grp int, obstacle_id int, polygon array<array<struct<x:double,y:double>>>, note string"
NONE = float("nan")


def box(a, b, c, d):
    return [[(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]]


def polygons(spark, rows):
    return spark.createDataFrame([(grp, i, p, "own") for grp, i, p in rows], POLYGONS)


def found(df, *keys):
    return {tuple(r[k] for k in keys): (r["area"], r["perimeter"], r["n_parts"], r["n_holes"]) for r in overlay.measures(df, list(keys)).collect()}


def spans(polygon, y):
    """Where a horizontal line inside no vertex meets the inside."""
    xs = []
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y):
                xs.append(Fr(ax) + (y - Fr(ay)) * (Fr(bx) - Fr(ax)) / (Fr(by) - Fr(ay)))
    xs.sort()
    return list(zip(xs[::2], xs[1::2], strict=True))


def area(plus, minus=()):
    """Area of the union of `plus` without `minus`, exactly: between heights of vertices and crossings the length of a line changes evenly."""
    edges = [(a, b) for p in (*plus, *minus) for ring in p for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    ys = {Fr(a[1]) for a, _ in edges}
    for (a, b), (c, d) in ((e, f) for i, e in enumerate(edges) for f in edges[:i]):
        rx, ry, sx, sy = *(Fr(b[k]) - Fr(a[k]) for k in (0, 1)), *(Fr(d[k]) - Fr(c[k]) for k in (0, 1))
        den = rx * sy - ry * sx
        if den:
            t = ((Fr(c[0]) - Fr(a[0])) * sy - (Fr(c[1]) - Fr(a[1])) * sx) / den
            if 0 <= t <= 1:
                ys.add(Fr(a[1]) + t * ry)
    total, ys = Fr(0), sorted(ys)
    for low, high in zip(ys, ys[1:], strict=False):
        y = (low + high) / 2
        marks = sorted([(x, k, d) for k, group in ((0, plus), (1, minus)) for p in group for a, b in spans(p, y) for x, d in ((a, 1), (b, -1))])
        depth, last = [0, 0], None
        for x, k, d in marks:
            if last is not None and depth[0] > 0 and depth[1] == 0:
                total += (x - last) * (high - low)
            depth[k] += d
            last = x
    return float(total)


def test_corners_holes_and_islands(spark):
    rows = [(1, 1, box(0, 0, 4, 4)), (1, 2, box(4, 4, 6, 6))]
    rows += [(2, k, b) for k, b in enumerate([box(0, 0, 10, 2), box(0, 8, 10, 10), box(0, 0, 2, 10), box(8, 0, 10, 10), box(4, 4, 6, 6)])]
    rows += [(3, 1, [*box(0, 0, 9, 9), *box(3, 3, 6, 6)]), (3, 2, box(4, 4, 5, 5)), (3, 3, box(2, 3, 4, 5))]
    rows += [(4, 1, box(0, 0, 1, 1)), (4, 2, box(0, 0, 1, 1)), (4, 3, box(1, 0, 2, 1)), (4, 2, box(0, 0, 1, 1))]
    rows += [(5, 1, None), (5, 2, [[(0.0, 0.0), (NONE, 1.0), (1.0, 1.0)]]), (5, 3, [[(0.0, 0.0), (5.0, 5.0)]]), (5, 4, []), (6, 1, [list(reversed(box(0, 0, 2, 3)[0]))])]
    got = found(overlay.dissolved(polygons(spark, rows), ["grp"], cell=3.0), "grp")
    assert got == {(1,): (20.0, 24.0, 2, 0), (2,): (68.0, 72.0, 2, 1), (3,): (75.0, 50.0, 1, 1), (4,): (2.0, 6.0, 1, 0), (6,): (6.0, 10.0, 1, 0)}


def test_rings_run_the_way_they_should(spark):
    rows = [(1, 1, [*box(0, 0, 9, 9), *box(3, 3, 6, 6)])]
    (r,) = overlay.dissolved(polygons(spark, rows), ["grp"], cell=3.0).collect()
    turn = lambda ring: sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert turn(r["polygon"][0]) == 162 and turn(r["polygon"][1]) == -18
    assert [len(x) for x in r["polygon"]] == [4, 4]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_areas_of_random_shapes(spark, seed):
    rng = random.Random(seed)
    at = lambda: (float(rng.randrange(0, 40)), float(rng.randrange(0, 40)))
    rows = []
    for grp in range(6):
        for k in range(rng.randrange(2, 9)):
            if rng.random() < 0.5:
                (a, b), w, h = at(), rng.randrange(3, 15), rng.randrange(3, 15)
                rows.append((grp, k, [*box(a, b, a + w, b + h), *([] if rng.random() < 0.5 else box(a + 1, b + 1, a + w - 1, b + h - 1))]))
            else:
                p = [at() for _ in range(3)]
                if (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) != (p[1][1] - p[0][1]) * (p[2][0] - p[0][0]):
                    rows.append((grp, k, [p]))
    df = polygons(spark, rows)
    got = found(overlay.dissolved(df, ["grp"], cell=rng.choice([4.0, 11.0, 100.0])), "grp")
    for grp in range(6):
        assert got[grp,][0] == pytest.approx(area([p for g, _, p in rows if g == grp]), abs=1e-3)
    takers = df.select("grp", F.col("obstacle_id").alias("taker_id"), "polygon").filter("taker_id % 2 = 1")
    left = found(overlay.difference(df.filter("obstacle_id % 2 = 0"), takers, ["grp"], cell=9.0), "grp", "obstacle_id")
    for g, k, p in rows:
        if k % 2 == 0:
            want = area([p], [q for h, j, q in rows if h == g and j % 2])
            assert left.get((g, k), (0.0,))[0] == pytest.approx(want, abs=1e-3)


def test_difference_cuts_a_hole_and_covers(spark):
    own = polygons(spark, [(1, 1, box(0, 0, 4, 4)), (1, 2, box(10, 10, 12, 12)), (1, 3, box(20, 0, 21, 1)), (2, 1, box(0, 0, 4, 4))])
    takers = spark.createDataFrame([(1, 7, box(1, 1, 2, 2)), (1, 8, box(3, 3, 13, 13)), (1, 7, box(1, 1, 2, 2))], "grp int, taker_id int, polygon array<array<struct<x:double,y:double>>>")
    got = found(overlay.difference(own, takers, ["grp"], cell=5.0), "grp", "obstacle_id")
    assert got == {(1, 1): (14.0, 20.0, 1, 1), (1, 3): (1.0, 4.0, 1, 0), (2, 1): (16.0, 16.0, 1, 0)}


def test_buffers(spark):
    df = polygons(spark, [(1, 1, box(0, 0, 4, 4)), (1, 2, [[(0.0, 0.0), (8.0, 0.0), (0.0, 6.0)]])])
    got = found(overlay.buffered(df, ["grp"], 1.0, cell=5.0), "grp", "obstacle_id")
    circle = 16 * math.sin(math.pi / 16)
    assert got[1, 1] == (pytest.approx(16 + 16 + circle, abs=1e-4), pytest.approx(16 + 64 * math.sin(math.pi / 32), abs=1e-4), 1, 0)
    assert got[1, 2][2:] == (1, 0) and 24 + 24 + circle - 0.1 < got[1, 2][0] < 24 + 24 + math.pi


def test_no_polygons(spark):
    assert overlay.dissolved(polygons(spark, []), ["grp"]).count() == 0


def test_a_diagonal_takes_only_the_cells_it_crosses(spark):
    line = spark.createDataFrame([(1, 0.5, 0.5, 99.5, 99.5), (2, 0.0, 5.5, 100.0, 5.5)], "k int, ax double, ay double, bx double, by double")
    n = {r["k"]: r["n"] for r in overlay.line_cells(line, 1.0).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert n[1] < 310 and n[2] <= 101
    assert spatial.with_cells(line.withColumn("xmin", F.lit(0.5)).withColumn("xmax", F.lit(99.5)).withColumn("ymin", F.lit(0.5)).withColumn("ymax", F.lit(99.5)), 1.0).count() == 20_000


def test_a_difference_leaves_out_what_one_taker_covers(spark):
    """Takers in a pile: cells inside of one are found, a hole is none, and what is left at the rim of the pile is as before."""
    own = [(1, 1, box(0, 0, 40, 40)), (1, 2, box(5, 5, 9, 9)), (1, 3, [*box(0, 0, 40, 40), *box(1, 1, 38, 38)])]
    pile = [(1, k, box(3 + k % 4, 2 + k % 5, 30 + k % 4, 31 + k % 3)) for k in range(12)] + [(1, 50, [*box(32, 32, 60, 60), *box(35, 35, 37, 37)])]
    takers = polygons(spark, pile).select("grp", F.col("obstacle_id").alias("taker_id"), "polygon")
    cells = {(r["cx"], r["cy"]) for r in overlay.covered_cells(takers, ["grp"], 2.0).collect()}
    assert (5, 5) in cells and (20, 20) in cells and not cells & {(17, 17), (18, 18), (0, 0), (16, 16), (16, 10)}
    got = found(overlay.difference(polygons(spark, own), takers, ["grp"], cell=16.0), "grp", "obstacle_id")
    assert set(got) == {(1, 1), (1, 3)}
    for _, k, p in (own[0], own[2]):
        assert got[1, k][0] == pytest.approx(area([p], [q for _, _, q in pile]), abs=1e-3)


def test_union_makes_no_crossings_inside(spark, monkeypatch):
    """Many boxes on one place: edges that run inside the union are left out before they meet."""
    boxes = [(k, [[{"x": float(x), "y": float(y)} for x, y in ((a, b), (a + 100, b), (a + 100, b + 100), (a, b + 100))]]) for k, (a, b) in enumerate((13 * i % 57, 29 * i % 61) for i in range(120))]
    rows = spark.createDataFrame([(1, k, p) for k, p in boxes], "t int, obstacle_id int, polygon array<array<struct<x:double,y:double>>>")
    made = []
    real = overlay.written
    monkeypatch.setattr(overlay, "written", lambda df, name: (out := real(df, name), made.append((name, out[0].count())))[0])
    got = overlay.measures(overlay.dissolved(rows, ["t"], cell=100.0), ["t"]).collect()
    covered = {(x, y) for _, p in boxes for x in range(int(p[0][0]["x"]), int(p[0][2]["x"])) for y in range(int(p[0][0]["y"]), int(p[0][2]["y"]))}
    outline = sum((x + dx, y + dy) not in covered for x, y in covered for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert [(r["area"], r["perimeter"]) for r in got] == [(len(covered), outline)]
    pieces = dict(made)["pieces"]
    assert pieces < 120 * 4 * 8, made  # all crossings of all edges would make over 12,000
