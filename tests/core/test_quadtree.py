"""Cells that follow density: bounds of leaves, and the same answers as loops, with crowds, outliers and nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from galewise.operators import quadtree as qt
from galewise.operators import spatial as sp

NAN = float("nan")


def crowd(seed, n=400):
    """Nine in ten in a thousandth of the area, one far away, some on one place, and some without a place."""
    rng = random.Random(seed)
    out = [(rng.uniform(0, 30), rng.uniform(0, 30)) if rng.random() < 0.9 else (rng.uniform(0, 1e3), rng.uniform(0, 1e3)) for _ in range(n)]
    return [*out, (1e12, -1e12), *[(7.0, 7.0)] * 30, (None, 1.0), (2.0, None), (NAN, 3.0), (None, None)]


def there(p):
    return all(c is not None and not math.isnan(c) for c in p)


@pytest.mark.parametrize("bound", [4, 64])
def test_no_leaf_is_over_its_bound(spark, bound):
    own = crowd(1)
    points = qt.placed(spark.createDataFrame([(i, *p) for i, p in enumerate(own)], "id long, x double, y double"))
    n, frame = qt.frame_of(points)
    tree = qt.nodes(points, frame, bound)
    leaves = tree.filter("not split").collect()
    assert sum(r["n"] for r in leaves) == n == sum(map(there, own))
    assert all(r["n"] <= bound or (r["xmin"], r["ymin"]) == (r["xmax"], r["ymax"]) for r in leaves)
    assert qt.leaf_rows(points, tree.filter("not split"), frame).count() == n
    parents = {(r["_depth"], r["_nx"], r["_ny"]) for r in tree.filter("split").collect()}
    assert all(r["_depth"] == 0 or (r["_depth"] - 2, r["_nx"] >> 2, r["_ny"] >> 2) in parents for r in leaves)


@pytest.mark.parametrize(("k", "own"), [(1, False), (5, True), (1_000, True)])
def test_nearest_in_a_crowd(spark, k, own):
    points = crowd(2, 120)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, x double, y double")
    queries = df.filter("id % 3 = 0 or id > 115").withColumnRenamed("id", "qid")
    got = {}
    for r in qt.nearest(queries, df, k, own, bound=8).collect():
        got.setdefault(r["qid"], {})[r["place"]] = (r["d"], r["id"])
    for q, p in enumerate(points):
        if (q % 3 == 0 or q > 115) and there(p):
            want = sorted((math.sqrt((x - p[0]) ** 2 + (y - p[1]) ** 2), i) for i, (x, y) in ((i, o) for i, o in enumerate(points) if there(o)) if not (own and i == q))[:k]
            if k < 100:
                assert [got[q][i] for i in range(1, len(want) + 1)] == want
            else:
                assert len(got[q]) >= 40  # of points on one place the first ones are enough only for k
        else:
            assert q not in got


def test_no_points_and_one(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    one = spark.createDataFrame([(1, 5.0, 5.0)], "id long, x double, y double")
    q = one.withColumnRenamed("id", "qid")
    assert qt.nearest(q, none, 3).count() == 0 and qt.nearest(q, one, 3, True).count() == 0
    assert [tuple(r) for r in qt.nearest(q, one, 3).collect()] == [(1, 1, 0.0, 1)]


def shapes(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = (rng.randrange(0, 60), rng.randrange(0, 60)) if rng.random() < 0.8 else (rng.randrange(0, 2_000), rng.randrange(0, 2_000))
        w, h = (rng.randrange(0, 9), rng.randrange(0, 9)) if k % 20 else (900, 700)
        out.append((k, k % 2, float(x), float(y), float(x + w), float(y + h)))
    return [*out, (n, 0, 1e9, 1e9, 1e9 + 1, 1e9 + 1), (n + 1, 0, None, 1.0, 2.0, 3.0)]


OBSTACLES = "obstacle_id long, t_idx int, xmin double, ymin double, xmax double, ymax double"


@pytest.mark.parametrize("bound", [3, 500])
def test_joins_by_place(spark, bound):
    boxes = shapes(4, 120)
    b = spark.createDataFrame(boxes, OBSTACLES)
    good = [x for x in boxes if x[2] is not None]
    gap = lambda p, q: math.hypot(max(0, p[2] - q[4], q[2] - p[4]), max(0, p[3] - q[5], q[3] - p[5]))
    got = sorted((r["t_idx"], r["a"], r["b"]) for r in sp.close_pairs(b, 12.0, ["t_idx"], bound).collect())
    assert got == sorted((p[1], p[0], q[0]) for p in good for q in good if p[0] != q[0] and p[1] == q[1] and gap(p, q) <= 12)
    rng = random.Random(5)
    points = [(i, float(rng.randrange(0, 80)), float(rng.randrange(0, 80))) for i in range(150)] + [(150, 1e9, 1e9), (151, None, 0.0), (152, -5e9, 3.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    for closed in (True, False):
        got = sorted((r["id"], r["obstacle_id"]) for r in sp.points_inside(p, b, closed, bound).collect())
        inside = lambda q, x: x[2] <= q[1] <= x[4] and x[3] <= q[2] <= x[5] if closed else x[2] < q[1] < x[4] and x[3] < q[2] < x[5]  # noqa: B023, E731
        assert got == sorted((q[0], x[0]) for q in points for x in good if q[1] is not None and inside(q, x))
    lines = [(i, i % 2, *(float(rng.randrange(-100, 2_000)) for _ in range(4))) for i in range(80)] + [(80, 0, -1e10, -1e10, 2e10, 2e10), (81, 0, None, 1.0, 2.0, 2.0), (82, 0, 5.0, 5.0, 5.0, 5.0)]
    lines += [lines[3]]
    s = spark.createDataFrame(lines, "seg_id long, t_idx int, ax double, ay double, bx double, by double")

    def hits(line, x):
        _, t, ax, ay, bx, by = line
        if t != x[1] or max(ax, bx) < x[2] or min(ax, bx) > x[4] or max(ay, by) < x[3] or min(ay, by) > x[5]:
            return False
        sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x[2], x[4]) for cy in (x[3], x[5])]
        return min(sides) <= 0 <= max(sides)

    got = sorted((r["seg_id"], r["obstacle_id"]) for r in sp.segment_hits(s, b, ["t_idx"], bound).collect())
    assert got == sorted((line[0], x[0]) for line in lines if line[2] is not None for x in good if hits(line, x)) and len(got) > 50


def test_lines_go_to_the_cells_they_cross(spark):
    """A diagonal over a fine tree touches few of its cells."""
    rng = random.Random(6)
    boxes = spark.createDataFrame([(i, 0, x, y, x + 1, y + 1) for i, (x, y) in enumerate((rng.uniform(0, 1e3), rng.uniform(0, 1e3)) for _ in range(2_000))], OBSTACLES)
    splits, frame = qt.splits_of(boxes, 4)
    line = sp.segment_bounds(spark.createDataFrame([(1, 0.0, 0.0, 1e3, 1e3)], "seg_id int, ax double, ay double, bx double, by double"))
    cells = qt.touched(line, splits, frame)
    assert sp.crossed(cells, frame).count() * 3 < cells.count()


def test_blocked_segments_and_visible_pairs_are_those_that_brute_force_finds(spark):
    rng = random.Random(8)
    boxes = [(k, k % 2, x, y, x + 6.0, y + 4.0) for k, (x, y) in enumerate((float(rng.randrange(0, 120)), float(rng.randrange(0, 120))) for _ in range(60))]
    lines = [(i, i % 2, *(float(rng.randrange(-20, 150)) for _ in range(4))) for i in range(300)] + [(300, 0, None, 1.0, 2.0, 2.0), (301, 0, 5.0, 5.0, 5.0, 5.0)]

    def meets(ax, ay, bx, by, x):
        if max(ax, bx) < x[2] or min(ax, bx) > x[4] or max(ay, by) < x[3] or min(ay, by) > x[5]:
            return False
        sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx in (x[2], x[4]) for cy in (x[3], x[5])]
        return min(sides) <= 0 <= max(sides)

    b = spark.createDataFrame(boxes, OBSTACLES)
    s = spark.createDataFrame(lines, "seg_id long, t_idx int, ax double, ay double, bx double, by double")
    for bound in (20, 500):
        got = sorted(r["seg_id"] for r in sp.blocked_segments(s, b, ["t_idx"], ["seg_id"], bound).collect())
        assert got == [line[0] for line in lines if line[2] is not None and any(x[1] == line[1] and meets(*line[2:], x) for x in boxes)] and 50 < len(got) < 290
    points = [(i, i % 3, float(rng.randrange(0, 150)), float(rng.randrange(0, 150))) for i in range(90)]
    seen = sp.visible_pairs(spark.createDataFrame(points, "id long, label int, x double, y double"), b.drop("t_idx"), "label")
    want = [(p[0], q[0]) for p in points for q in points if p[0] < q[0] and p[1] == q[1] and not any(meets(*p[2:], *q[2:], x) for x in boxes)]
    assert sorted((r["i"], r["j"]) for r in seen.collect()) == want and len(want) > 20


def test_pairs_of_segments_and_obstacles_are_not_held_to_be_told_apart(spark):
    """A pair that shares many cells is made once: no aggregate of pairs is in the plan."""
    boxes = spark.createDataFrame([(k, 0, float(k), 0.0, float(k) + 40, 40.0) for k in range(100)], OBSTACLES)
    lines = spark.createDataFrame([(1, 0, -5.0, -5.0, 200.0, 60.0)], "seg_id long, t_idx int, ax double, ay double, bx double, by double")
    hits = sp.segment_hits(lines, boxes, ["t_idx"], 3, carry=["xmin"])
    assert "Aggregate" not in hits._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["obstacle_id"], r["xmin"]) for r in hits.collect()]
    assert len(got) == len(set(got)) == 100 and all(k == x for k, x in got)
