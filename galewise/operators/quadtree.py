"""Cells that follow the density of points: a cell over its bound splits into sixteen, and only it.

Coordinates are numbered on a square grid of 2^52 steps a side around all points; a node of depth d is named by the first d bits of both
numbers, depths are even. Nodes are counted eight levels at a time: the deepest cells from the points below nodes that are over the bound, the
levels between from these cells. So points that crowd in a millionth of their bounds are told apart as those that are spread, and an outlier
costs some levels of one node each. Only points on one place, to 2^-52 of the bounds, can't be parted.

Searches go down the tree in rounds, all queries side by side: a node that is split is replaced by those of its sixteen that still count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.sources.shared import drop_path, written

BITS, STEP, LEVELS = 52, 2, 8
#: Points of a leaf.
BOUND = 64
NODE = ["_depth", "_nx", "_ny"]


@dataclass
class Frame:
    """The square that all points lie in."""

    x: float
    y: float
    side: float

    def number(self, v: Column, start: float) -> Column:
        """The step of the grid that a coordinate is in, those off the square at its ends."""
        at = F.floor((v - F.lit(start)) / self.side * float(1 << BITS))
        return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), at))

    def numbers(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.number(x, self.x), self.number(y, self.y)


def placed(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """rows with both coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.filter(finite(x) & finite(y))


def splits_of(rows: DataFrame, bound: int = BOUND) -> tuple[DataFrame, Frame]:
    """The nodes that split in a tree of the middles of rows with bounds (xmin..ymax), and their square."""
    middles = placed(rows.select(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y")))
    _, frame = frame_of(middles)
    frame = frame or Frame(0.0, 0.0, 1.0)
    return nodes(middles, frame, bound).filter("split").select(*NODE), frame


def frame_of(points: DataFrame) -> tuple[int, Frame | None]:
    """The number of points (id, x, y) and their square."""
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return n, Frame(x0, y0, max(x1 - x0, y1 - y0) or 1.0) if n else None


def _prefix(c: str, d: int) -> Column:
    return F.shiftright(c, BITS - d)


def nodes(points: DataFrame, frame: Frame, bound: int = BOUND) -> DataFrame:
    """(d, px, py, n, xmin, ymin, xmax, ymax, split) of the nodes that hold points (x, y), from the root to the leaves, with the bounds of the
    points in them; a written table."""
    ix, iy = frame.numbers(F.col("x"), F.col("y"))
    below = points.select("x", "y", ix.alias("ix"), iy.alias("iy"))
    out = None
    for deep in [*range(LEVELS, BITS, LEVELS), BITS]:
        top = (deep - 1) // LEVELS * LEVELS
        measures = [F.count("*").alias("n"), *[f(c).alias(f"{c}{e}") for e, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]]
        cells = below.groupBy(_prefix("ix", deep).alias("cx"), _prefix("iy", deep).alias("cy")).agg(*measures)
        depths = F.array(*[F.lit(d) for d in range(top + STEP if top else 0, deep + 1, STEP)])
        spread = cells.withColumn("_depth", F.explode(depths)).withColumn("_nx", F.expr(f"shiftright(cx, {deep} - _depth)")).withColumn("_ny", F.expr(f"shiftright(cy, {deep} - _depth)"))
        sums = spread.groupBy(*NODE).agg(F.sum("n").alias("n"), *[f(f"{c}{e}").alias(f"{c}{e}") for e, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])
        level, _ = written(sums.withColumn("split", (F.col("n") > bound) & (F.col("_depth") < BITS)), "nodes")
        parents = level.filter("split").select((F.col("_depth") + STEP).alias("_depth"), F.col("_nx").alias("ax"), F.col("_ny").alias("ay"))
        under = level.withColumn("ax", F.shiftright("_nx", STEP)).withColumn("ay", F.shiftright("_ny", STEP)).join(parents, ["_depth", "ax", "ay"], "left_semi").drop("ax", "ay")
        first = level.filter(F.col("_depth") == (top + STEP if top else 0))  # below nodes that are split, as all points here are
        kept = first.unionByName(under.filter(F.col("_depth") > (top + STEP if top else 0)))
        out = kept if out is None else out.unionByName(kept)
        over = level.filter(F.col("split") & (F.col("_depth") == deep)).select(F.col("_nx").alias("cx"), F.col("_ny").alias("cy"))
        if deep == BITS or over.isEmpty():
            break
        below = below.join(over, (_prefix("ix", deep) == F.col("cx")) & (_prefix("iy", deep) == F.col("cy")), "left_semi")
    return written(out, "tree")[0]


def leaf_rows(points: DataFrame, leaves: DataFrame, frame: Frame) -> DataFrame:
    """points with the leaf that each is in."""
    depths = sorted(r[0] for r in leaves.select("_depth").distinct().collect())  # BITS / STEP at most
    ix, iy = frame.numbers(F.col("x"), F.col("y"))
    own = points.withColumn("_ix", ix).withColumn("_iy", iy)
    at = F.array(*[F.struct(F.lit(d).alias("_depth"), _prefix("_ix", d).alias("_nx"), _prefix("_iy", d).alias("_ny")) for d in depths])
    return own.withColumn("_at", F.explode(at)).select(*points.columns, "_at.*").join(leaves.select(*NODE), NODE, "left_semi")


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, bound: int = BOUND) -> DataFrame:
    """(qid, id, d, place): the k nearest points (id, x, y) of each query (qid, x, y), ties by id; fewer where there are no more. Queries
    and points without both coordinates take no part.

    A query goes on with the nodes that may hold one of its nearest: those no farther than what is enough, the least distance within which
    nodes lie whole that hold k points. Of points on one place the k first can be among them, and one more where a query leaves itself out."""
    queries, points = placed(queries).select("qid", F.col("x").alias("qx"), F.col("y").alias("qy")), placed(points).select("id", "x", "y")
    want = k + 1 if exclude_self else k
    first = F.row_number().over(W.partitionBy("x", "y").orderBy("id"))
    points, _ = written(points.withColumn("_n", first).filter(F.col("_n") <= want).drop("_n"), "points")
    n, frame = frame_of(points)
    if not n or want < 1:
        return queries.join(points, F.lit(False)).select("qid", "id", F.lit(0.0).alias("d"), F.lit(1).alias("place"))
    tree = nodes(points, frame, bound)
    spark = points.sparkSession
    gap = lambda lo, hi, q: F.greatest(F.lit(0.0), F.col(lo) - F.col(q), F.col(q) - F.col(hi))
    far = lambda lo, hi, q: F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(hi) - F.col(q)))
    norm = lambda a, b: F.sqrt(a * a + b * b)
    width = [*NODE, "n", "split"]
    measured = [norm(gap("xmin", "xmax", "qx"), gap("ymin", "ymax", "qy")).alias("near"), norm(far("xmin", "xmax", "qx"), far("ymin", "ymax", "qy")).alias("far")]
    root = tree.filter("_depth = 0")
    front, path = written(queries.join(F.broadcast(root), F.lit(True)).select("qid", "qx", "qy", *width, *measured), "front")  # one row
    own = W.partitionBy("qid")
    while front.filter("split").head(1):
        below = tree.select(*width, "xmin", "ymin", "xmax", "ymax", (F.col("_depth") - STEP).alias("_d"), F.shiftright("_nx", STEP).alias("_px"), F.shiftright("_ny", STEP).alias("_py"))
        up = front.filter("split").select("qid", "qx", "qy", F.col("_depth").alias("_d"), F.col("_nx").alias("_px"), F.col("_ny").alias("_py"))
        split = up.join(below, ["_d", "_px", "_py"]).select("qid", "qx", "qy", *width, *measured)
        every = front.filter("not split").unionByName(split)
        held = every.withColumn("held", F.sum("n").over(own.orderBy("far", *NODE)))  # a query's nodes, some dozens
        enough = held.withColumn("enough", F.min(F.when(F.col("held") >= want, F.col("far"))).over(own))
        front, new = written(enough.filter("enough is null or near <= enough").drop("held", "enough"), "front")
        drop_path(spark, path)
        path = new
    at = leaf_rows(points, tree.filter("not split"), frame)
    met = front.select("qid", "qx", "qy", *NODE).join(at, NODE)
    if exclude_self:
        met = met.filter("qid <> id")
    met = met.select("qid", "id", norm(F.col("x") - F.col("qx"), F.col("y") - F.col("qy")).alias("d"))
    return met.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("d", "id"))).filter(F.col("place") <= k)


def touched(rows: DataFrame, splits: DataFrame, frame: Frame, grow: float = 0.0, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows (with bounds xmin..ymax, grown) for each cell (d, px, py) of the tree that they touch: the cells below nodes of `splits` (d, px, py)
    that aren't split themselves, with points or without. Rows without bounds touch none. `keep` filters the rows of each level, so that a long
    line goes down only where it runs, and not over all of its bounds."""
    low, high = frame.numbers(F.col("xmin") - grow, F.col("ymin") - grow), frame.numbers(F.col("xmax") + grow, F.col("ymax") + grow)
    bounded = rows.filter(F.col("xmin").isNotNull() & F.col("ymin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymax").isNotNull())
    names = ["_x0", "_y0", "_x1", "_y1"]
    front = bounded.select(*rows.columns, *[c.alias(n) for c, n in zip((*low, *high), names, strict=True)], F.lit(0).alias("_depth"), F.lit(0).cast("long").alias("_nx"), F.lit(0).cast("long").alias("_ny"))
    depths = sorted(r[0] for r in splits.select("_depth").distinct().collect())  # BITS / STEP at most
    done = None
    for deep in (d + STEP for d in depths):
        marks = splits.filter(F.col("_depth") == deep - STEP).select(*NODE, F.lit(True).alias("_split"))
        known, _ = written(front.join(marks, NODE, "left"), "front")
        leaves = known.filter("_split is null").select(*rows.columns, *NODE)
        done = leaves if done is None else done.unionByName(leaves)
        span = lambda lo, hi, p, deep=deep: F.sequence(F.greatest(_prefix(lo, deep), F.shiftleft(p, STEP)), F.least(_prefix(hi, deep), F.shiftleft(p, STEP) + (1 << STEP) - 1))
        down = known.filter("_split").drop("_split").withColumn("_px", F.explode(span("_x0", "_x1", "_nx"))).withColumn("_py", F.explode(span("_y0", "_y1", "_ny")))
        front = down.select(*rows.columns, *names, F.lit(deep).alias("_depth"), F.col("_px").alias("_nx"), F.col("_py").alias("_ny"))
        front = keep(front) if keep else front
    last = front.select(*rows.columns, *NODE)
    return last if done is None else done.unionByName(last)


def leaf_depths(splits: DataFrame) -> list[int]:
    """Depths that cells below `splits` can have."""
    return sorted({r[0] + STEP for r in splits.select("_depth").distinct().collect()}) or [0]  # BITS / STEP at most


def may_hold(rows: DataFrame, depths: list[int], frame: Frame, x: Column, y: Column) -> DataFrame:
    """rows for each cell of these depths that a place of theirs is in: one of them is the leaf, the others are no cells."""
    ix, iy = frame.numbers(x, y)
    at = rows.withColumn("_ix", ix).withColumn("_iy", iy)
    names = F.array(*[F.struct(F.lit(d).alias("_depth"), _prefix("_ix", d).alias("_nx"), _prefix("_iy", d).alias("_ny")) for d in depths])
    return at.withColumn("_at", F.explode(names)).select(*rows.columns, "_at.*")


def box_of(frame: Frame) -> list[Column]:
    """Bounds of a cell (d, px, py), a little grown; those at the frame's ends hold all beyond and have none."""
    size, last = F.lit(frame.side) / F.pow(F.lit(2.0), F.col("_depth")), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_depth")) - 1
    little = frame.side * 1e-12 + (abs(frame.x) + abs(frame.y)) * 1e-15
    out = []
    for c, start in (("_nx", frame.x), ("_ny", frame.y)):
        out += [F.when(F.col(c) > 0, start + F.col(c) * size - little), F.when(F.col(c) < last, start + (F.col(c) + 1) * size + little)]
    return [out[0], out[2], out[1], out[3]]


def first_common(a: str, b: str, frame: Frame, grow: float = 0.0) -> Column:
    """Whether this is the cell of the lower left corner of the two bounds' intersection."""
    return in_cell(a, frame, *[F.greatest(F.col(f"{a}.{k}min") - grow, F.col(f"{b}.{k}min") - grow) for k in ("x", "y")])


def in_cell(a: str, frame: Frame, x: Column, y: Column) -> Column:
    """Whether a place is in the cell of a row."""
    at = frame.numbers(x, y)
    cell = lambda v: F.call_function("shiftright", v, BITS - F.col(f"{a}._depth"))
    return (cell(at[0]) == F.col(f"{a}._nx")) & (cell(at[1]) == F.col(f"{a}._ny"))
