"""Union, difference and intersection of polygons by an arrangement of their edges.

Edges of one group meet on grid cells and are split where they cross or touch. Each piece learns how many polygons lie on its left and on
its right: those whose edge it is, by the side of their interior, and those that hold its middle. A piece bounds the result where one
side is inside it and the other is not, and runs with the inside on its left. At a vertex a piece goes on with the one that bounds the
same wedge of the inside, so that shapes which touch in a corner stay apart; rings are the cycles of that, and holes go to the smallest
shell around them.

Scale: groups are keys of joins, never one task. What one task holds are the edges of a group in one cell, and the crossings of one edge. Rings
are found by doubling jumps over written tables, in as many rounds as the longest ring has binary digits. Coordinates are rounded to
`DIGITS` decimals, crossings too; on whole coordinates where edges cross in such points results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.functions import geometry as g
from galewise.functions.vectors import point
from galewise.operators.spatial import crosses_box, with_cells
from galewise.sources.shared import drop_path, written

DIGITS = 6
PIECE = ["px", "py", "qx", "qy"]


def _edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, poly, role, ring, k, ax, ay, bx, by) of edges with the interior on their left: shells run counter-clockwise, holes clockwise."""
    rings = polygons.select(*keys, "poly", "role", F.posexplode("polygon").alias("ring", "points"))
    turn = F.aggregate(g.edges(F.col("points")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    each = rings.withColumn("flip", (turn < 0) != (F.col("ring") > 0)).select(*keys, "poly", "role", "ring", "flip", F.posexplode(g.edges(F.col("points"))).alias("k", "e"))
    end = lambda c, other: F.when(F.col("flip"), F.col(f"e.{other[0]}.{c}")).otherwise(F.col(f"e.{other[1]}.{c}"))
    out = each.select(*keys, "poly", "role", "ring", "k", end("x", "ba").alias("ax"), end("y", "ba").alias("ay"), end("x", "ab").alias("bx"), end("y", "ab").alias("by"))
    return out.filter("ax <> bx or ay <> by")


def line_cells(segments: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell that a segment (ax, ay, bx, by) crosses, and not for the others of its bounds."""
    own = segments.withColumn("xmin", F.least("ax", "bx")).withColumn("xmax", F.greatest("ax", "bx")).withColumn("ymin", F.least("ay", "by")).withColumn("ymax", F.greatest("ay", "by"))
    little = cell * 1e-9  # rounding loses no cell
    boxed = with_cells(own, cell).select("*", F.struct(*[(F.col(c) * cell + v).alias(n) for c, v, n in (("cx", -little, "xmin"), ("cy", -little, "ymin"), ("cx", cell + little, "xmax"), ("cy", cell + little, "ymax"))]).alias("_cell"))
    return boxed.alias("_s").filter(crosses_box("_s", "_s._cell")).drop("_cell", "xmin", "xmax", "ymin", "ymax")


def _open(rows: DataFrame, covered: DataFrame | None) -> DataFrame:
    """rows (.., cx, cy) outside of covered cells."""
    return rows if covered is None else rows.join(covered, covered.columns, "left_anti")


def _split(edges: DataFrame, keys: list[str], cell: float, covered: DataFrame | None = None) -> DataFrame:
    """Pieces of edges between their ends and crossings, with the columns of PIECE in place of the ends."""
    name = ["poly", "ring", "k"]
    met = _open(line_cells(edges, cell), covered)
    a, b = met.alias("a"), met.alias("b")
    on = F.lit(True)
    for c in (*keys, "cx", "cy"):
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    other = (F.col("a.poly") != F.col("b.poly")) | (F.col("a.ring") != F.col("b.ring")) | (F.col("a.k") != F.col("b.k"))
    p = lambda s, e: point(F.col(f"{s}.{e}x"), F.col(f"{s}.{e}y"))
    swap = F.struct("b.ax", "b.ay", "b.bx", "b.by") < F.struct("a.ax", "a.ay", "a.bx", "a.by")  # both edges compute one crossing from the same one
    pick = lambda e, first: F.when(swap == F.lit(first), p("b", e)).otherwise(p("a", e))
    both = a.join(b, on & other).select(*[F.col(f"a.{c}").alias(c) for c in (*keys, *name)], p("a", "a").alias("a"), p("a", "b").alias("b"), p("b", "a").alias("c"), p("b", "b").alias("d"), pick("a", True).alias("e1"), pick("b", True).alias("e2"), pick("a", False).alias("f1"), pick("b", False).alias("f2"))
    col = F.col
    s1, s2 = g.cross(col("f1"), col("f2"), col("e1")), g.cross(col("f1"), col("f2"), col("e2"))
    s3, s4 = g.cross(col("e1"), col("e2"), col("f1")), g.cross(col("e1"), col("e2"), col("f2"))
    t = s1 / (s1 - s2)
    crossing = F.when((F.signum(s1) * F.signum(s2) < 0) & (F.signum(s3) * F.signum(s4) < 0), point(F.round(col("e1.x") + t * (col("e2.x") - col("e1.x")), DIGITS), F.round(col("e1.y") + t * (col("e2.y") - col("e1.y")), DIGITS)))
    touches = lambda v: F.when(g.on_segment(col(v), col("a"), col("b")), col(v))
    cuts = both.select(*keys, *name, F.explode(F.array_compact(F.array(crossing, touches("c"), touches("d")))).alias("v"))
    ends = edges.select(*keys, *name, F.explode(F.array(point(F.col("ax"), F.col("ay")), point(F.col("bx"), F.col("by")))).alias("v"))
    nodes = cuts.unionByName(ends).distinct().join(edges, [*keys, *name])
    along = (F.col("v.x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("v.y") - F.col("ay")) * (F.col("by") - F.col("ay"))
    order = W.partitionBy(*keys, *name).orderBy("_along", "v.x", "v.y")
    nodes = nodes.withColumn("_along", along)
    return nodes.withColumn("w", F.lead("v").over(order)).filter("w is not null").select(*keys, "poly", "role", F.col("v.x").alias("px"), F.col("v.y").alias("py"), F.col("w.x").alias("qx"), F.col("w.y").alias("qy"))


def _rounded(polygons: DataFrame) -> DataFrame:
    """Polygons whose coordinates are numbers, rounded."""
    finite = lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"])
    return polygons.filter(F.col("polygon").isNotNull() & F.forall(F.flatten("polygon"), finite)).withColumn("polygon", F.transform("polygon", lambda r: F.transform(r, lambda p: point(F.round(p["x"], DIGITS), F.round(p["y"], DIGITS)))))


def _bounded(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("_b", g.bounds(F.col("polygon"))).select("*", "_b.*").drop("_b")


#: Cells along a side of a wide cell: what one polygon covers is looked for in wide cells first, and in their parts where none does.
FINE = 8


def _parts(rows: DataFrame, cell: float) -> DataFrame:
    """rows (bounds, cx, cy of a wide cell that they touch) for each cell in it that they touch."""
    span = lambda lo, hi, c: F.sequence(F.greatest(F.floor(F.col(lo) / cell), F.col(c) * FINE), F.least(F.floor(F.col(hi) / cell), F.col(c) * FINE + (FINE - 1)))
    return rows.withColumn("_px", F.explode(span("xmin", "xmax", "cx"))).withColumn("_py", F.explode(span("ymin", "ymax", "cy"))).drop("cx", "cy").withColumnsRenamed({"_px": "cx", "_py": "cy"})


def _open_cells(rows: DataFrame, cell: float, covered: DataFrame | None) -> DataFrame:
    """A row for each cell that the bounds touch, without covered ones; rows go to wide cells first, and into their parts only where these aren't all
    covered."""
    if covered is None:
        return with_cells(rows, cell)
    by = [c for c in covered.columns if c not in ("cx", "cy")]
    wide = covered.groupBy(*by, F.floor(F.col("cx") / FINE).alias("cx"), F.floor(F.col("cy") / FINE).alias("cy")).agg(F.count("*").alias("_n")).filter(F.col("_n") == FINE * FINE).drop("_n")
    return _open(_parts(_open(with_cells(rows, cell * FINE), wide), cell), covered)


def covered_cells(polygons: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, cx, cy): the grid cells that lie strictly inside one of the polygons (keys, polygon), a written table. No bound of their union, nor of a
    difference that takes them away, runs through such a cell."""
    touched = with_cells(_bounded(_rounded(polygons)).select(*keys, "polygon", "xmin", "ymin", "xmax", "ymax"), cell * FINE)
    wide, _ = written(_full(touched, keys, cell * FINE), "covered")
    fine = _full(_parts(_open(touched, wide), cell), keys, cell)
    each = F.sequence(F.lit(0), F.lit(FINE - 1))
    inside = wide.withColumn("_i", F.explode(each)).withColumn("_j", F.explode(each)).select(*keys, (F.col("cx") * FINE + F.col("_i")).alias("cx"), (F.col("cy") * FINE + F.col("_j")).alias("cy"))
    return written(inside.unionByName(fine), "covered")[0]


def _full(rows: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, cx, cy), distinct, of rows (keys, polygon, bounds, cx, cy) whose polygon holds the cell strictly inside."""
    little = cell * 1e-6 + 10.0 ** (1 - DIGITS)
    inner = rows.withColumn("x0", F.col("cx") * cell - little).withColumn("y0", F.col("cy") * cell - little).withColumn("x1", (F.col("cx") + 1) * cell + little).withColumn("y1", (F.col("cy") + 1) * cell + little)
    inner = inner.filter("x0 > xmin and x1 < xmax and y0 > ymin and y1 < ymax")

    def apart(e):
        a, b = e["a"], e["b"]
        sides = [(b["x"] - a["x"]) * (F.col(y) - a["y"]) - (b["y"] - a["y"]) * (F.col(x) - a["x"]) for x in ("x0", "x1") for y in ("y0", "y1")]
        off = [F.greatest(a[c], b[c]) < F.col(f"{c}0") for c in ("x", "y")] + [F.least(a[c], b[c]) > F.col(f"{c}1") for c in ("x", "y")]
        return off[0] | off[1] | off[2] | off[3] | (F.least(*sides) > 0) | (F.greatest(*sides) < 0)

    middle = point((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    full = inner.filter(F.forall(g.all_edges(F.col("polygon")), apart) & g.strictly_inside(middle, F.col("polygon")))
    return full.select(*keys, "cx", "cy").distinct()


def arrangement(polygons: DataFrame, keys: list[str], cell: float, covered: DataFrame | None = None) -> DataFrame:
    """(keys, px, py, qx, qy, left0, right0, left1, right1): the pieces of all edges of a group, p before q, with the number of polygons of
    role 0 and of role 1 on their two sides. polygons has keys, poly, role and polygon.

    In `covered` cells (some of the keys, cx, cy) no crossings are made, and pieces whose middle is there are left out: what an edge is to the
    result changes only at places outside of them, so that a piece without such a place is all inside or none of it is."""
    whole = _rounded(polygons).select(*keys, "poly", "role", "polygon").dropDuplicates([*keys, "poly"])
    pieces = _split(_edges(whole, keys), keys, cell, covered)
    back = (F.col("qx") < F.col("px")) | ((F.col("qx") == F.col("px")) & (F.col("qy") < F.col("py")))
    turned = [F.when(back, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("qx", "px"), ("qy", "py"), ("px", "qx"), ("py", "qy"))]
    own = pieces.select(*keys, "poly", "role", *turned, (~back).cast("int").alias("left"), back.cast("int").alias("right"))
    own, _ = written(own.groupBy(*keys, *PIECE, "poly", "role").agg(F.max("left").alias("left"), F.max("right").alias("right")), "pieces")
    middles = own.select(*keys, *PIECE).distinct().withColumn("x", (F.col("px") + F.col("qx")) / 2).withColumn("y", (F.col("py") + F.col("qy")) / 2)
    at = _open(middles.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)), covered)
    met = at.join(_open_cells(_bounded(whole), cell, covered), [*keys, "cx", "cy"]).filter(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax")))
    inside = met.filter(g.strictly_inside(point(F.col("x"), F.col("y")), F.col("polygon"))).select(*keys, *PIECE, "poly", "role", F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right"))
    if covered is not None:
        own = own.join(at.select(*keys, *PIECE), [*keys, *PIECE], "left_semi")
    each = own.unionByName(inside).groupBy(*keys, *PIECE, "poly", "role").agg(F.coalesce(F.max("left"), F.lit(1)).alias("left"), F.coalesce(F.max("right"), F.lit(1)).alias("right"))
    sides = [F.coalesce(F.sum(F.when(F.col("role") == r, F.col(s))), F.lit(0)).alias(f"{s}{r}") for r in (0, 1) for s in ("left", "right")]
    return each.groupBy(*keys, *PIECE).agg(*sides)


#: What is inside, by the numbers of polygons of both roles.
INSIDE = {
    "union": lambda s: F.col(f"{s}0") + F.col(f"{s}1") > 0,
    "difference": lambda s: (F.col(f"{s}0") > 0) & (F.col(f"{s}1") == 0),
    "intersection": lambda s: (F.col(f"{s}0") > 0) & (F.col(f"{s}1") > 0),
}


def boundary(pieces: DataFrame, keys: list[str], inside: str) -> DataFrame:
    """(keys, px, py, qx, qy): the pieces that bound the result, with the inside on their left."""
    left, right = INSIDE[inside]("left"), INSIDE[inside]("right")
    turned = [F.when(left, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("px", "qx"), ("py", "qy"), ("qx", "px"), ("qy", "py"))]
    return pieces.filter(left != right).select(*keys, *turned)


def ring_rows(bound: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, points): the rings that directed pieces make up, without vertices where nothing turns; ring is unique."""
    spark = bound.sparkSession
    nodes, _ = written(bound.withColumn("id", F.monotonically_increasing_id()), "bound")
    a, b = nodes.alias("a"), nodes.alias("b")
    on = (F.col("a.qx") == F.col("b.px")) & (F.col("a.qy") == F.col("b.py"))
    for c in keys:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    rx, ry = F.col("a.px") - F.col("a.qx"), F.col("a.py") - F.col("a.qy")
    ox, oy = F.col("b.qx") - F.col("b.px"), F.col("b.qy") - F.col("b.py")
    turn = F.atan2(ry * ox - rx * oy, rx * ox + ry * oy)  # clockwise from the way back to the way on
    wedge = F.when(turn <= 0, turn + 2 * F.pi()).otherwise(turn)
    follows = a.join(b, on).groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("b.id"), wedge).alias("jump"))
    now, path = written(follows.select("id", "jump", F.col("id").alias("low"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("changed")), "jumps")
    reach = 1
    while now.filter("changed").head(1):
        then = now.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("low").alias("_low"), F.col("steps").alias("_steps"))
        less = F.col("_low") < F.col("low")
        step = now.join(then, "jump").select("id", F.col("_jump").alias("jump"), F.least("low", "_low").alias("low"), F.when(less, F.col("_steps") + reach).otherwise(F.col("steps")).alias("steps"), less.alias("changed"))
        now, new = written(step, "jumps")
        drop_path(spark, path)
        path, reach = new, reach * 2
    placed = now.select("id", F.col("low").alias("ring"), "steps").join(nodes, "id")
    # from the ring's first piece on: the one that is the first has no step to go, those after it ever fewer
    order = F.when(F.col("steps") == 0, F.lit(-1 << 62)).otherwise(-F.col("steps"))
    rings = placed.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("p"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    bends = lambda r: F.filter(r, lambda q, i: g.cross(F.get(r, (i + F.size(r) - 1) % F.size(r)), q, F.get(r, (i + 1) % F.size(r))) != 0)
    return rings.select(*keys, "ring", points.alias("points")).select(*keys, "ring", bends(F.col("points")).alias("points"))


def polygons_of(rings: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(keys, part, polygon) out of rings: a shell and its holes, which are those that run clockwise."""
    turn = F.aggregate(g.edges(F.col("points")), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    known, _ = written(rings.withColumn("turn", turn / 2), "rings")
    shells = known.filter("turn > 0").withColumn("_b", g.bounds(F.array("points"))).select(*keys, F.col("ring").alias("part"), F.col("points").alias("shell"), F.col("turn").alias("size"), "_b.*")
    first, second = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    holes = known.filter("turn < 0").select(*keys, "ring", "points", ((first["x"] + second["x"]) / 2).alias("x"), ((first["y"] + second["y"]) / 2).alias("y"))
    met = holes.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(with_cells(shells.drop("shell"), cell).join(shells.select(*keys, "part", "shell"), [*keys, "part"]), [*keys, "cx", "cy"])
    owner = met.filter(g.covered(point(F.col("x"), F.col("y")), F.array("shell"))).groupBy(*keys, "ring").agg(F.min_by("part", "size").alias("part"), F.first("points").alias("points"))
    own = owner.groupBy(*keys, "part").agg(F.array_sort(F.collect_list("points")).alias("holes"))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return shells.join(own, [*keys, "part"], "left").select(*keys, "part", F.concat(F.array("shell"), F.coalesce("holes", none)).alias("polygon"))


def overlay(polygons: DataFrame, keys: list[str], inside: str, cell: float = 100_000.0, covered: DataFrame | None = None, wide: float | None = None) -> DataFrame:
    """(keys, part, polygon) of the union, difference or intersection of the polygons (keys, poly, role, polygon) of each group; roles are 0
    and 1, and a difference takes those of role 1 away. Null polygons and those with a null or a NaN coordinate are left out, of equal names in a
    group one counts; rings without an area give nothing, and a group of nothing no row. `wide` is the width of the cells in which holes look for their
    shells, where these are much larger than a cell."""
    return polygons_of(ring_rows(boundary(arrangement(polygons, keys, cell, covered), keys, inside), keys), keys, wide or cell)


def dissolved(obstacles: DataFrame, keys: list[str], cell: float = 100_000.0) -> DataFrame:
    """(keys, part, polygon): the union of the obstacles (obstacle_id, polygon) of equal keys.

    Cells that one obstacle covers are left out first, so that edges meet along the union's bounds and not inside of it."""
    known = obstacles.select(*keys, F.col("obstacle_id").alias("poly"), F.lit(0).alias("role"), "polygon").dropDuplicates([*keys, "poly"])
    known, _ = written(known, "obstacles")
    fine = cell / FINE
    return overlay(known, keys, "union", fine, covered_cells(known, keys, fine), cell)


def difference(obstacles: DataFrame, takers: DataFrame, keys: list[str], cell: float = 100_000.0) -> DataFrame:
    """(keys, obstacle_id, part, polygon): what is left of each obstacle (keys, obstacle_id, polygon) without the takers (keys, taker_id,
    polygon) of equal keys. An obstacle that is covered has no row.

    Cells that one taker covers are found first, once for all obstacles of a key: obstacles go on with the other cells and with the takers there."""
    fine = cell / FINE
    covered = covered_cells(takers, keys, fine)
    a, b = _open_cells(_bounded(obstacles), fine, covered), _open_cells(_bounded(takers).withColumnRenamed("polygon", "other"), fine, covered)
    b = b.select(*keys, "taker_id", "other", "cx", "cy", *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    meets = (F.col("xmin") <= F.col("_xmax")) & (F.col("xmax") >= F.col("_xmin")) & (F.col("ymin") <= F.col("_ymax")) & (F.col("ymax") >= F.col("_ymin"))
    near = a.join(b, [*keys, "cx", "cy"]).filter(meets).select(*keys, "obstacle_id", F.concat(F.lit("t"), F.col("taker_id").cast("string")).alias("poly"), F.lit(1).alias("role"), F.col("other").alias("polygon")).dropDuplicates([*keys, "obstacle_id", "poly"])
    left = a.select(*keys, "obstacle_id", "polygon").dropDuplicates([*keys, "obstacle_id"])
    own = left.select(*keys, "obstacle_id", F.lit("o").alias("poly"), F.lit(0).alias("role"), "polygon")
    return overlay(own.unionByName(near), [*keys, "obstacle_id"], "difference", fine, covered)


def measures(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, perimeter, n_parts, n_holes) of polygons by their keys."""
    length = lambda ring: F.aggregate(g.edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    sums = lambda f: F.aggregate(F.transform("polygon", f), F.lit(0.0), lambda s, v: s + v)
    area = 2 * g.area(F.get("polygon", F.lit(0))) - sums(g.area)
    return parts.groupBy(*keys).agg(F.sum(area).alias("area"), F.sum(sums(length)).alias("perimeter"), F.count("*").alias("n_parts"), F.sum(F.size("polygon") - 1).alias("n_holes"))


def buffered(polygons: DataFrame, keys: list[str], reach: float, per_quarter: int = 8, cell: float = 100_000.0) -> DataFrame:
    """(keys, obstacle_id, part, polygon): each obstacle grown by `reach`: the union of itself, of a rectangle on both sides of each edge, and
    of a circle around each vertex, with `per_quarter` edges for each quarter of it."""
    by = [*keys, "obstacle_id"]
    edges = polygons.select(*by, F.posexplode(g.all_edges(F.col("polygon"))).alias("k", "e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    d = F.hypot(dx, dy)
    nx, ny = -dy / d * reach, dx / d * reach
    at = lambda end, s: point(F.col(f"e.{end}.x") + s * nx, F.col(f"e.{end}.y") + s * ny)
    sides = edges.filter(d > 0).select(*by, F.concat(F.lit("e"), F.col("k")).alias("poly"), F.array(F.array(at("a", 1), at("a", -1), at("b", -1), at("b", 1))).alias("polygon"))
    circle = F.transform(F.sequence(F.lit(0), F.lit(4 * per_quarter - 1)), lambda i: point(F.col("e.a.x") + reach * F.cos(i * F.pi() / (2 * per_quarter)), F.col("e.a.y") + reach * F.sin(i * F.pi() / (2 * per_quarter))))
    rounds = edges.select(*by, F.concat(F.lit("v"), F.col("k")).alias("poly"), F.array(circle).alias("polygon"))
    own = polygons.select(*by, F.lit("o").alias("poly"), "polygon")
    return overlay(own.unionByName(sides).unionByName(rounds).withColumn("role", F.lit(0)), by, "union", cell)
