"""Graphs as edge tables: components, window subgraphs, shortest paths of many graphs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.kernels import shapes, waves
from galewise.operators.ranks import numbered, with_before
from galewise.sources.shared import drop_path, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large-star and small-star rounds over written tables until nothing
    changes. The root is the smallest node."""
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after, new = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_path(spark, path)
        now, path = after, new
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, grp): the smallest member of each node's component; nodes without a pair are a group of their own."""
    found = components(pairs)
    return nodes.join(found, nodes.id == found.node, "left").select("id", F.coalesce("root", "id").alias("grp"))


def window_edges(valid: DataFrame, first: int, size: int) -> DataFrame:
    """Edges (i, j) valid at all keys of a window of key indices."""
    inside = valid.filter(F.col("t_idx").between(first, first + size - 1))
    return inside.groupBy("i", "j").agg(F.count_distinct("t_idx").alias("n")).filter(F.col("n") == size).select("i", "j")


def all_window_edges(valid: DataFrame, n_keys: int, size: int) -> DataFrame:
    """The same for all windows at once: each valid edge counts for the windows that hold its key."""
    spread = valid.select("i", "j", "t_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("t_idx") - size + 1), F.least(F.col("t_idx"), F.lit(n_keys - size)))).alias("window"))
    return spread.groupBy("window", "i", "j").agg(F.count_distinct("t_idx").alias("n")).filter(F.col("n") == size).select("window", "i", "j")


#: Nodes of a cell, and sources whose distances one task holds for a cell.
CELL, BLOCK = 1 << 17, 256


def cells_of(points: DataFrame, size: int = CELL) -> DataFrame:
    """(node, cell) of the points (id, x, y): strips along x, cut along y, of `size` points at most; points on one place are parted by their ids."""
    n = points.count()
    strips = max(1, round((n / size) ** 0.5))
    across = max(1, -(-n // strips))
    cut = -(-across // -(-across // size))
    strip = numbered(points.select("id", "x", "y"), ["x", "y", "id"], "_n").select("id", "x", "y", F.floor(F.col("_n") / across).alias("_strip"), F.lit(1).alias("_one"))
    placed = with_before(strip, ["_strip"], ["y", "x", "id"], {"_one": "_n"})
    return placed.select(F.col("id").alias("node"), (F.col("_strip") * (1 << 32) + F.floor(F.col("_n") / cut)).alias("cell"))


def distances_from(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000, cells: DataFrame | None = None, among: DataFrame | None = None, blocks: DataFrame | None = None, trace: bool = True) -> DataFrame:
    """(source, node, distance, and with `trace` before) over one graph too large for a task; before is the node that the distance comes from, null at the
    source itself. Edges (i, j, w) go both ways, their weights are not below 0, endless ones are no way; sources without edges reach themselves.
    `among` (node) keeps these nodes only. Sources are settled by `blocks` (node, cell), such as cells of BLOCK sources: those near each other go fast.

    Nodes lie in cells (node, cell), CELL nodes in the order of their names if none are given; any cells are right, and those with few arcs
    between them are fast. A task settles a cell for BLOCK sources. What falls at its border is offered to other cells, in as many rounds as
    shortest ways go from cell to cell; between rounds only the borders' distances are kept. In the end each cell is settled once from the
    offers that were taken. Distances are added up from the source on, arc by arc. An offer is taken if it is strictly less than what is known, so
    that ways of equal length end the rounds and no node comes from itself."""
    spark = edges.sparkSession
    if not edges.filter("w < 0 or w is null or isnan(w)").isEmpty():
        raise ValueError("weights are numbers from 0")
    kind, named = dict(edges.dtypes)["i"], dict(sources.dtypes)["source"]
    arcs = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.min("w").cast("double").alias("w")).filter("i <> j")
    own = sources.select("source").filter("source is not null").distinct()
    ends = edges.select(F.col("i").alias("node")).union(edges.select("j")).union(own.select(F.col("source").cast(kind))).filter("node is not null").distinct()
    if cells is None:
        nodes = numbered(ends, ["node"], "_n").select("node", F.floor(F.col("_n") / CELL).alias("cell"))
    else:
        nodes = ends.join(cells.groupBy("node").agg(F.min("cell").alias("cell")), "node", "left").select("node", F.coalesce("cell", F.lit(-1)).cast("long").alias("cell"))
    nodes, nodes_path = written(nodes, "cells")
    at = lambda name, cell: nodes.select(F.col("node").alias(name), F.col("cell").alias(cell))
    arcs, arcs_path = written(arcs.join(at("i", "ci"), "i").join(at("j", "cj"), "j"), "arcs")
    over = arcs.filter("ci <> cj").select("i", F.col("j").alias("_j"), "w", F.col("cj").alias("_cell"))
    asked = F.lit(waves.WANTED) if among is None else F.when(F.col("_asked"), waves.WANTED).otherwise(0)
    marked = nodes.join(over.select(F.col("i").alias("node"), F.lit(waves.BORDER).alias("_border")).distinct(), "node", "left")
    marked = marked if among is None else marked.join(among.select("node", F.lit(True).alias("_asked")).distinct(), "node", "left")
    marked = marked.select("cell", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("w"), (F.lit(waves.NODE) + F.coalesce("_border", F.lit(0)) + asked).alias("mark"))
    inner = arcs.filter("ci = cj").select(F.col("ci").alias("cell"), "i", "j", "w", F.lit(0).alias("mark"))
    packed = marked.unionByName(inner).groupBy("cell").agg(F.collect_list(F.struct("i", "j", "w", "mark")).alias("a"))
    packed, _ = written(packed.select("cell", *[F.col(f"a.{c}").alias(c) for c in ("i", "j", "w", "mark")]), "packed")

    if blocks is None:
        placed = numbered(own.join(at("source", "cell"), "source"), ["cell", "source"], "_n").withColumn("block", F.floor(F.col("_n") / BLOCK))
    else:
        placed = own.join(at("source", "cell"), "source").join(blocks.groupBy(F.col("node").alias("source")).agg(F.min("cell").alias("block")), "source", "left").withColumn("block", F.coalesce("block", F.lit(-1).cast("long")))
    key = ["cell", "block"]
    offers, offers_path = written(placed.select(*key, "source", F.col("source").cast(kind).alias("node"), F.lit(0.0).alias("distance"), F.col("source").cast(kind).alias("before")), "offers")
    result = f"source {named}, node {kind}, distance double, before {kind}"
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def settled(rows, schema):
        groups = rows.select(*key).distinct().join(packed, "cell").select(F.col("cell").alias("_c"), F.col("block").alias("_b"), "i", "j", "w", "mark")

        def run(name, own, arcs):
            if own.empty or arcs.empty:
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            a = arcs.iloc[0]
            return waves.step(own, waves.Cell(a["i"], a["j"], a["w"], a["mark"])).assign(cell=name[0], block=name[1])

        return rows.repartition(tasks, *key).groupBy(*key).cogroup(groups.repartition(tasks, "_c", "_b").groupBy("_c", "_b")).applyInPandas(run, schema)

    borders = not over.isEmpty()  # without them nothing is offered from cell to cell
    known, path = None if borders else offers.withColumn("start", F.lit(True)), None
    for _ in range(most_rounds if borders else 0):
        active = offers.select(*key, "source").distinct()
        rows = offers.withColumn("start", F.lit(False)).withColumn("offer", F.lit(True))
        if known is not None:
            rows = rows.unionByName(known.join(active, [*key, "source"], "left_semi").drop("fell").withColumn("offer", F.lit(False)))
        after = settled(rows, f"{result}, start boolean, fell boolean, cell long, block long")
        if known is not None:
            after = after.unionByName(known.join(active, [*key, "source"], "left_anti").withColumn("fell", F.lit(False)))
        now, new = written(after, "known")
        sent = now.filter("fell").join(over, F.col("node") == F.col("i")).groupBy(F.col("_cell").alias("cell"), "block", "source", F.col("_j").alias("node")).agg(F.min(F.struct((F.col("distance") + F.col("w")).alias("distance"), F.col("i").alias("before"))).alias("o"))
        held = now.select(*key, "source", "node", F.col("distance").alias("_d"))
        better = sent.join(held, [*key, "source", "node"], "left").filter((F.col("_d").isNull() | (F.col("o.distance") < F.col("_d"))) & (F.col("o.distance") < float("inf")))
        offers, offered = written(better.select(*key, "source", "node", "o.distance", "o.before"), "offers")
        for old in (path, offers_path):
            if old:
                drop_path(spark, old)
        known, path, offers_path = now, new, offered
        if not offers.head(1):
            break
    else:
        if borders:
            raise RuntimeError(f"distances still fall after {most_rounds} rounds")
    arrays = {c: dict(packed.dtypes)[c] for c in ("i", "j", "w", "mark")}
    starts = known.filter("start").select(*key, "source", "node", "distance", "before", *[F.array().cast(t).alias(c) for c, t in arrays.items()])
    graphs = starts.select(*key).distinct().join(packed, "cell").select(*key, F.lit(0).cast(named).alias("source"), F.lit(0).cast(kind).alias("node"), F.lit(0.0).alias("distance"), F.lit(0).cast(kind).alias("before"), *arrays)

    def finish(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, graph = [], None
        for rows in batches:
            own = rows["mark"].map(len) > 0
            if own.any():
                a = rows[own].iloc[0]
                graph = waves.Cell(a["i"], a["j"], a["w"], a["mark"])
            held.append(rows.loc[~own, ["source", "node", "distance", "before"]])
        if graph is not None:
            yield from waves.whole(pd.concat(held, ignore_index=True), graph, trace)

    found = starts.unionByName(graphs).repartition(tasks, *key).groupBy(*key).applyInPandas(finish, result if trace else result.rpartition(",")[0])
    for old in (nodes_path, arcs_path, *([offers_path] if borders else [])):
        drop_path(spark, old)
    return found.withColumn("before", F.when(F.col("before") != F.col("node"), F.col("before"))) if trace else found


#: Steps back that are joined in one job.
BACK = 8


def paths_back(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(source, target, distance, path) of the queries (source, target), read back from distances_from by joins, a step a join; queries without a way
    have no row. The path is an array of nodes from the source on."""
    found, _ = written(found, "found")
    steps = found.select("source", F.col("node").alias("at"), "before")
    front = queries.select("source", "target").distinct().join(found.select("source", F.col("node").alias("target"), "distance"), ["source", "target"])
    front, _ = written(front.withColumn("at", F.col("target")).withColumn("path", F.array("target")), "back")
    while front.filter("at <> source").head(1):
        for _ in range(BACK):
            met = front.join(steps, ["source", "at"], "left")
            front = met.select("source", "target", "distance", F.coalesce("before", "at").alias("at"), F.when(F.col("before").isNotNull(), F.concat(F.array("before"), F.col("path"))).otherwise(F.col("path")).alias("path"))
        front, _ = written(front, "back")
    return front.drop("at")


def _per_graph(points: DataFrame, schema: str, kernel) -> DataFrame:
    return points.groupBy("graph_id").applyInPandas(kernel, schema)


def delaunay(points: DataFrame) -> DataFrame:
    """(graph_id, i, j) over the points (graph_id, id, x, y) of each graph."""

    def run(key, own):
        own = own.sort_values("id")
        names = own["id"].tolist()
        return pd.DataFrame([(key[0], names[i], names[j]) for i, j in shapes.delaunay_edges(own[["x", "y"]].to_numpy())], columns=["graph_id", "i", "j"])

    return _per_graph(points, "graph_id long, i long, j long", run)


def clustered(points: DataFrame, reach: float, most_rounds: int = 10_000) -> DataFrame:
    """(graph_id, node_id, x, y, n): the centres of first-come clusters, numbered by (x, y), and how many places each has. In the order of (x, y) each
    place that isn't taken yet takes those within reach that aren't; points on one place are one.

    The places that take are those no smaller one of which is near: they are found in rounds, in which a place is settled once all smaller ones
    near it are. Cells are so small that places of one are near each other, so that in each only the first one that is left can take, and
    every place meets the first ones of 25 cells at most. Rounds are as many as the longest chain of places that wait for each other."""
    spark = points.sparkSession
    cell = reach / 2**0.5
    own = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select("graph_id", "x", "y").distinct()
    own, _ = written(own.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)), "places")
    key, place = ["graph_id", "cx", "cy"], F.struct("x", "y")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    spread = lambda df: df.withColumn("_o", F.explode(around)).withColumn("cx", F.col("cx") + F.col("_o.i")).withColumn("cy", F.col("cy") + F.col("_o.j")).drop("_o")
    near = F.hypot(F.col("x") - F.col("r.x"), F.col("y") - F.col("r.y")) <= reach
    left, path, centres = own, None, None
    for _ in range(most_rounds):
        if not left.head(1):
            break
        firsts = left.groupBy(*key).agg(F.min(place).alias("r"))
        met = left.join(spread(firsts), key).filter(near).select("graph_id", "x", "y", "r")
        free = met.groupBy("graph_id", "r").agg(F.bool_or(place < F.col("r")).alias("waits")).filter("not waits").drop("waits")
        free, _ = written(free, "centres")
        centres = free if centres is None else centres.unionByName(free)
        taken = left.join(spread(free.withColumn("cx", F.floor(F.col("r.x") / cell)).withColumn("cy", F.floor(F.col("r.y") / cell))), key).filter(near).select("graph_id", "x", "y").distinct()
        left, new = written(left.join(taken, ["graph_id", "x", "y"], "left_anti"), "left")
        if path:
            drop_path(spark, path)
        path = new
    else:
        raise RuntimeError(f"clusters are not found after {most_rounds} rounds")
    if centres is None:
        return own.select("graph_id", F.lit(0).cast("long").alias("node_id"), "x", "y", F.lit(0).cast("long").alias("n"))
    centres = centres.withColumn("cx", F.floor(F.col("r.x") / cell)).withColumn("cy", F.floor(F.col("r.y") / cell))
    owner = own.join(spread(centres), key).filter(near).groupBy("graph_id", "x", "y").agg(F.min("r").alias("r"))
    means = owner.groupBy("graph_id", "r").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    rows = with_before(means.select("graph_id", "x", "y", "n", F.lit(1).alias("_one"), F.col("r.x").alias("_rx"), F.col("r.y").alias("_ry")), ["graph_id"], ["x", "y", "_rx", "_ry"], {"_one": "node_id"})
    return rows.select("graph_id", F.col("node_id").cast("long").alias("node_id"), "x", "y", "n")


def hulls(points: DataFrame, kind: str = "convex", radius: float = 0.0) -> DataFrame:
    """(graph_id, ring) of each graph's points: convex, concave or buffered hulls."""
    if kind not in ("convex", "concave", "buffered"):
        raise ValueError(f"a hull is convex, concave or buffered, not {kind}")
    make = {"convex": shapes.convex_hull, "concave": shapes.concave_hull, "buffered": lambda p: shapes.buffered_hull(p, radius)}[kind]

    def run(key, own):
        ring = make(own[["x", "y"]].to_numpy())
        return pd.DataFrame({"graph_id": [key[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    return _per_graph(points, "graph_id long, ring array<struct<x:double,y:double>>", run)
