"""Distances and paths of one graph, and first-come clusters, against loops."""

import heapq
import random

import numpy as np
import pandas as pd
import pytest

from galewise.kernels import shapes, waves
from galewise.operators import graphs


def nearest_ways(edges, source):
    near = {}
    for i, j, w in edges:
        near.setdefault(i, []).append((j, w))
        near.setdefault(j, []).append((i, w))
    done, queue = {}, [(0.0, source)]
    while queue:
        d, at = heapq.heappop(queue)
        if at not in done:
            done[at] = d
            for to, w in near.get(at, []):
                heapq.heappush(queue, (d + w, to))
    return done


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 0.25, 1.0, 2.5])) for _ in range(90)] + [(100, 101, 1.0)]
    df = spark.createDataFrame(edges, "i long, j long, w double")
    sources = [0, 5, 100, 999]
    found = graphs.distances_from(df, spark.createDataFrame([(s,) for s in [*sources, 0]], "source long"))
    got = {(r["source"], r["node"]): r["distance"] for r in found.collect()}
    assert got == {(s, n): d for s in sources for n, d in nearest_ways(edges, s).items()}
    wanted = [(s, t) for s in sources for t in range(0, 102, 3)] + [(0, 0)]
    least = {}
    for i, j, w in edges:
        least[i, j] = least[j, i] = min(w, least.get((i, j), w))
    paths = {(r["source"], r["target"]): r for r in graphs.paths_back(found, spark.createDataFrame(wanted, "source long, target long")).collect()}
    assert set(paths) == {(s, t) for s, t in wanted if (s, t) in got}
    for (s, t), r in paths.items():
        assert (r["path"][0], r["path"][-1], r["distance"]) == (s, t, got[s, t])
        assert sum(least[a, b] for a, b in zip(r["path"], r["path"][1:], strict=False)) == pytest.approx(got[s, t])


def test_a_long_path_and_broken_weights(spark):
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(30)], "i long, j long, w double")
    found = graphs.distances_from(line, spark.createDataFrame([(0,)], "source long"))
    (r,) = graphs.paths_back(found, spark.createDataFrame([(0, 30)], "source long, target long")).collect()
    assert r["distance"] == 30 and r["path"] == list(range(31))
    with pytest.raises(ValueError):
        graphs.distances_from(spark.createDataFrame([(1, 2, -1.0)], "i long, j long, w double"), spark.createDataFrame([(1,)], "source long"))


@pytest.mark.parametrize("n", [300, 2_000])
def test_clusters_are_those_of_the_loop(spark, n):
    rng = random.Random(n)
    points = [(g, float(rng.randrange(0, 400)), float(rng.randrange(0, 400))) for g in (1, 2) for _ in range(n // 2)] + [(1, None, 2.0), (1, 5.0, 5.0), (1, 5.0, 5.0)]
    got = {}
    for r in graphs.clustered(spark.createDataFrame(points, "graph_id long, x double, y double"), 30.0).collect():
        got.setdefault(r["graph_id"], {})[r["node_id"]] = (r["x"], r["y"])
    for g in (1, 2):
        want = sorted(map(tuple, shapes.clusters([p[1:] for p in points if p[0] == g and p[1] is not None], 30.0).tolist()))
        assert [got[g][k] for k in range(len(want))] == [pytest.approx(x) for x in want] and len(got[g]) == len(want)


def test_no_places(spark):
    assert graphs.clustered(spark.createDataFrame([(1, None, 1.0)], "graph_id long, x double, y double"), 1.0).count() == 0


def test_distances_over_cells_settle_in_few_rounds(spark):
    """A line over four cells with ties and edges of no length takes a round a cell, and not one a step."""
    edges = [(k, k + 1, 0.1) for k in range(60)] + [(19, 70, 0.0), (70, 20, 0.1), (40, 71, 0.0), (71, 40, 0.0)]
    df = spark.createDataFrame(edges, "i long, j long, w double")
    cells = spark.createDataFrame([(k, k // 20) for k in range(61)] + [(70, 1), (71, 1)], "node long, cell long")
    found = graphs.distances_from(df, spark.createDataFrame([(0,), (777,)], "source long"), 6, cells).collect()
    assert {r["node"]: r["distance"] for r in found if r["source"] == 0} == nearest_ways(edges, 0)
    before = {r["node"]: r["before"] for r in found if r["source"] == 0}
    for at in before:
        steps = 0
        while before[at] is not None:
            at, steps = before[at], steps + 1
            assert steps < 63
        assert at == 0
    assert [(r["node"], r["distance"], r["before"]) for r in found if r["source"] == 777] == [(777, 0.0, None)]


def test_cells_are_bounded_where_points_crowd(spark):
    points = spark.createDataFrame([(k, 5.0 if k < 80 else float(k), 5.0) for k in range(100)], "id long, x double, y double")
    sizes = [r["count"] for r in graphs.cells_of(points, 10).groupBy("cell").count().collect()]
    assert sum(sizes) == 100 and max(sizes) <= 10


def _grid(seed, side):
    rng = random.Random(seed)
    return [(a, a + step, rng.choice([0.0, 0.1, 0.3, 1.7])) for x in range(side) for y in range(side) for a in [side * x + y] for step in (1, side) if (y < side - 1 if step == 1 else x < side - 1)]


def test_sources_settle_side_by_side():
    """A node's arcs are looked at for all sources at once, and not once for each source, as a queue for each would."""
    edges = _grid(5, 12)
    rows = [(i, j, w, 0) for a, b, w in edges for i, j in ((a, b), (b, a))] + [(k, k, 0.0, waves.NODE + waves.WANTED) for k in range(144)]
    cell = waves.Cell(*map(np.array, zip(*rows, strict=True)))
    calls, one = [], cell.one
    cell.one = lambda *a: (calls.append(1), one(*a))[1]
    starts = pd.DataFrame({"source": range(40), "node": range(40), "distance": 0.0, "before": range(40)})
    found = pd.concat(waves.whole(starts, cell, trace=False))
    assert len(calls) == 1
    got = {s: dict(zip(g["node"], g["distance"], strict=True)) for s, g in found.groupby("source")}
    assert got == {s: nearest_ways(edges, s) for s in range(40)}


def test_pieces_are_bounded_and_lead_back(monkeypatch):
    """Rows leave a task in pieces, and ways lead back to the source also over edges of no length."""
    monkeypatch.setattr(waves, "ROWS", 100)
    edges = _grid(6, 9)
    rows = [(i, j, w, 0) for a, b, w in edges for i, j in ((a, b), (b, a))] + [(k, k, 0.0, waves.NODE + waves.WANTED) for k in range(81)]
    pieces = list(waves.whole(pd.DataFrame({"source": range(7), "node": range(7), "distance": 0.0, "before": range(7)}), waves.Cell(*map(np.array, zip(*rows, strict=True)))))
    assert len(pieces) > 3 and max(map(len, pieces)) <= 100
    for source, own in pd.concat(pieces).groupby("source"):
        before = dict(zip(own["node"], own["before"], strict=True))
        for at in before:
            steps = 0
            while at != source:
                at, steps = before[at], steps + 1
                assert steps < 81
