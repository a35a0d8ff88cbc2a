"""Delaunay edges of one graph by tiles equal those of one task."""

import numpy as np
import pytest

from galewise.kernels import shapes, triangles
from galewise.operators import triangulation


def _rows(spark, p):
    return spark.createDataFrame([(7 * k + 3, float(x), float(y)) for k, (x, y) in enumerate(p)], "id long, x double, y double")


def _whole(p):
    return {(7 * i + 3, 7 * j + 3) for i, j in shapes.delaunay_edges(np.array(p, float))}


def _tiled(spark, p, bound):
    found = [tuple(r) for r in triangulation.delaunay_edges(_rows(spark, p), bound).collect()]
    assert len(found) == len(set(found))
    return set(found)


CASES = {
    "crowd, some on one place": np.vstack([p := np.round(np.random.default_rng(3).normal(0, 1e5, (240, 2))), p[::9]]),
    "outliers": np.vstack([np.round(np.random.default_rng(4).normal(0, 1e3, (40, 2))), [[3e4, -2e4], [-4e4, 1e4]]]),
    "lattice": np.array([(i, j) for i in range(8) for j in range(8)], float),
}


@pytest.mark.parametrize("name", CASES)
def test_tiles_equal_one_task(spark, name):
    assert _tiled(spark, CASES[name], 24) == _whole(CASES[name])


def test_few_points_and_lines_give_all_pairs(spark):
    for p in ([(0, 0), (5, 1), (2, 7)], [(k, 3 * k) for k in range(8)], [(0.1 * k, 0.3 * k) for k in range(8)]):
        assert _tiled(spark, p, 4) == _whole(p) == {(7 * i + 3, 7 * j + 3) for j in range(len(p)) for i in range(j)}


def test_no_task_holds_the_graph(spark, monkeypatch):
    """Tiles are no fuller than their bound and some neighbours, whatever the graph."""
    full = []
    real = triangulation.written

    def written(df, name):
        out = real(df, name)
        if name == "members":
            full.extend(r["count"] for r in out[0].groupBy("_td", "_tx", "_ty").count().collect())
        return out

    monkeypatch.setattr(triangulation, "written", written)
    p = np.round(np.random.default_rng(6).normal(0, 1e5, (500, 2)))
    assert _tiled(spark, p, 40) == _whole(p)
    assert 0 < max(full) < 250


def test_signs_are_exact():
    big = 2.0**40
    square = [(big, big), (big + 1, big), (big + 1, big + 1), (big, big + 1)]
    assert triangles.turn((big, big), (big + 1, big + 1), (big + 2, big + 2)) == 0 and triangles.turn((0, 0), (big, big), (1, 1 + 2**-50)) == 1
    assert not triangles.inside(*square, (0, 1, 2, 3))
    assert triangles.inside(*square[:3], (big + 0.5, big + 0.999), (0, 1, 2, 3))
