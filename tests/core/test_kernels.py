import math

import numpy as np
import pytest

from galewise.kernels import cells, routes, shapes

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def test_touching_counts_as_meeting():
    o = routes.Obstacles([SQUARE])
    assert o.blocks((-5, 0), (15, 0))
    assert o.blocks((-5, 5), (0, 5))
    assert o.blocks((2, 2), (3, 3))
    assert not o.blocks((-5, -1), (15, -1))


def test_a_point_on_the_edge_is_not_inside():
    o = routes.Obstacles([SQUARE])
    assert o.holder((5, 5)) == 0
    assert o.holder((0, 5)) is None
    assert o.holder((11, 5)) is None


def test_no_obstacles_give_the_straight_line():
    f = routes.fly((0, 0), (100_000, 0), [routes.Obstacles([])] * 4, routes.Rules())
    assert f.success and f.t == 2
    assert routes.length([p for s in f.segments for p in s]) == pytest.approx(100_000)


def test_a_square_is_flown_around():
    box = [(40_000, -10_000), (60_000, -10_000), (60_000, 10_000), (40_000, 10_000)]
    o = [routes.Obstacles([box])] * 4
    path = routes.static_route((0, 0), (100_000, 0), [box], routes.Rules())
    assert routes.length(path) > 100_000 and not any(o[0].blocks(a, b) for a, b in zip(path, path[1:]))
    f = routes.fly((0, 0), (100_000, 0), o, routes.Rules())
    assert f.success and not any(o[0].blocks(a, b) for s in f.segments for a, b in zip(s, s[1:]))


def test_a_walled_start_finds_no_path():
    walls = [[(-20, -20), (20, -20), (20, -10), (-20, -10)], [(-20, 10), (20, 10), (20, 20), (-20, 20)], [(-20, -20), (-10, -20), (-10, 20), (-20, 20)], [(10, -20), (20, -20), (20, 20), (10, 20)]]
    assert routes.static_route((0, 0), (100, 0), walls, routes.Rules(buffer=1.0, tolerance=0.1)) is None


def test_cut_and_parts():
    done, rest = routes.cut([(0, 0), (10, 0), (10, 10)], 15)
    assert done == [(0, 0), (10, 0), (10, 5.0)] and rest == [(10, 5.0), (10, 10)]
    assert [round(routes.length(p), 9) for p in routes.parts([(0, 0), (10, 0), (10, 10)], 15)] == [15, 5]


@pytest.mark.parametrize("tuner", ["greedy", "smooth"])
def test_tuning_keeps_a_path_valid_and_no_longer(tuner):
    box = [(40_000, -10_000), (60_000, -10_000), (60_000, 10_000), (40_000, 10_000)]
    keys = [routes.Obstacles([box])] * 6
    path = [(0.0, 0.0), (20_000.0, 60_000.0), (80_000.0, 60_000.0), (100_000.0, 0.0)]
    tuned = routes.TUNERS[tuner](path, keys, 75_000)
    assert routes.path_valid(tuned, keys, 75_000) and routes.length(tuned) <= routes.length(path) + 1e-6


def test_hulls():
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 100, (200, 2))
    hull = shapes.convex_hull(p)
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        assert all(shapes.cross(a, b, q) >= -1e-9 for q in p)
    concave = shapes.concave_hull(p)
    area = lambda r: abs(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2
    assert 0 < area(concave) <= area(hull)
    o = routes.Obstacles([concave.tolist()])
    corners = {tuple(c) for c in concave.tolist()}
    assert all(tuple(q) in corners or o.blocks(tuple(q), tuple(q)) or o.holder(tuple(q)) is not None for q in p.tolist())
    assert area(shapes.buffered_hull(p, 10)) > area(hull)


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(2).uniform(0, 1, (30, 2))
    edges = set(shapes.delaunay_edges(p))
    for i, j in edges:
        assert i < j
    tri = [(a, b, c) for a, b in edges for c in range(30) if c > b and (a, c) in edges and (b, c) in edges]
    empty = [t for t in tri if not any(shapes._in_circle(p[t[0]], p[t[1]], p[t[2]], p[k]) for k in range(30) if k not in t)]
    hull = len(shapes.convex_hull(p))
    assert len(empty) == 2 * 30 - 2 - hull and len(edges) == 3 * 30 - 3 - hull
    assert shapes.delaunay_edges([(0, 0), (1, 1), (2, 2), (3, 3)]) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_simplified_and_clipped():
    assert shapes.simplified([(0, 0), (1, 0), (2, 0), (2, 2)], 1e-9).tolist() == [[0, 0], [2, 0], [2, 2]]
    assert sorted(map(tuple, shapes.clip_to_convex(SQUARE, [(5, 5), (20, 5), (20, 20), (5, 20)]).tolist())) == [(5, 5), (5, 10), (10, 5), (10, 10)]
    assert len(shapes.clip_to_convex(SQUARE, [(50, 50), (60, 50), (60, 60), (50, 60)])) == 0


def test_shortest_path_ties_and_gaps():
    near = routes.adjacency([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0)])
    assert routes.shortest(near, 0, 2) == ([0, 1, 2], 2.0)
    assert routes.shortest(near, 0, 9) is None


@pytest.mark.parametrize("name", ["ConvGRU", "ConvLSTM", "ConvRNN", "GRU", "LSTM", "RNN", "Persistence"])
def test_models_predict_frames(name):
    frames = np.random.default_rng(0).normal(size=(6, 8, 8))
    out = cells.model(name, 64).predict(frames, 3)
    assert out.shape == (3, 8, 8) and np.isfinite(out).all()
    assert np.array_equal(out, cells.model(name, 64).predict(frames, 3))
    if name == "Persistence":
        assert np.array_equal(out[2], frames[-1])


def test_convolution_is_the_plain_sum():
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(2, 5, 5)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    got = cells.conv(x, w, b)
    pad = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = sum(pad[c, 2 + i - 0 : 3 + i, 1 + j : 2 + j].item() * w[1, c, i, j] for c in range(2) for i in range(3) for j in range(3)) + b[1]
    assert got[1, 2, 1] == pytest.approx(want)


def test_an_unknown_model_is_an_error():
    with pytest.raises(ValueError):
        cells.model("Transformer", 4)


def test_regions_and_rotation():
    mask = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 1]], dtype=bool)
    assert cells.components(mask).tolist() == [[1, 1, 0], [0, 0, 2], [3, 0, 2]]
    assert cells.rotated(np.eye(3), 180).tolist() == np.eye(3).tolist()
    assert cells.bilinear(np.array([[0.0, 2.0]]), np.array([0.0]), np.array([0.5]))[0] == pytest.approx(1.0)
    assert math.isclose(cells.rotated(np.ones((4, 4)), 90).sum(), 16)


def test_runs_of_a_scene_share_what_is_prepared_for_it():
    boxes = [[(x, -10_000.0), (x + 20_000, -10_000.0), (x + 20_000, 10_000.0), (x, 10_000.0)] for x in (40_000.0, 90_000.0)]
    keys = [routes.Obstacles(boxes)] * 6
    ready = routes.prepared(keys, routes.Rules())
    for rules in (routes.Rules(w, tuner=t, correct=c) for w in (1, 3) for t in (None, "greedy", "smooth") for c in (False, True)):
        for ends in (((0, 0), (150_000, 0)), ((150_000, 0), (0, 0))):
            assert routes.fly(*ends, keys, rules, ready) == routes.fly(*ends, keys, rules)


def test_triangles_are_tried_together():
    points = np.random.default_rng(5).integers(0, 1000, (60, 2)).astype(float)
    t = points[np.array([[0, 1, 2], [3, 4, 5], [6, 7, 8]])]
    inside = lambda a, b, c, d: np.linalg.det([[*(v - d), ((v - d) ** 2).sum()] for v in (a, b, c)]) * np.sign(shapes.cross(a, b, c)) > 0
    for d in points[9:]:
        assert shapes._in_circles(t, d).tolist() == [bool(inside(*own, d)) for own in t]
