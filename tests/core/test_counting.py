"""Points in oriented boxes, counted by tiles, equal those compared one by one."""

import numpy as np

from galewise.functions import boxes as bx
from galewise.kernels import boxes
from galewise.operators import counting

SPANS = [((left - width / 2) * 250, (left + width / 2) * 250) for width, _, left in bx.STRATEGIES.values()]


def _brute(ax, ay, ux, uy, x, y):
    dx, dy = x[None] - ax[:, None], y[None] - ay[:, None]
    ahead, aside = dx * ux[:, None] + dy * uy[:, None], dx * -uy[:, None] + dy * ux[:, None]
    return np.stack([((ahead >= 0) & (ahead <= 250) & (aside >= a) & (aside <= b)).sum(1) for a, b in SPANS], axis=1)


def _some(n, m):
    rng = np.random.default_rng(n)
    x, y = np.round(rng.normal(0, 125, (2, n)))
    ax, ay = x[:m], y[:m]
    turn = np.where(np.arange(m) % 2, np.arange(m) % 8 * np.pi / 4, rng.uniform(0, 7, m))
    return ax, ay, np.round(np.cos(turn), 12), np.round(np.sin(turn), 12), x, y


def test_leaves_count_as_points_do():
    for n, m in ((1, 1), (64, 9), (65, 30), (1500, 200)):
        args = _some(n, min(n, m))
        assert (boxes.counts(*args, 250.0, SPANS) == _brute(*args)).all()


def test_tiles_and_blocks_add_up(spark):
    """No pair of a point and a box becomes a row: what tasks give is a row for each position."""
    ax, ay, ux, uy, x, y = _some(700, 90)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(800, None, 1.0)], "id long, x double, y double")
    ahead = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(zip(ax, ay, ux, uy, strict=True))], "seg long, ax double, ay double, ux double, uy double")
    counted = counting.points_in_boxes(ahead, points, "seg", bx.STRATEGIES, 250, tile=100, block=20)
    want = _brute(ax, ay, ux, uy, x, y)
    assert {(r["seg"], r["strategy"]): r["n"] for r in counted.collect()} == {(k, s): want[k, m] for k in range(90) for m, s in enumerate(bx.STRATEGIES) if want[k, m]}
