"""Delaunay triangulation of one tile's points, and the points of another tile in circles around its triangles. Signs are exact: what floats can't
tell is computed in fractions, and of points on one circle the one with the larger number counts as outside, so that every tile decides alike."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd

#: Bounds of the rounding errors, as shares of the sums of all products' sizes.
_TURN, _CIRCLE = 4e-16, 1.3e-15
#: Points of a circle that a tile is told at once.
TOLD = 3


def _sign(v) -> int:
    return (v > 0) - (v < 0)


def turn(a, b, c) -> int:
    """1 where a, b, c run counter-clockwise, -1 where they run clockwise, 0 on one line."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > _TURN * (abs(left) + abs(right)):
        return 1 if det > 0 else -1
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x), Fraction(y)) for x, y in (a, b, c))
    return _sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def inside(a, b, c, d, ranks) -> bool:
    """Whether d is in the circle of a, b, c, which run counter-clockwise. On the circle the highest of the four ranks decides that can: its point is
    lifted off the paraboloid."""
    dx, dy = d
    ax, ay, bx, by, cx, cy = a[0] - dx, a[1] - dy, b[0] - dx, b[1] - dy, c[0] - dx, c[1] - dy
    p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    e, f, g = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = e * (p - q) + f * (r - s) + g * (t - u)
    if abs(det) > _CIRCLE * (e * (abs(p) + abs(q)) + f * (abs(r) + abs(s)) + g * (abs(t) + abs(u))):
        return det > 0
    dx, dy = Fraction(dx), Fraction(dy)
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(x) - dx, Fraction(y) - dy) for x, y in (a, b, c))
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    if det:
        return det > 0
    lifted = {0: lambda: turn(b, c, d), 1: lambda: -turn(a, c, d), 2: lambda: turn(a, b, d), 3: lambda: -turn(a, b, c)}
    for k in sorted(range(4), key=lambda k: ranks[k], reverse=True):
        if by_lift := lifted[k]():
            return by_lift > 0
    return False


def triangulation(p: list[tuple[float, float]]) -> dict[tuple[int, int], int]:
    """The third corner of the triangle on the left of each directed edge, for different points p; the first three hold all others between them."""
    xy = np.array(p[3:], dtype=float).reshape(-1, 2)
    apex = {(0, 1): 2, (1, 2): 0, (2, 0): 1}
    at = (0, 1)
    for i in (_snake(xy) + 3).tolist():
        d = p[i]
        u, v = at
        while True:
            w = apex[u, v]
            if turn(p[v], p[w], d) < 0:
                u, v = w, v
            elif turn(p[w], p[u], d) < 0:
                u, v = u, w
            elif turn(p[u], p[v], d) < 0:
                u, v = v, u
            else:
                break
        del apex[u, v], apex[v, w], apex[w, u]
        rim = [(u, v), (v, w), (w, u)]
        while rim:
            u, v = rim.pop()
            w = apex.get((v, u))
            if w is not None and inside(p[v], p[u], p[w], d, (v, u, w, i)):
                del apex[v, u], apex[u, w], apex[w, v]
                rim += [(u, w), (w, v)]
            else:
                apex[u, v], apex[v, i], apex[i, u] = i, u, v
                at = (u, v)
    return apex


def _snake(xy: np.ndarray) -> np.ndarray:
    """The order of the points along strips, up and down in turn."""
    if not len(xy):
        return np.zeros(0, dtype=int)
    low, wide = xy.min(0), np.maximum(xy.max(0) - xy.min(0), 1e-300)
    strip = np.minimum((xy[:, 0] - low[0]) / wide[0] * max(1, int((len(xy) / 2) ** 0.5)), 1e9).astype(int)
    return np.lexsort((np.where(strip % 2, -xy[:, 1], xy[:, 1]), strip))


def corners(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """Three points that hold all points of these bounds between them, a thousand times as far away as the bounds are wide."""
    (mx, my), span = ((x0 + x1) / 2, (y0 + y1) / 2), max(x1 - x0, y1 - y0) * 1_000
    return [(mx - span, my - span), (mx + span, my - span), (mx, my + span)]


#: What a tile's triangulation tells: its edges (a, b), and the circles (a, b, c) around triangles of its own points that leave its cell. Corners are
#: named -1 to -3 and marked by their bits in `far`.
STARS = "circle boolean, a long, b long, c long, far int, ax double, ay double, bx double, by double, cx double, cy double, xmin double, ymin double, xmax double, ymax double, mx double, my double, r double"


def stars(points: pd.DataFrame, far: list[tuple[float, float]], cell: tuple[float, float, float, float]) -> pd.DataFrame:
    """Edges with an end among the tile's own points (id, x, y, own), and the circles around triangles with one that leave the cell."""
    points = points.sort_values("id")
    p = [*far, *zip(points["x"].tolist(), points["y"].tolist(), strict=True)]
    apex = triangulation(p)
    own = np.concatenate([np.zeros(3, bool), points["own"].to_numpy(bool)])
    names = np.concatenate([[-1, -2, -3], points["id"].to_numpy(np.int64)])
    xy = np.array(p, dtype=float)
    e = np.array(list(apex), dtype=int).reshape(-1, 2)
    edges = e[(e[:, 0] < e[:, 1]) & (own[e[:, 0]] | own[e[:, 1]]) & (e[:, 0] > 2)]
    t = np.column_stack([e, np.fromiter(apex.values(), dtype=int, count=len(apex))])
    t = t[(t[:, 0] < t[:, 1]) & (t[:, 0] < t[:, 2]) & own[t].any(axis=1)]
    a, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
    u, v = b - a, c - a
    with np.errstate(all="ignore"):
        left, right = u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]
        twice, uu, vv = 2 * (left - right), (u**2).sum(1), (v**2).sum(1)
        mid = a + np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / twice[:, None]
        r = np.hypot(*(a - mid).T)
        # the sizes of the products against their difference tell how far the middle may be off; a circle that isn't known goes everywhere
        loose = (np.abs(left) + np.abs(right)) / np.abs(left - right) * 1e-14
        r = np.where(loose < 1e-2, r * (1 + 8 * loose) + np.abs(mid).max(1) * 1e-12, np.inf)
    r = np.where(np.isfinite(r) & np.isfinite(mid).all(1), r, np.inf)
    mid = np.where(np.isfinite(r)[:, None], mid, 0.0)
    out = ~((mid[:, 0] - r > cell[0]) & (mid[:, 1] - r > cell[1]) & (mid[:, 0] + r < cell[2]) & (mid[:, 1] + r < cell[3]))
    t, mid, r = t[out], mid[out], r[out]
    none = np.zeros(len(edges))
    whole = lambda first, second: np.concatenate([first, second])
    columns = {"circle": whole(np.zeros(len(edges), bool), np.ones(len(t), bool))}
    for k, name in enumerate("abc"):
        columns[name] = whole(names[edges[:, k]] if k < 2 else np.zeros(len(edges), np.int64), names[t[:, k]])
    columns["far"] = whole(none.astype(np.int32), ((t < 3) << np.arange(3)).sum(1).astype(np.int32))
    for k, name in enumerate("abc"):
        for m, axis in enumerate("xy"):
            columns[f"{name}{axis}"] = whole(none, xy[t[:, k], m])
    for name, side in (("min", -1), ("max", 1)):
        for m, axis in enumerate("xy"):
            columns[f"{axis}{name}"] = whole(none, np.clip(mid[:, m] + side * r, -1.7e308, 1.7e308))
    return pd.DataFrame({**columns, "mx": whole(none, mid[:, 0]), "my": whole(none, mid[:, 1]), "r": whole(none, r)})


def deepest(circles: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """For each circle up to TOLD points (id, x, y) in it, the deepest ones, with their depth; row is the circle's place."""
    ids, x, y = points["id"].to_numpy(np.int64), points["x"].to_numpy(float), points["y"].to_numpy(float)
    rows, found, depths = [], [], []
    names = circles[["a", "b", "c"]].to_numpy(np.int64)
    ends = circles[["ax", "ay", "bx", "by", "cx", "cy"]].to_numpy(float)
    real = (circles["far"].to_numpy()[:, None] >> np.arange(3)) & 1 == 0
    for k in range(len(circles)):
        ax, bx, cx = (ends[k, 2 * m] - x for m in range(3))
        ay, by, cy = (ends[k, 2 * m + 1] - y for m in range(3))
        p, q, r, s, t, u = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
        e, f, g = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        det = e * (p - q) + f * (r - s) + g * (t - u)
        unsure = _CIRCLE * (e * (np.abs(p) + np.abs(q)) + f * (np.abs(r) + np.abs(s)) + g * (np.abs(t) + np.abs(u)))
        known = set(names[k][real[k]].tolist())
        corner = [tuple(ends[k, 2 * m : 2 * m + 2].tolist()) for m in range(3)]
        ranks = [(bool(real[k, m]), int(names[k, m]) if real[k, m] else -int(names[k, m])) for m in range(3)]
        hit = det > unsure
        for i in np.flatnonzero(np.abs(det) <= unsure).tolist():
            hit[i] = ids[i] not in known and inside(*corner, (float(x[i]), float(y[i])), (*ranks, (True, int(ids[i]))))
        at = np.flatnonzero(hit)
        at = at[np.argsort(-det[at], kind="stable")[:TOLD]]
        rows += [k] * len(at)
        found.append(at)
        depths.append(det[at])
    at = np.concatenate(found) if found else np.zeros(0, int)
    return pd.DataFrame({"row": rows, "id": ids[at], "x": x[at], "y": y[at], "depth": np.concatenate(depths) if depths else np.zeros(0)})
