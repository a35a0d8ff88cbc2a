"""Hulls, buffers, simplification, clustering and triangulation of point sets of one obstacle or one graph."""

from __future__ import annotations

import math

import numpy as np


def cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points) -> np.ndarray:
    """Corners counter-clockwise from the lowest left, without collinear ones. One or two points are their own hull."""
    own = sorted({(float(x), float(y)) for x, y in points})
    if len(own) < 3:
        return np.array(own, dtype=float).reshape(-1, 2)
    halves = []
    for side in (own, own[::-1]):
        half: list = []
        for p in side:
            while len(half) > 1 and cross(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return np.array(halves)


def concave_hull(points, concavity: float = 1.0) -> np.ndarray:
    """A hull that follows the points: starting from the convex hull, the longest edge is opened to the inner point nearest to it while the
    edge is longer than concavity times the point's distance to its nearer end and the new edges cut no other. It holds all points."""
    hull = [tuple(p) for p in convex_hull(points)]
    inner = {(float(x), float(y)) for x, y in points} - set(hull)
    queue = list(zip(hull, hull[1:] + hull[:1], strict=True))
    ring = {a: b for a, b in queue}
    while queue and inner:
        queue.sort(key=lambda e: math.dist(*e))
        a, b = queue.pop()
        if ring.get(a) != b:
            continue
        width, best = math.dist(a, b), None
        for p in sorted(inner, key=lambda q: (_to_segment(q, a, b), q)):
            near = min(math.dist(p, a), math.dist(p, b))
            if width <= concavity * near:
                break
            if any(_proper(p, end, c, d) for end in (a, b) for c, d in ring.items() if (c, d) != (a, b)) or any(_in_triangle(q, a, b, p) for q in inner if q != p):
                continue
            best = p
            break
        if best is not None:
            ring[a], ring[best] = best, b
            inner.discard(best)
            queue += [(a, best), (best, b)]
    out = [hull[0]] if hull else []
    while out and ring.get(out[-1], out[0]) != out[0]:
        out.append(ring[out[-1]])
    return np.array(out, dtype=float).reshape(-1, 2)


def _to_segment(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _proper(a, b, c, d) -> bool:
    return cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0


def _in_triangle(q, a, b, c) -> bool:
    s = (cross(a, b, q), cross(b, c, q), cross(c, a, q))
    return all(x >= 0 for x in s) or all(x <= 0 for x in s)


def buffered_hull(points, radius: float, corners: int = 32) -> np.ndarray:
    """The convex hull grown by a disc of `corners` corners (exact for convex shapes up to the polygon that stands for the disc)."""
    hull = convex_hull(points)
    if not len(hull):
        return hull
    turn = 2 * np.pi * np.arange(corners) / corners
    disc = radius * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    return convex_hull((hull[:, None, :] + disc[None, :, :]).reshape(-1, 2))


def simplified(line, tolerance: float) -> np.ndarray:
    """Douglas-Peucker; both ends stay."""
    line = np.asarray(line, dtype=float)
    keep = np.zeros(len(line), dtype=bool)
    if len(line):
        keep[[0, -1]] = True
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        away = [_to_segment(line[i], line[a], line[b]) for i in range(a + 1, b)]
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def obstacle_vertices(polygon, buffer: float, tolerance: float) -> np.ndarray:
    """Corners that a route may turn at: the grown outline of an obstacle, simplified."""
    grown = buffered_hull(polygon, buffer)
    if len(grown) < 3:
        return grown
    slim = simplified(np.vstack([grown, grown[:1]]), tolerance)[:-1]
    return slim if len(slim) > 2 else grown


def clusters(points, reach: float) -> np.ndarray:
    """Centres of greedy clusters: in the order of (x, y), each point not taken yet takes those within reach."""
    own = np.array(sorted({(float(x), float(y)) for x, y in points})).reshape(-1, 2)
    taken, out = np.zeros(len(own), dtype=bool), []
    for i in range(len(own)):
        if not taken[i]:
            near = ~taken & (np.hypot(*(own - own[i]).T) <= reach)
            taken |= near
            out.append(own[near].mean(0))
    return np.array(out).reshape(-1, 2)


def delaunay_edges(points) -> list[tuple[int, int]]:
    """Edges (i < j) of a Delaunay triangulation (Bowyer-Watson). Fewer than four or collinear points give all pairs."""
    p = np.asarray(points, dtype=float).reshape(-1, 2)
    n = len(p)
    every = [(i, j) for i in range(n) for j in range(i + 1, n)]
    if n < 4 or np.linalg.matrix_rank(p - p[0]) < 2:
        return every
    low, high = p.min(0), p.max(0)
    mid, span = (low + high) / 2, float(max(high - low)) * 1_000
    q = np.vstack([p, mid + [-span, -span], mid + [span, -span], mid + [0, span]])
    triangles, xy = np.array([[n, n + 1, n + 2]]), q.tolist()
    for i in range(n):
        hit = _in_circles(q[triangles], q[i])
        rim: dict[tuple[int, int], int] = {}
        for a, b, c in triangles[hit].tolist():
            for u, v in ((a, b), (b, c), (c, a)):
                e = (u, v) if u < v else (v, u)
                rim[e] = rim.get(e, 0) + 1
        new = [(a, b, i) if cross(xy[a], xy[b], xy[i]) > 0 else (b, a, i) for (a, b), times in rim.items() if times == 1]
        triangles = np.vstack([triangles[~hit], np.array(new, dtype=triangles.dtype).reshape(-1, 3)])
    return sorted({tuple(sorted(e)) for t in triangles.tolist() for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if max(e) < n})


def _in_circles(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the triangles (m, 3, 2) have d strictly inside their circumcircle."""
    m = t - d
    det = np.linalg.det(np.concatenate([m, (m**2).sum(2, keepdims=True)], axis=2))
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    return det * np.where(turn > 0, 1.0, -1.0) > 0


def _in_circle(a, b, c, d) -> bool:
    return bool(_in_circles(np.array([[a, b, c]]), np.asarray(d))[0])


def clip_to_convex(ring, box) -> np.ndarray:
    """Sutherland-Hodgman against a counter-clockwise convex ring."""
    out = [tuple(map(float, p)) for p in ring]
    corners = [tuple(map(float, p)) for p in box]
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        own, out = out, []
        for before, p in zip(own[-1:] + own[:-1], own, strict=True):
            sb, s = cross(a, b, before), cross(a, b, p)
            if (s >= 0) != (sb >= 0):
                t = sb / (sb - s)
                out.append((before[0] + (p[0] - before[0]) * t, before[1] + (p[1] - before[1]) * t))
            if s >= 0:
                out.append(p)
    return np.array(out).reshape(-1, 2)
