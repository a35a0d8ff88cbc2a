"""Routes around obstacles of one run: visibility, shortest paths, tuning and the step-by-step flight. A run is small (hundreds of vertices),
runs are many: each is one group of a grouped map."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np

from galewise.kernels import shapes

Point = tuple[float, float]


class Obstacles:
    """Polygons (rings of points) of one time key, with their bounds. Tests are on plain floats: an obstacle has few edges, and a run asks
    thousands of times."""

    def __init__(self, polygons) -> None:
        self.rings = [np.asarray(p, dtype=float) for p in polygons if len(p) > 2]
        self.bounds = np.array([[*r.min(0), *r.max(0)] for r in self.rings]).reshape(-1, 4)
        self.edges = [[(*a, *b) for a, b in zip(own, own[1:] + own[:1], strict=True)] for own in (r.tolist() for r in self.rings)]
        self.boxes = [tuple(b) for b in self.bounds.tolist()]

    def blocks(self, p: Point, q: Point) -> bool:
        """Whether the closed segment meets an obstacle; touching counts."""
        px, py, qx, qy = float(p[0]), float(p[1]), float(q[0]), float(q[1])
        x0, x1 = (px, qx) if px < qx else (qx, px)
        y0, y1 = (py, qy) if py < qy else (qy, py)
        dx, dy = qx - px, qy - py
        near = False
        for (u0, v0, u1, v1), edges in zip(self.boxes, self.edges, strict=True):
            if u0 > x1 or u1 < x0 or v0 > y1 or v1 < y0:
                continue
            near = True
            for ax, ay, bx, by in edges:
                d1, d2 = dx * (ay - py) - dy * (ax - px), dx * (by - py) - dy * (bx - px)
                if d1 * d2 > 0:
                    continue
                ex, ey = bx - ax, by - ay
                d3, d4 = ex * (py - ay) - ey * (px - ax), ex * (qy - ay) - ey * (qx - ax)
                if d1 * d2 < 0 and d3 * d4 < 0:
                    return True
                if (d1 == 0 and x0 <= ax <= x1 and y0 <= ay <= y1) or (d2 == 0 and x0 <= bx <= x1 and y0 <= by <= y1):
                    return True
                if (d3 == 0 and _within(px, ax, bx) and _within(py, ay, by)) or (d4 == 0 and _within(qx, ax, bx) and _within(qy, ay, by)):
                    return True
        return near and self.holder((px, py)) is not None

    def holder(self, p: Point) -> int | None:
        """The first obstacle that has the point strictly inside."""
        px, py = float(p[0]), float(p[1])
        for k, (u0, v0, u1, v1) in enumerate(self.boxes):
            if u0 < px < u1 and v0 < py < v1 and _holds(self.edges[k], px, py):
                return k
        return None


def _within(v: float, a: float, b: float) -> bool:
    return a <= v <= b or b <= v <= a


def _holds(edges, px: float, py: float) -> bool:
    """Whether the point is strictly inside the ring."""
    odd = False
    for ax, ay, bx, by in edges:
        d = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if d == 0 and _within(px, ax, bx) and _within(py, ay, by):
            return False
        if (ay > py) != (by > py) and (d if by > ay else -d) > 0:
            odd = not odd
    return odd


def shortest(edges: dict[int, list[tuple[int, float]]], start: int, end: int) -> tuple[list[int], float] | None:
    """Dijkstra with a heap; ties by node."""
    best, before, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if u == end:
            path = [u]
            while path[-1] != start:
                path.append(before[path[-1]])
            return path[::-1], d
        if d > best[u]:
            continue
        for w, length in edges.get(u, ()):
            if d + length < best.get(w, math.inf):
                best[w], before[w] = d + length, u
                heapq.heappush(heap, (d + length, w))
    return None


def adjacency(pairs) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for i, j, w in pairs:
        out.setdefault(i, []).append((j, w))
        out.setdefault(j, []).append((i, w))
    return out


def seen_route(points: list[Point], keys: list[Obstacles], start: Point, end: Point) -> list[Point] | None:
    """Shortest path over the full visibility graph of points, valid for all keys."""
    own = list(dict.fromkeys([start, end, *points]))
    pairs = [(i, j, math.dist(own[i], own[j])) for i in range(len(own)) for j in range(i + 1, len(own)) if not any(o.blocks(own[i], own[j]) for o in keys)]
    found = shortest(adjacency(pairs), 0, own.index(end))
    return [own[i] for i in found[0]] if found else None


class Master:
    """Candidate edges (Delaunay and nearest neighbours) over simplified obstacle corners, with their validity at each key."""

    def __init__(self, keys: list[Obstacles], vertices, reach: float = 5_000.0, neighbours: int = 10) -> None:
        self.keys = keys
        centres = shapes.clusters(vertices, reach)
        self.nodes = [tuple(p) for p in centres[np.lexsort((centres[:, 1], centres[:, 0]))].tolist()] if len(centres) else []
        n = len(self.nodes)
        pairs = set(shapes.delaunay_edges(self.nodes)) if n > 1 else set()
        if n > 1:
            p = np.array(self.nodes)
            d = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
            np.fill_diagonal(d, np.inf)
            for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, : min(neighbours, n - 1)].tolist()):
                pairs |= {(min(i, j), max(i, j)) for j in row}
        self.neighbours = neighbours
        self.valid = [{(i, j) for i, j in pairs if not o.blocks(self.nodes[i], self.nodes[j])} for o in keys]

    def route(self, start: Point, end: Point, window: range) -> list[Point] | None:
        """Shortest path over edges valid at all keys of the window. Start and end join their nearest visible nodes; with no node at all, the
        straight line is taken where nothing blocks it."""
        here = [self.keys[t] for t in window]
        if not self.nodes:
            return [start, end] if not any(o.blocks(start, end) for o in here) else None
        shared = set.intersection(*(self.valid[t] for t in window)) if len(window) else set()
        n = len(self.nodes)
        pairs = [(i, j, math.dist(self.nodes[i], self.nodes[j])) for i, j in shared]
        p = np.array(self.nodes)
        for name, q in ((n, start), (n + 1, end)):
            d = np.hypot(*(p - q).T)
            pairs += [(int(i), name, float(d[i])) for i in np.argsort(d, kind="stable")[: self.neighbours] if not any(o.blocks(q, self.nodes[i]) for o in here)]
        found = shortest(adjacency(pairs), n, n + 1)
        if not found:
            return None
        named = [*self.nodes, start, end]
        return seen_route([named[i] for i in found[0]], here, start, end)  # tuned over what the path's own points see


def length(path) -> float:
    return float(sum(math.dist(a, b) for a, b in zip(path, path[1:], strict=False)))


def cut(path: list[Point], reach: float) -> tuple[list[Point], list[Point]]:
    """The path up to `reach` along it, and the rest from there on."""
    done, out = 0.0, [path[0]]
    for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
        d = math.dist(a, b)
        if done + d >= reach and d:
            t = (reach - done) / d
            p = (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
            return [*out, p], [p, *path[k + 1 :]] if t < 1 else [b, *path[k + 2 :]]
        done += d
        out.append(b)
    return out, path[-1:]


def parts(path: list[Point], step: float) -> list[list[Point]]:
    out, rest = [], path
    while length(rest) > 1e-9:
        part, rest = cut(rest, step)
        out.append(part)
    return out or [path]


def path_valid(path: list[Point], keys: list[Obstacles], step: float, first: int = 0) -> bool:
    """Part i against key first + i; parts beyond the last key are not held against anything."""
    return not any(keys[first + i].blocks(a, b) for i, part in enumerate(parts(path, step)) if first + i < len(keys) for a, b in zip(part, part[1:], strict=False))


def densified(path: list[Point], step: float) -> list[Point]:
    out = path[:1]
    for a, b in zip(path, path[1:], strict=False):
        n = max(1, math.ceil(math.dist(a, b) / step))
        out += [(a[0] + (b[0] - a[0]) * i / n, a[1] + (b[1] - a[1]) * i / n) for i in range(1, n + 1)]
    return out


def greedy_tuned(path, keys, step: float, first: int = 0, dense: float = 20_000.0, quick: bool = True) -> list[Point]:
    """Shortcuts from each point in turn, the farthest target first; a shortcut must be valid and take no more parts."""
    own, at = densified(list(path), dense), 0
    while at < len(own) - 2:
        most = math.ceil(length(own) / step - 1e-9)
        for j in range(len(own) - 1, at + 1, -1):
            new = own[: at + 1] + own[j:]
            if math.ceil(length(new) / step - 1e-9) <= most and path_valid(new, keys, step, first):
                own = own[:at] + densified([own[at], own[j]], dense) + own[j + 1 :]
                break
        at += 1
        if quick and length(own[: at + 1]) > step:
            break
    return list(map(tuple, shapes.simplified(own, 1e-9).tolist()))


def smooth_tuned(path, keys, step: float, first: int = 0, tolerance: float = 25_000.0, most: int = 300, gain: float = 1.0) -> list[Point]:
    """Corners are cut, the sharpest first, where the path stays valid; it ends when a round gains less than `gain`."""
    own = list(path)
    for _ in range(most):
        before = length(own)
        for _, i in sorted((_angle(own[i - 1], own[i], own[i + 1]), i) for i in range(1, len(own) - 1)):
            new = own[:i] + _shifted(own, i, tolerance) + own[i + 1 :]
            if path_valid(new, keys, step, first):
                own = new
                break
        else:
            break
        if before - length(own) < gain:
            break
    return own


def _angle(a, b, c) -> float:
    ux, uy, vx, vy = a[0] - b[0], a[1] - b[1], c[0] - b[0], c[1] - b[1]
    n = math.hypot(ux, uy) * math.hypot(vx, vy)
    return math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / n)))) if n else 180.0


def _shifted(path, i: int, tolerance: float) -> list[Point]:
    a, b, c = path[i - 1], path[i], path[i + 1]
    out = []
    if (d := math.dist(a, b)) > tolerance:
        out.append((b[0] - (b[0] - a[0]) / d * tolerance, b[1] - (b[1] - a[1]) / d * tolerance))
    if (d := math.dist(b, c)) > tolerance:
        out.append((b[0] + (c[0] - b[0]) / d * tolerance, b[1] + (c[1] - b[1]) / d * tolerance))
    return out


TUNERS = {"greedy": greedy_tuned, "smooth": smooth_tuned}


@dataclass
class Flight:
    """State and record of one run."""

    position: Point
    t: int = 0
    segments: list[list[Point]] = field(default_factory=list)
    success: bool = True
    intermediate: bool = True


@dataclass(frozen=True)
class Rules:
    window: int = 1
    step: float = 75_000.0
    buffer: float = 5_000.0
    tolerance: float = 5_000.0
    neighbours: int = 10
    tuner: str | None = None
    correct: bool = False


def corners(keys: list[Obstacles], rules: Rules) -> np.ndarray:
    found = [shapes.obstacle_vertices(r, rules.buffer, rules.tolerance) for o in keys for r in o.rings]
    return np.vstack(found) if found else np.empty((0, 2))


def outside(p: Point, o: Obstacles, vertices) -> Point:
    """p, or the nearest vertex inside no obstacle where p is inside one; p itself where there is none."""
    if o.holder(p) is None:
        return p
    for q in sorted(map(tuple, np.asarray(vertices).tolist()), key=lambda v: (math.dist(v, p), v)):
        if o.holder(q) is None:
            return q
    return p


def corrected(segment: list[Point], rest: list[Point], now: Obstacles, after: Obstacles, vertices) -> tuple[list[Point], bool]:
    """The segment, led out of an obstacle in which its end would stand at the next key: from its last point outside both keys' obstacles to
    the first point outside of what is left of the path, or to the nearest free vertex. True where nothing was changed."""
    both = Obstacles([*now.rings, *after.rings])
    if not segment or after.holder(segment[-1]) is None:
        return segment, True
    free = [i for i, p in enumerate(segment) if both.holder(p) is None]
    nearest = outside(segment[-1], both, vertices)
    entry = segment[free[-1]] if free else nearest
    target = next((p for p in rest if both.holder(p) is None), nearest)
    way = seen_route([tuple(p) for p in np.asarray(vertices).reshape(-1, 2).tolist()], [now, after], entry, target)
    if way is None:
        return segment, True
    return [*(segment[: free[-1] + 1] if free else [entry]), *way[1:]], False


def take_step(flight: Flight, end: Point, keys: list[Obstacles], rules: Rules, master: Master, vertices) -> bool:
    """Plan over the window of keys that begins now, and fly one step. False where the run is over."""
    window = range(flight.t, min(flight.t + rules.window, len(keys)))
    start = outside(flight.position, keys[flight.t], vertices)
    if start != flight.position:
        flight.intermediate = False
    aim = outside(end, keys[flight.t], vertices)
    path = master.route(start, aim, window)
    if path is None:
        flight.success = False
        return False
    if rules.tuner:
        path = TUNERS[rules.tuner](path, keys, rules.step, flight.t)
    done, rest = cut(path, rules.step)
    if rules.correct and flight.t + 1 < len(keys) and done[-1] != aim:
        led, same = corrected(done, rest, keys[flight.t], keys[flight.t + 1], vertices)
        if not same:
            done, _ = cut(led, rules.step)
            flight.intermediate = False
    flight.segments.append(done if start == flight.position else [flight.position, *done])
    flight.position = end if aim != end and math.dist(done[-1], aim) < 1e-6 else done[-1]
    flight.t += 1
    return flight.position != end


def prepared(keys: list[Obstacles], rules: Rules) -> tuple[np.ndarray, Master]:
    """Corners and candidate edges of a scene: the same for all its windows, directions and configurations."""
    vertices = corners(keys, rules)
    return vertices, Master(keys, vertices, rules.tolerance, rules.neighbours)


def fly(start: Point, end: Point, keys: list[Obstacles], rules: Rules, ready: tuple[np.ndarray, Master] | None = None) -> Flight:
    """A whole run: it ends at the goal, without a path, or with the last window; what is left is closed by a straight leg."""
    vertices, master = ready or prepared(keys, rules)
    flight = Flight(tuple(start))
    while flight.position != tuple(end) and flight.t < len(keys) - rules.window + 1:
        if not take_step(flight, tuple(end), keys, rules, master, vertices):
            break
    if flight.position != tuple(end):
        flight.success = flight.success and False
        flight.segments.append([flight.position, tuple(end)])
    return flight


def static_route(start: Point, end: Point, polygons, rules: Rules) -> list[Point] | None:
    o = Obstacles(polygons)
    return seen_route([tuple(p) for p in corners([o], rules).tolist()], [o], tuple(start), tuple(end))
