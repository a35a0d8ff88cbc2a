"""Distances inside one cell of a graph, for a block of sources side by side."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Marks of a node's own row among the arcs of its cell: that it is a node, has arcs to other cells, and is asked for.
NODE, BORDER, WANTED = 4, 1, 2
#: Nodes whose arcs are looked at together, and rows that are given out at once.
BATCH, ROWS = 64, 1 << 19


class Cell:
    """The nodes and arcs of a cell, from arrays i, j, w, mark of equal length."""

    def __init__(self, i, j, w, mark) -> None:
        i, j, w, mark = np.asarray(i), np.asarray(j), np.asarray(w, float), np.asarray(mark)
        own = mark >= NODE
        order = np.argsort(i[own], kind="stable")
        self.names, marks = i[own][order], mark[own][order]
        self.border, self.wanted = (marks & BORDER) > 0, (marks & WANTED) > 0
        tail, head, w = self.at(i[~own]), self.at(j[~own]), w[~own]
        nodes = np.arange(len(self.names) + 1)
        order = np.argsort(tail, kind="stable")
        self.head, self.length, self.first = head[order], w[order], np.searchsorted(tail[order], nodes)
        order = np.argsort(head, kind="stable")
        self.tail, self.cost, self.begin = tail[order], w[order], np.searchsorted(head[order], nodes)
        self.lists = self.head.tolist(), self.length.tolist(), self.first.tolist()

    def at(self, names) -> np.ndarray:
        return np.searchsorted(self.names, names)

    def one(self, d: np.ndarray, dirty: np.ndarray) -> tuple[list[float], list[int]]:
        """Distances of one source, fallen from the dirty nodes on, and the node that each fall comes from, -1 without one. A fall is strict."""
        head, length, first = self.lists
        own, come = d.tolist(), [-1] * len(d)
        queue = [(own[u], u) for u in np.flatnonzero(dirty).tolist()]
        heapq.heapify(queue)
        while queue:
            x, u = heapq.heappop(queue)
            if x > own[u]:
                continue
            for k in range(first[u], first[u + 1]):
                y, v = x + length[k], head[k]
                if y < own[v]:
                    own[v], come[v] = y, u
                    heapq.heappush(queue, (y, v))
        return own, come

    def settle(self, d: np.ndarray, dirty: np.ndarray) -> None:
        """Let distances d (node, source) fall until no arc shortens any, from the dirty nodes on. Nodes take turns in the order of their distance from
        the nearest dirty one, to and fro, a batch at a time and for all sources side by side."""
        start = np.where(dirty, d, np.inf).min(axis=1)
        order = np.argsort(self.one(start, np.isfinite(start))[0], kind="stable")
        active = np.zeros(len(d), bool)
        active[self.head[_spans(self.first, np.flatnonzero(dirty.any(axis=1)))[0]]] = True
        degree = np.diff(self.begin)
        turns = range(0, len(d), BATCH)
        while active.any():
            for s in turns:
                v = order[s : s + BATCH]
                v = v[active[v]]
                if not len(v):
                    continue
                active[v] = False
                v = v[np.argsort(-degree[v], kind="stable")]
                was = d[v]
                now = was.copy()
                for k in range(degree[v[0]]):  # the k-th arcs of all nodes that have so many
                    arcs = self.begin[v[: np.count_nonzero(degree[v] > k)]] + k
                    near = d.take(self.tail[arcs], axis=0)
                    near += self.cost[arcs, None]
                    np.minimum(now[: len(arcs)], near, out=now[: len(arcs)])
                fell = (now < was).any(axis=1)
                if fell.any():
                    d[v[fell]] = now[fell]
                    active[self.head[_spans(self.first, v[fell])[0]]] = True
            turns = turns[::-1]

    def came(self, d: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For nodes v and all sources the node that a settled distance comes from: one nearer to the source whose arc makes it up; -1 where none is, as
        nodes on one place may hold each other up."""
        out = np.full((len(v), d.shape[1]), -1, dtype=np.int64)
        some = self.begin[v + 1] > self.begin[v]
        arcs, offsets = _spans(self.begin, v[some])
        if len(arcs):
            near, own = d[self.tail[arcs]], np.repeat(d[v[some]], np.diff(self.begin)[v[some]], axis=0)
            fits = (near + self.cost[arcs, None] == own) & (near < own)
            which = np.minimum.reduceat(np.where(fits, np.arange(len(arcs))[:, None], len(arcs)), offsets, axis=0)
            out[some] = np.append(self.tail[arcs], -1)[which]
        return out


def _spans(first: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[v] to first[v + 1] in a row, and where each begins among them."""
    n = first[v + 1] - first[v]
    offsets = np.cumsum(n) - n
    return np.repeat(first[v] - offsets, n) + np.arange(n.sum()), offsets


def _opened(rows: pd.DataFrame, cell: Cell):
    names, column = np.unique(rows["source"].to_numpy(), return_inverse=True)
    return names, cell.at(rows["node"].to_numpy()), column, np.full((len(cell.names), len(names)), np.inf)


def _told(places: np.ndarray, come: np.ndarray):
    """A function from places to what was told of them last; places that were told nothing give anything."""
    order = np.argsort(places, kind="stable")
    known, told = places[order], come[order]
    return lambda at: told[np.maximum(np.searchsorted(known, at, side="right") - 1, 0)]


def step(rows: pd.DataFrame, cell: Cell) -> pd.DataFrame:
    """What is known at the border after the offers are taken that are less than what is known: (source, node, distance, before, start, fell).
    Rows marked start come from another cell, from the node before, or are sources."""
    names, at, column, d = _opened(rows, cell)
    start, fell = np.zeros(d.shape, bool), np.zeros(d.shape, bool)
    offer, distance, come = rows["offer"].to_numpy(bool), rows["distance"].to_numpy(float), rows["before"].to_numpy()
    old = (at[~offer], column[~offer])
    d[old], start[old] = distance[~offer], rows["start"].to_numpy(bool)[~offer]
    taken = offer & (distance < d[at, column])
    new = (at[taken], column[taken])
    d[new], start[new], fell[new] = distance[taken], True, True
    via = _told(np.concatenate([at[~offer], at[taken]]) * len(names) + np.concatenate([column[~offer], column[taken]]), np.concatenate([come[~offer], come[taken]]))
    was = d.copy()
    cell.settle(d, fell)
    less = d < was
    start &= ~less
    fell |= less
    i, k = np.nonzero((start | cell.border[:, None]) & np.isfinite(d))
    return pd.DataFrame({"source": names[k], "node": cell.names[i], "distance": d[i, k], "before": np.where(start[i, k], via(i * len(names) + k), cell.names[i]), "start": start[i, k], "fell": fell[i, k]})


def whole(rows: pd.DataFrame, cell: Cell, trace: bool = True) -> Iterator[pd.DataFrame]:
    """(source, node, distance, and before with trace) of the nodes of a cell that are asked for, out of all starts, in pieces; a source comes from itself."""
    names, at, column, d = _opened(rows, cell)
    d[at, column] = rows["distance"].to_numpy(float)
    via = _told(at * len(names) + column, rows["before"].to_numpy())
    was = d.copy() if trace else None
    cell.settle(d, np.isfinite(d))
    alone: dict[int, np.ndarray] = {}
    wanted = np.flatnonzero(cell.wanted)
    size = max(1, ROWS // len(names))
    for s in range(0, len(wanted), size):
        v = wanted[s : s + size]
        i, k = np.nonzero(np.isfinite(d[v]))
        out = {"source": names[k], "node": cell.names[v[i]], "distance": d[v[i], k]}
        if trace:
            less, come = (d[v] < was[v]), cell.came(d, v)
            for c in np.flatnonzero((less & (come < 0)).any(axis=0)).tolist():
                if c not in alone:
                    alone[c] = np.array(cell.one(was[:, c], np.isfinite(was[:, c]))[1])
            for c, own in alone.items():
                come[:, c] = own[v]
            out["before"] = np.where(less[i, k], cell.names[come[i, k]], via(v[i] * len(names) + k))
        yield pd.DataFrame(out)
