"""Points in oriented boxes, counted for a block of boxes and a tile of points."""

from __future__ import annotations

import numpy as np

#: Points of a leaf, leaves and boxes that are compared at once, and points.
LEAF, PAIRS, POINTS = 64, 1 << 17, 1 << 18


def leaves(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the points by leaf, LEAF at most in each, -1 where a leaf has fewer: halves by the longer side until they fit."""
    out, stack = [], [np.arange(len(x))] if len(x) else []
    while stack:
        own = stack.pop()
        if len(own) <= LEAF:
            out.append(np.concatenate([own, np.full(LEAF - len(own), -1)]))
            continue
        by = x if np.ptp(x[own]) >= np.ptp(y[own]) else y
        half = -(-len(own) // (2 * LEAF)) * LEAF
        parted = own[np.argpartition(by[own], half)] if half < len(own) else own
        stack += [parted[:half], parted[half:]]
    return np.array(out, dtype=np.int64).reshape(-1, LEAF)


def counts(ax, ay, ux, uy, x, y, side: float, spans: list[tuple[float, float]]) -> np.ndarray:
    """(boxes, spans): for each position and direction, how many points are 0 to `side` ahead and within each span aside, ends included.

    A leaf that is on one side of every line by more than rounding counts whole or not at all; the points of the others are compared."""
    at = leaves(x, y)
    there = at >= 0
    px, py = np.where(there, x[at], np.nan), np.where(there, y[at], np.nan)
    n = there.sum(1)
    low, high = np.stack([np.nanmin(px, 1), np.nanmin(py, 1)]), np.stack([np.nanmax(px, 1), np.nanmax(py, 1)])
    mid, half = (low + high) / 2, (high - low) / 2
    lines = sorted({v for span in spans for v in span})
    out = np.zeros((len(ax), len(spans)), dtype=np.int64)
    step = max(1, PAIRS // max(1, len(at)))
    for first in range(0, len(ax), step):
        k = slice(first, first + step)
        a, b, u, w = ax[k, None], ay[k, None], ux[k, None], uy[k, None]
        dx, dy = mid[0] - a, mid[1] - b
        ahead, aside = dx * u + dy * w, dy * u - dx * w
        little = 1e-9 * (np.abs(dx) + np.abs(dy) + half.sum(0) + side + max(map(abs, lines)))
        reach, width = half[0] * np.abs(u) + half[1] * np.abs(w) + little, half[0] * np.abs(w) + half[1] * np.abs(u) + little
        far = (ahead + reach < 0) | (ahead - reach > side) | (aside + width < lines[0]) | (aside - width > lines[-1])
        cut = (ahead - reach < 0) | (ahead + reach > side)
        for line in lines:
            cut |= np.abs(aside - line) <= width
        whole = ~far & ~cut
        for m, (left, right) in enumerate(spans):
            out[k, m] += ((whole & (aside >= left) & (aside <= right)) * n).sum(1)
        box, leaf = np.nonzero(cut & ~far)
        box += first
        for start in range(0, len(box), POINTS // LEAF):
            i, j = box[start : start + POINTS // LEAF], leaf[start : start + POINTS // LEAF]
            dx, dy = px[j] - ax[i, None], py[j] - ay[i, None]
            u, w = ux[i, None], uy[i, None]
            ahead, aside = dx * u + dy * w, dx * -w + dy * u
            inside = (ahead >= 0) & (ahead <= side)
            for m, (left, right) in enumerate(spans):
                out[:, m] += np.bincount(i, np.count_nonzero(inside & (aside >= left) & (aside <= right), axis=1), len(ax)).astype(np.int64)
    return out
