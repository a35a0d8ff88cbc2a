"""Oriented boxes ahead of a position, transforms of rasters and of canvases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewise.functions.vectors import point

#: For each masking strategy the width, and the offsets of the centre ahead and to the left, in box sides.
STRATEGIES = {"center": (1.0, 0.5, 0.0), "left": (1.0, 0.5, 0.5), "right": (1.0, 0.5, -0.5), "wide": (2.0, 0.5, 0.0)}


def _of(strategy: Column, which: int) -> Column:
    out = None
    for name, values in STRATEGIES.items():
        out = F.when(strategy == name, values[which]) if out is None else out.when(strategy == name, values[which])
    return out


def oriented_box(position: Column, u: Column, strategy: Column, side: float) -> Column:
    """Four corners of the box: back left, back right, front right, front left of the centre line's local axes."""
    width, ahead, left = (_of(strategy, k) * side for k in range(3))
    cx = position["x"] + u["x"] * ahead - u["y"] * left
    cy = position["y"] + u["y"] * ahead + u["x"] * left
    corner = lambda across, along: point(cx + u["y"] * across + u["x"] * along, cy - u["x"] * across + u["y"] * along)
    w, h = width / 2, F.lit(side / 2)
    return F.array(corner(-w, -h), corner(w, -h), corner(w, h), corner(-w, h))


def in_oriented_box(p: Column, position: Column, u: Column, strategy: Column, side: float) -> Column:
    width, _, left = (_of(strategy, k) * side for k in range(3))
    dx, dy = p["x"] - position["x"], p["y"] - position["y"]
    ahead, aside = dx * u["x"] + dy * u["y"], dx * -u["y"] + dy * u["x"]
    return ahead.between(0, side) & aside.between(left - width / 2, left + width / 2)


def raster_transform(position: Column, u: Column, strategy: Column, side: float, width: int) -> Column:
    """The affine transform (a, b, c, d, e, f) of a crop of `width` pixels a box side: x = a col + b row + c, y = d col + e row + f."""
    res = side / width
    across, ahead, left = (_of(strategy, k) * side for k in range(3))
    cx = position["x"] + u["x"] * ahead - u["y"] * left
    cy = position["y"] + u["y"] * ahead + u["x"] * left
    # columns run along (u.y, -u.x), rows against u
    c = cx - u["y"] * across / 2 + u["x"] * side / 2
    f = cy + u["x"] * across / 2 + u["y"] * side / 2
    return F.struct((u["y"] * res).alias("a"), (-u["x"] * res).alias("b"), c.alias("c"), (-u["x"] * res).alias("d"), (-u["y"] * res).alias("e"), f.alias("f"))


def to_world(transform: Column, row: Column, col: Column) -> Column:
    return point(transform["a"] * col + transform["b"] * row + transform["c"], transform["d"] * col + transform["e"] * row + transform["f"])


def canvas(bounds: Column, width: int, height: int, padding: int) -> Column:
    """(scale, offset_x, offset_y) that fits bounds (xmin, ymin, xmax, ymax) into a canvas whose y runs down."""
    scale = F.least((width - 2 * padding) / (bounds["xmax"] - bounds["xmin"]), (height - 2 * padding) / (bounds["ymax"] - bounds["ymin"]))
    return F.struct(scale.alias("scale"), (padding - bounds["xmin"] * scale).alias("offset_x"), (height - padding + bounds["ymin"] * scale).alias("offset_y"))


def to_pixel(p: Column, t: Column) -> Column:
    return point(p["x"] * t["scale"] + t["offset_x"], t["offset_y"] - p["y"] * t["scale"])


def from_pixel(p: Column, t: Column) -> Column:
    return point((p["x"] - t["offset_x"]) / t["scale"], (t["offset_y"] - p["y"]) / t["scale"])


def zoomed(t: Column, centre: Column, zoom: Column, width: int, height: int) -> Column:
    """The transform at a zoom (clamped to 1..10) that puts the centre in the middle; at 1 it stays."""
    z = F.least(F.lit(10.0), F.greatest(F.lit(1.0), zoom))
    scale = t["scale"] * z
    return F.struct(scale.alias("scale"), F.when(z == 1, t["offset_x"]).otherwise(width / 2 - centre["x"] * scale).alias("offset_x"), F.when(z == 1, t["offset_y"]).otherwise(height / 2 + centre["y"] * scale).alias("offset_y"))


def grown_bounds(boxes: Column, a: Column, b: Column, percent: float = 0.1) -> Column:
    """Bounds of a and b padded by half their distance, grown by each box in order that meets what there is so far, and padded."""
    pad = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) / 2
    start = F.struct((F.least(a["x"], b["x"]) - pad).alias("xmin"), (F.least(a["y"], b["y"]) - pad).alias("ymin"), (F.greatest(a["x"], b["x"]) + pad).alias("xmax"), (F.greatest(a["y"], b["y"]) + pad).alias("ymax"))

    def grow(s: Column, q: Column) -> Column:
        meets = (q["xmin"] <= s["xmax"]) & (q["xmax"] >= s["xmin"]) & (q["ymin"] <= s["ymax"]) & (q["ymax"] >= s["ymin"])
        return F.when(meets, F.struct(F.least(s["xmin"], q["xmin"]).alias("xmin"), F.least(s["ymin"], q["ymin"]).alias("ymin"), F.greatest(s["xmax"], q["xmax"]).alias("xmax"), F.greatest(s["ymax"], q["ymax"]).alias("ymax"))).otherwise(s)

    def padded(s: Column) -> Column:
        dx, dy = (s["xmax"] - s["xmin"]) * percent, (s["ymax"] - s["ymin"]) * percent
        return F.struct((s["xmin"] - dx).alias("xmin"), (s["ymin"] - dy).alias("ymin"), (s["xmax"] + dx).alias("xmax"), (s["ymax"] + dy).alias("ymax"))

    return F.aggregate(boxes, start, grow, padded)
