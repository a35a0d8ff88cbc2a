"""Frames as pixel rows: masks, crops, pooling, regions; and kernels a frame at a time in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.kernels import cells


def masked(value: Column, low: int, high: int) -> Column:
    """Strictly between: the high value means no data."""
    return (value > low) & (value < high)


def to_zero(value: Column, threshold: int) -> Column:
    return F.when(value > threshold, value).otherwise(0)


def crops(frames: DataFrame, borders: DataFrame) -> DataFrame:
    """Pixels of each border's window, with their place in it. Borders are a handful of rows."""
    inside = F.col("row").between(F.col("y_start"), F.col("y_end") - 1) & F.col("col").between(F.col("x_start"), F.col("x_end") - 1)
    return frames.join(F.broadcast(borders), inside).withColumn("row", F.col("row") - F.col("y_start")).withColumn("col", F.col("col") - F.col("x_start")).drop("y_start", "y_end", "x_start", "x_end")


def _targets(at: Column, size: int, target: int) -> Column:
    """Output cells that share area with a source cell."""
    return F.sequence(F.floor(at * target / size).cast("int"), (F.ceil((at + 1) * target / size) - 1).cast("int"))


def max_pooled(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], by: tuple = ("frame_id",)) -> DataFrame:
    """The largest value under each output cell; for fractional ratios cells overlap."""
    spread = pixels.withColumn("r", F.explode(_targets(F.col("row"), size[0], target[0]))).withColumn("c", F.explode(_targets(F.col("col"), size[1], target[1])))
    return spread.groupBy(*by, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max("value").alias("value"))


def area_resized(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int], by: tuple = ("frame_id",)) -> DataFrame:
    """Area-weighted mean of each output cell."""
    spread = pixels.withColumn("r", F.explode(_targets(F.col("row"), size[0], target[0]))).withColumn("c", F.explode(_targets(F.col("col"), size[1], target[1])))

    def share(at: str, out: str, s: int, t: int) -> Column:
        return F.least((F.col(at) + 1) * t / s, F.col(out) + 1) - F.greatest(F.col(at) * t / s, F.col(out).cast("double"))

    weighted = spread.withColumn("w", share("row", "r", size[0], target[0]) * share("col", "c", size[1], target[1]))
    return weighted.groupBy(*by, F.col("r").alias("row"), F.col("c").alias("col")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def side_by_side(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    return left.unionByName(right.withColumn("col", F.col("col") + width))


def labelled(at: np.ndarray, side: int) -> np.ndarray:
    """For sorted pixel numbers (row * side + column) the smallest of each one's 4-connected region: neighbours take over the smaller
    label, labels the label of what they point to, until nothing changes."""
    edges = []
    for step in (1, side):
        to = np.searchsorted(at, at + step)
        met = (to < len(at)) & (at[np.minimum(to, len(at) - 1)] == at + step)
        if step == 1:
            met &= (at + 1) % side != 0
        edges.append(np.stack([np.flatnonzero(met), to[met]]))
    a, b = np.concatenate(edges, axis=1)
    label = np.arange(len(at))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return at[label]
        label = new


def regions(pixels: DataFrame, keep: Column, side: int, key: str = "frame_id") -> DataFrame:
    """(frame, row, col, region) for 4-connected regions; a region is named by its smallest pixel number, row * side + col, where side is no
    less than the number of columns. One frame is a row, so that frames are labelled side by side."""
    packed = pixels.filter(keep).groupBy(key).agg(F.sort_array(F.collect_list(F.col("row").cast("long") * side + F.col("col"))).alias("at"))
    kind = dict(packed.dtypes)[key]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            at = lists.flatten().to_numpy()
            edges = np.cumsum([0, *(len(x) for x in lists)])
            region = np.concatenate([labelled(at[a:b], side) for a, b in zip(edges, edges[1:], strict=False)]) if len(lists) else at
            frames = batch.column(0).take(pa.array(np.repeat(np.arange(len(lists)), np.diff(edges))))
            yield pa.RecordBatch.from_arrays([frames, pa.array((at // side).astype(np.int32)), pa.array((at % side).astype(np.int32)), pa.array(region)], names=[key, "row", "col", "region"])

    return packed.mapInArrow(run, f"{key} {kind}, row int, col int, region long")


def outlines(regions_: DataFrame, keys: tuple = ("frame_id", "region")) -> DataFrame:
    """(keys, n_pixels, rings) of regions (keys, row, col): rings of corners (x = column, y = row), the outer one first, then the holes'.

    A pixel's side is part of an outline where no pixel of the region is on its other side: four equi-joins would find that, one count
    does, as an inner side is named by two pixels. Sides go round the region with it on the left; where two pixels touch at a
    corner only, the outline stays with its pixel."""
    r, c = F.col("row"), F.col("col")
    side = lambda a, b, d, e: F.struct(a.alias("y0"), b.alias("x0"), d.alias("y1"), e.alias("x1"))
    sides = F.array(side(r, c, r + 1, c), side(r + 1, c, r + 1, c + 1), side(r + 1, c + 1, r, c + 1), side(r, c + 1, r, c))
    spread = regions_.select(*keys, F.explode(sides).alias("s"))
    s = F.col("s")
    inner = [F.least(s["y0"], s["y1"]), F.least(s["x0"], s["x1"]), s["y0"] == s["y1"]]
    outer = spread.groupBy(*keys, *[x.alias(n) for x, n in zip(inner, ("ya", "xa", "flat"), strict=True)]).agg(F.count("*").alias("n"), F.first("s").alias("s")).filter("n = 1")
    packed = outer.groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("sides"))
    sizes = regions_.groupBy(*keys).agg(F.count("*").alias("n_pixels"))
    names = [*keys, "n_pixels", "sides"]
    met = packed.join(sizes, list(keys)).select(*names)
    kinds = dict(met.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "n_pixels")) + ", rings array<array<struct<x:double,y:double>>>"
    rings_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches):
        for batch in batches:
            rings = [ringed([(e["y0"], e["x0"], e["y1"], e["x1"]) for e in sides]) for sides in batch.column(len(keys) + 1).to_pylist()]
            rings = [[[{"x": float(x), "y": float(y)} for y, x in ring] for ring in own] for own in rings]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(rings, rings_type)], names=[*keys, "n_pixels", "rings"])

    return met.mapInArrow(run, schema)


def ringed(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Directed sides, smallest first, chained into closed rings of the corners (y, x) where they turn. A ring begins at its smallest
    corner, where no other pixel touches, so that it is closed when it comes back there."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y0, x0, y1, x1 in sides:
        after.setdefault((y0, x0), []).append((y1, x1))
    rings = []
    for y0, x0, *_ in sides:
        if not after[y0, x0]:
            continue
        ring, at = [(y0, x0)], after[y0, x0].pop()
        while at != (y0, x0):
            ways = after[at]
            way = max(ways, key=lambda w: _turn(ring[-1], at, w))
            ways.remove(way)
            ring.append(at)
            at = way
        rings.append([p for before, p, next_ in zip([ring[-1], *ring[:-1]], ring, [*ring[1:], ring[0]], strict=True) if _turn(before, p, next_)])
    return rings


def _turn(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> int:
    """Over 0 for a turn towards the region's side, below for one away from it."""
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def to_world(rings: Column, transform: Column) -> Column:
    """Rings of pixel corners on the ground."""
    t = transform
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct((t["a"] * p["x"] + t["b"] * p["y"] + t["c"]).alias("x"), (t["d"] * p["x"] + t["e"] * p["y"] + t["f"]).alias("y"))))


def rotated(frames: DataFrame, side: int, ranges, seed: int = 42) -> DataFrame:
    """Each frame and one rotation for each angle range, by an angle drawn by a hash of (frame, range), so that reruns agree."""
    draws = [F.struct(F.lit(i).alias("k"), (a + (b - a) * F.pmod(F.xxhash64(F.lit(seed), "frame_id", F.lit(i)), F.lit(10_000)) / 10_000.0).alias("angle")) for i, (a, b) in enumerate(ranges)]
    spread = frames.withColumn("x", F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit(0.0).alias("angle")), *draws))).select("frame_id", "band", F.col("x.k").alias("k"), F.col("x.angle").alias("angle"))

    def run(batches):
        for batch in batches:
            bands = [cells.rotated(np.array(b).reshape(side, side), a).ravel().tolist() if k >= 0 else b for b, k, a in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int32())), batch.column(2), batch.column(3)], names=["frame_id", "band", "k", "angle"])

    return spread.mapInArrow(run, "frame_id long, band array<int>, k int, angle double")


def sequences(frames: DataFrame, size: int) -> DataFrame:
    """Windows of `size` consecutive frames by frame_id, as arrays of bands."""
    order = W.orderBy("frame_id") if "sequence_id" not in frames.columns else W.partitionBy("sequence_id").orderBy("frame_id")
    return frames.withColumn("bands", F.collect_list("band").over(order.rowsBetween(-(size - 1), 0))).filter(F.size("bands") == size)


def nowcast(sequences: DataFrame, side: int, steps: int, name: str = "ConvGRU", seed: int = 0) -> DataFrame:
    """(frame_id, step, band) predicted after each sequence; the model is made once a worker."""

    def run(batches):
        net = cells.model(name, side * side, seed)
        for batch in batches:
            out = []
            for frame, bands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, p in enumerate(net.predict(np.array(bands, dtype=float).reshape(len(bands), side, side), steps)):
                    out.append((frame, k + 1, p.ravel().tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["frame_id", "step", "band"])

    return sequences.select("frame_id", "bands").mapInArrow(run, "frame_id long, step int, band array<double>")


def errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean squared error of each predicted frame against the frame that came."""
    met = predicted.withColumn("at", F.col("frame_id") + F.col("step")).join(truth.select(F.col("frame_id").alias("at"), F.col("band").alias("true")), "at")
    return met.select("frame_id", "step", (F.aggregate(F.zip_with("band", "true", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("band")).alias("mse"))


def resampled(pixels: DataFrame, rasters: DataFrame, crops_: DataFrame) -> DataFrame:
    """(crop_id, row, col, value): the pixels of each crop (crop_id, path, transform, rows, cols), read from its raster by bilinear weights.

    rasters are (path, rows, cols, transform) and pixels (path, row, col, value), without those that are not there. The middle of an output pixel goes through both transforms;
    its four neighbours are found by equality, those off the raster or missing don't count, and where none is left, or the middle is off the
    raster, the value is 0."""
    src = rasters.select("path", F.col("transform").alias("s"), F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"))
    out = crops_.select("crop_id", "path", F.col("transform").alias("t"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols")
    out = out.select("crop_id", "path", "t", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col")).join(src, "path")
    t, s, c, r = F.col("t"), F.col("s"), F.col("col") + 0.5, F.col("row") + 0.5
    dx, dy = t["a"] * c + t["b"] * r + t["c"] - s["c"], t["d"] * c + t["e"] * r + t["f"] - s["f"]
    det = s["a"] * s["e"] - s["b"] * s["d"]
    out = out.select("crop_id", "path", "row", "col", "n_rows", "n_cols", ((s["e"] * dx - s["b"] * dy) / det).alias("u"), ((s["a"] * dy - s["d"] * dx) / det).alias("v"))
    low = lambda k: F.floor(F.col(k) - 0.5)
    share = lambda k, on: (F.col(k) - 0.5 - low(k)) if on else 1 - (F.col(k) - 0.5 - low(k))
    near = F.array(*[F.struct((low("v") + i).cast("int").alias("r"), (low("u") + j).cast("int").alias("c"), (share("v", i) * share("u", j)).alias("w")) for i in (0, 1) for j in (0, 1)])
    on = F.col("u").between(0, F.col("n_cols")) & F.col("v").between(0, F.col("n_rows"))
    asked = out.filter(on).select("crop_id", "path", "row", "col", F.explode(near).alias("x")).filter("x.w > 0").select("crop_id", "path", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("x.r").alias("row"), F.col("x.c").alias("col"), "x.w")
    met = asked.join(pixels.select("path", "row", "col", "value"), ["path", "row", "col"])
    values = met.groupBy("crop_id", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return out.select("crop_id", "row", "col").join(values, ["crop_id", "row", "col"], "left").fillna(0.0, ["value"])
