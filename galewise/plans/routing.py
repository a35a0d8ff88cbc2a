"""Route experiments: scenes x windows x directions x configurations, each run a row of its own.

A scene's obstacles are packed into one row (keys in order, polygons of each) and joined to its runs; a run needs nothing else. The runs of a
scene are flown one after the other in one task and share what is prepared for it; scenes are flown side by side.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.kernels import routes, shapes

PACKED = "array<array<array<struct<x:double,y:double>>>>"
RESULT = "run_id string, scene string, window_size int, direction string, config string, path array<array<struct<x:double,y:double>>>, length double, success boolean, success_intermediate boolean, is_pred_path_valid boolean, num_segments int, error string"


def packed(obstacles: DataFrame, n_keys: int) -> DataFrame:
    """(scene, keys): for each key index the list of polygons, from rows (scene, t_idx, obstacle_id, ring)."""
    by_key = obstacles.groupBy("scene", "t_idx").agg(F.array_sort(F.collect_list(F.struct("obstacle_id", "ring"))).alias("o")).select("scene", "t_idx", F.transform("o", lambda x: x["ring"]).alias("rings"))
    by_scene = by_key.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("t_idx", "rings"))).alias("m"))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    return by_scene.select("scene", F.transform(F.sequence(F.lit(0), F.lit(n_keys - 1)), lambda t: F.coalesce(F.try_element_at("m", t), none)).alias("keys"))


def experiments(scenarios: DataFrame, windows: tuple[int, ...], configs: tuple[str, ...]) -> DataFrame:
    """Both directions of each scenario for each window and configuration."""
    both = F.explode(F.array(F.struct(F.lit("A->B").alias("direction"), F.col("ax").alias("sx"), F.col("ay").alias("sy"), F.col("bx").alias("ex"), F.col("by").alias("ey")), F.struct(F.lit("B->A").alias("direction"), F.col("bx").alias("sx"), F.col("by").alias("sy"), F.col("ax").alias("ex"), F.col("ay").alias("ey"))))
    rows = scenarios.select("scene", both.alias("d"), F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_size")).select("scene", "window_size", "d.*")
    rows = rows.withColumn("config", F.explode(F.array(*[F.lit(c) for c in configs])))
    return rows.withColumn("run_id", F.concat_ws("|", "scene", "direction", "window_size", "config"))


def fly(runs: DataFrame, scenes: DataFrame, rules: routes.Rules = routes.Rules(), masking: str | None = None, mode: str = "deterministic", side: float = 250_000.0) -> DataFrame:
    """Results of all runs. config: master, greedy, smooth, or corrected (a step's end is led out of the next key's obstacles). With masking, only obstacles in the box ahead are known; mode predictive knows
    the current ones and takes them to stay. A run that fails with an error becomes a row with the error and no path."""
    met = runs.join(scenes, "scene").select("run_id", "scene", "window_size", "direction", "config", "sx", "sy", "ex", "ey", "keys")
    met = met.repartition(max(1, met.sparkSession.sparkContext.defaultParallelism * 4), F.xxhash64("scene")).sortWithinPartitions("scene")  # the runs of a scene share what is prepared for it; by a hash, as a join's own partitions would be made fewer

    def one(row: dict, keys: list[routes.Obstacles], ready) -> dict:
        out = {k: row[k] for k in ("run_id", "scene", "window_size", "direction", "config")} | {"path": [], "length": 0.0, "success": False, "success_intermediate": False, "is_pred_path_valid": None, "num_segments": 0, "error": None}
        own = routes.Rules(row["window_size"], rules.step, rules.buffer, rules.tolerance, rules.neighbours, row["config"] if row["config"] in routes.TUNERS else None, row["config"] == "corrected")
        start, end = (row["sx"], row["sy"]), (row["ex"], row["ey"])
        try:
            flight = routes.fly(start, end, keys, own, ready()) if masking is None else fly_masked(start, end, keys, own, masking, mode, side)
        except (ValueError, ArithmeticError, IndexError) as e:
            return out | {"error": f"{type(e).__name__}: {e}"}
        whole = [p for s in flight.segments for p in s]
        valid = None if masking is None else not any(keys[i].blocks(a, b) for i, s in enumerate(flight.segments) if i < len(keys) for a, b in zip(s, s[1:], strict=False))
        return out | {"path": [[{"x": x, "y": y} for x, y in s] for s in flight.segments], "length": routes.length(whole), "success": flight.success, "success_intermediate": flight.intermediate, "is_pred_path_valid": valid, "num_segments": flight.t}

    def run(batches):
        scene, keys, ready = None, [], None
        for batch in batches:
            names, at = batch.column("scene").to_pylist(), batch.column("keys")
            for k, row in enumerate(batch.drop_columns(["keys"]).to_pylist()):
                if names[k] != scene or ready is None:
                    scene, keys = names[k], [routes.Obstacles([[(p["x"], p["y"]) for p in ring] for ring in rings]) for rings in at[k].as_py()]
                    ready = functools.cache(functools.partial(routes.prepared, keys, rules))
                yield pa.RecordBatch.from_pylist([one(row, keys, ready)], schema=_arrow())

    return met.mapInArrow(run, RESULT)


def _arrow() -> pa.Schema:
    line = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    return pa.schema([("run_id", pa.string()), ("scene", pa.string()), ("window_size", pa.int32()), ("direction", pa.string()), ("config", pa.string()), ("path", line), ("length", pa.float64()), ("success", pa.bool_()), ("success_intermediate", pa.bool_()), ("is_pred_path_valid", pa.bool_()), ("num_segments", pa.int32()), ("error", pa.string())])


def box_ahead(p, u, strategy: str, side: float):
    from galewise.functions.boxes import STRATEGIES

    width, ahead, left = (k * side for k in STRATEGIES[strategy])
    cx, cy = p[0] + u[0] * ahead - u[1] * left, p[1] + u[1] * ahead + u[0] * left
    corner = lambda across, along: (cx + u[1] * across + u[0] * along, cy - u[0] * across + u[1] * along)
    w, h = width / 2, side / 2
    return [corner(-w, -h), corner(w, -h), corner(w, h), corner(-w, h)]


def fly_masked(start, end, keys, rules: routes.Rules, strategy: str, mode: str, side: float) -> routes.Flight:
    """Fly with what is seen in the box ahead. What the last step saw and the box has left is remembered at the current key."""
    if mode not in ("deterministic", "predictive"):
        raise ValueError(f"no such mode: {mode}")
    flight, remembered, heading = routes.Flight(tuple(start)), [], None
    while flight.position != tuple(end) and flight.t < len(keys) - rules.window + 1:
        aim = (end[0] - flight.position[0], end[1] - flight.position[1])
        if flight.segments:
            legs = [(a, b) for a, b in zip(flight.segments[-1], flight.segments[-1][1:], strict=False) if math.dist(a, b) > 1e-6]
            heading = (legs[-1][1][0] - legs[-1][0][0], legs[-1][1][1] - legs[-1][0][1]) if legs else heading
        heading = heading or aim
        n = math.hypot(*heading)
        if n < 1e-6:
            raise ValueError("no direction")
        box = box_ahead(flight.position, (heading[0] / n, heading[1] / n), strategy, side)
        seen = []
        for i in range(rules.window):
            rings = keys[flight.t + (i if mode == "deterministic" else 0)].rings
            seen.append([r for r in (shapes.clip_to_convex(ring, box) for ring in rings) if len(r) > 2])
        zone = routes.Obstacles([box])
        past = [r for r in remembered if not any(zone.holder(tuple(p)) is not None for p in r)]
        remembered = past + seen[0]
        local = [routes.Obstacles(seen[0] + past), *(routes.Obstacles(s) for s in seen[1:])]
        vertices = routes.corners(local, rules)
        master = routes.Master(local, vertices, rules.tolerance, rules.neighbours)
        step = routes.Flight(flight.position)
        going = routes.take_step(step, tuple(end), local, rules, master, vertices)
        flight.intermediate &= step.intermediate
        flight.success &= step.success
        flight.segments += step.segments
        flight.position, flight.t = step.position, flight.t + 1
        if not going:
            break
    if flight.position != tuple(end):
        flight.success = False
        flight.segments.append([flight.position, tuple(end)])
    return flight


def static_routes(pairs: DataFrame, scenes: DataFrame, rules: routes.Rules = routes.Rules()) -> DataFrame:
    """(scene, name, path, length) of the shortest path around a scene's first key; null where there is none."""
    schema = "scene string, name string, path array<struct<x:double,y:double>>, length double"
    line = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    met = pairs.join(scenes, "scene").select("scene", "name", "ax", "ay", "bx", "by", F.get("keys", F.lit(0)).alias("rings"))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = routes.static_route((row["ax"], row["ay"]), (row["bx"], row["by"]), [[(p["x"], p["y"]) for p in ring] for ring in row["rings"]], rules)
                out.append((row["scene"], row["name"], None if path is None else [{"x": x, "y": y} for x, y in path], None if path is None else routes.length(path)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), line, pa.float64()))], names=["scene", "name", "path", "length"])

    return met.mapInArrow(run, schema)
