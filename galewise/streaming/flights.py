"""Live twins of the batch operators: hourly windows over a stream of observations, last values, and flights that take a step with each frame."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galewise.kernels import routes
from galewise.kernels.experiment import Experiment


def hourly(observations: DataFrame, late: str = "50 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and totals of event-time windows; rows later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return observations.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "n", "total")


STATE = "x double, y double, t int, done boolean"
OUTPUT = "run_id string, t int, x double, y double, done boolean, success boolean"


def fly(frames: DataFrame, rules: routes.Rules = routes.Rules()) -> DataFrame:
    """Frames (run_id, t_idx, sx, sy, ex, ey, rings as lists of [x, y] lists) come in order of t_idx for each run; each moves its aircraft one
    step around that frame's obstacles. State: where it is, and whether it has come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, out = (state.get if state.exists else None), []
        for batch in batches:
            for row in batch.sort_values("t_idx").itertuples(index=False):
                x, y, t, done = known if known else (row.sx, row.sy, 0, False)
                if not done:
                    o = routes.Obstacles([[tuple(p) for p in ring] for ring in row.rings])
                    vertices = routes.corners([o], rules)
                    flight, end = routes.Flight((x, y)), (row.ex, row.ey)
                    routes.take_step(flight, end, [o], rules, routes.Master([o], vertices, rules.tolerance, rules.neighbours), vertices)
                    (x, y), t, done = flight.position, t + 1, math.dist(flight.position, end) < 1e-6
                    out.append((key[0], t, x, y, done, flight.success))
                known = (x, y, t, done)
        if known:
            state.update(known)
        yield pd.DataFrame(out, columns=["run_id", "t", "x", "y", "done", "success"])

    return frames.groupBy("run_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


CLICKS = "experiment_id string, seq long, action string, x double, y double, ax double, ay double, bx double, by double"
EXPERIMENT = "experiment_id string, seq long, t int, x double, y double, complete boolean, segments int, distance_m double"


def experiments(clicks: DataFrame) -> DataFrame:
    """A person's flights from a stream of actions (CLICKS, in order of seq for each experiment): a row for each confirmed segment. The state
    is the actions' outcome, kept as text."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = _from_text(state.get[0]) if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values("seq").itertuples(index=False):
                now = now or Experiment((row.ax, row.ay), (row.bx, row.by)).started()
                after = now.act(row.action, row.x, row.y)
                if len(after.flown) > len(now.flown):
                    out.append((key[0], row.seq, after.t, *after.position, after.complete, len(after.flown), sum(map(routes.length, after.flown))))
                now = after
        if now:
            state.update((json.dumps(asdict(now)),))
        yield pd.DataFrame(out, columns=["experiment_id", "seq", "t", "x", "y", "complete", "segments", "distance_m"])

    return clicks.groupBy("experiment_id").applyInPandasWithState(step, EXPERIMENT, "text string", "append", GroupStateTimeout.NoTimeout)


def _from_text(text: str) -> Experiment:
    raw = json.loads(text)
    pair = lambda v: None if v is None else tuple(v)
    return Experiment(**raw | {k: pair(raw[k]) for k in ("a", "b", "position", "heading", "layers")} | {"drawn": tuple(map(tuple, raw["drawn"])), "flown": tuple(tuple(map(tuple, s)) for s in raw["flown"])})
