"""State of a person's flight: clicks add points, a confirmed segment moves the aircraft by one step."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from galewise.kernels import routes


@dataclass(frozen=True)
class Experiment:
    a: tuple[float, float]
    b: tuple[float, float]
    step: float = 75_000.0
    snap: float = 10_000.0
    position: tuple[float, float] | None = None
    drawn: tuple = ()
    flown: tuple = ()
    t: int = 0
    zoom: float = 1.0
    layers: tuple = ()
    complete: bool = False
    heading: tuple[float, float] = field(default=(0.0, 0.0))

    def started(self) -> Experiment:
        d = math.dist(self.a, self.b)
        return replace(self, position=self.a, drawn=(), flown=(), t=0, complete=False, layers=(), heading=((self.b[0] - self.a[0]) / d, (self.b[1] - self.a[1]) / d) if d else (0.0, 0.0))

    def at_goal(self, p) -> bool:
        return math.dist(p, self.b) <= self.snap

    def act(self, action: str, x: float | None = None, y: float | None = None, key: str | None = None) -> Experiment:
        """The state after an action; what makes no sense changes nothing."""
        if action == "start":
            return self.started()
        if action == "reset":
            return Experiment(self.a, self.b, self.step, self.snap)
        if action in ("zoom_in", "zoom_out"):
            return replace(self, zoom=min(10.0, max(1.0, self.zoom * (1.5 if action == "zoom_in" else 1 / 1.5))))
        if action == "add_layer":
            return self if key in self.layers else replace(self, layers=(*self.layers, key))
        if action == "remove_layer":
            return self if len(self.layers) < 2 else replace(self, layers=self.layers[:-1])
        if self.position is None or self.complete:
            return self
        if action == "waypoint":
            return replace(self, drawn=(*self.drawn, self.b if self.at_goal((x, y)) else (x, y)))
        if action == "confirm" and self.drawn:
            return self._confirmed()
        return self

    def _confirmed(self) -> Experiment:
        path = [self.position, *self.drawn]
        if routes.length(path) < self.step:
            if not self.at_goal(path[-1]):
                return self
            return replace(self, flown=(*self.flown, tuple(path)), drawn=(), position=self.b, complete=True)
        done, _ = routes.cut(path, self.step)
        end = done[-1]
        legs = [(p, q) for p, q in zip(done, done[1:], strict=False) if math.dist(p, q) > 0]
        heading = tuple((q - p) / math.dist(*legs[-1]) for p, q in zip(*legs[-1], strict=True)) if legs else self.heading
        goal = self.at_goal(end)
        return replace(self, flown=(*self.flown, tuple(done)), drawn=(), position=self.b if goal else end, t=self.t + 1, heading=heading, complete=goal)
