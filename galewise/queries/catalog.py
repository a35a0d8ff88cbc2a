"""All operators' queries and their SQL, by name."""

from __future__ import annotations

from galewise.queries import graphs, rasters, service, simulation, spatial, statistics, temporal, vectors

MODULES = (statistics, temporal, vectors, spatial, graphs, rasters, service, simulation)


def all_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
