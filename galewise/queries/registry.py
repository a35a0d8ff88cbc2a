"""Registers queries with their SQL."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    """Queries, oracles, and a decorator that registers a function under its name (a trailing underscore is dropped)."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            name = f.__name__.rstrip("_")
            queries[name] = f
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query


def rounded(df, digits: int = 6):
    """df with its doubles rounded, as its SQL does."""
    from pyspark.sql import functions as F

    return df.select(*[F.round(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
