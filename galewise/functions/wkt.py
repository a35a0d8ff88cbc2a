"""Well-known text as column expressions, both ways. Numbers are written as Spark prints doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewise.functions.vectors import point


def _points(text: Column) -> Column:
    def one(p: Column) -> Column:
        xy = F.split(F.trim(p), "\\s+")
        return point(F.element_at(xy, 1).cast("double"), F.element_at(xy, 2).cast("double"))

    return F.transform(F.split(text, ","), one)


def _rings(text: Column) -> Column:
    """From '(a b, ...), (a b, ...)'."""
    return F.transform(F.split(F.regexp_replace(text, "^\\s*\\(|\\)\\s*$", ""), "\\)\\s*,\\s*\\("), _points)


def _body(text: Column, kind: str) -> Column:
    return F.regexp_extract(text, f"(?is)^\\s*{kind}\\s*\\((.*)\\)\\s*$", 1)


def polygons(text: Column) -> Column:
    """Array of polygons of a POLYGON or MULTIPOLYGON; empty for EMPTY, null for null and other text."""
    many = F.transform(F.split(F.regexp_replace(_body(text, "MULTIPOLYGON"), "^\\s*\\(|\\)\\s*$", ""), "\\)\\s*\\)\\s*,\\s*\\(\\s*\\("), lambda p: _rings(F.concat(F.lit("("), F.regexp_replace(p, "^\\s*\\(|\\)\\s*$", ""), F.lit(")"))))
    none = F.array().cast("array<array<array<struct<x:double,y:double>>>>")
    return F.when(text.rlike("(?i)^\\s*(MULTI)?POLYGON\\s+EMPTY"), none).when(text.rlike("(?i)^\\s*POLYGON"), F.array(_rings(_body(text, "POLYGON")))).when(text.rlike("(?i)^\\s*MULTIPOLYGON"), many)


def line(text: Column) -> Column:
    return F.when(text.rlike("(?i)^\\s*LINESTRING\\s+EMPTY"), F.array().cast("array<struct<x:double,y:double>>")).when(text.rlike("(?i)^\\s*LINESTRING"), _points(_body(text, "LINESTRING")))


def _write_points(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def polygon_text(polygon: Column) -> Column:
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(polygon, _write_points), ", "), F.lit(")"))


def multipolygon_text(shapes: Column) -> Column:
    body = F.transform(shapes, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, _write_points), ", "), F.lit(")")))
    return F.when(F.size(shapes) == 0, F.lit("MULTIPOLYGON EMPTY")).when(F.size(shapes) == 1, polygon_text(F.element_at(shapes, 1))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(body, ", "), F.lit(")")))


def line_text(points: Column) -> Column:
    return F.when(F.size(points) == 0, F.lit("LINESTRING EMPTY")).otherwise(F.concat(F.lit("LINESTRING "), _write_points(points)))
