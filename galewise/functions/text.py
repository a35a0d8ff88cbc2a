"""Labels, colours, GeoJSON and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of obstacle layers in the order of time.
PALETTE = ("#FF6B6B", "#FF8E53", "#FFA94D", "#FFD43B", "#A9E34B", "#69DB7C", "#38D9A9")


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "—").otherwise(F.format_string("%.4f", p))


def mark(flag: Column) -> Column:
    return F.when(flag, "✓").otherwise("—")


def rgba(colour: Column, alpha: float) -> Column:
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10)
    return F.concat(F.lit("rgba("), part(2), F.lit(", "), part(4), F.lit(", "), part(6), F.lit(f", {alpha})"))


def colour_of(index: Column, palette: tuple = PALETTE) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(index, F.lit(len(palette))) + 1).cast("int"))


def is_convolutional(model: Column) -> Column:
    return model.startswith("Conv")


def checkpoint_name(model: Column) -> Column:
    return F.concat(model, F.lit(".pt"))


def window_label(size: Column) -> Column:
    return F.concat(F.lit("w"), size.cast("string"))


def polygon_json(rings: Column) -> Column:
    """GeoJSON geometry of a polygon on whole metres."""
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda p: F.concat(F.lit("["), p["x"].cast("long").cast("string"), F.lit(","), p["y"].cast("long").cast("string"), F.lit("]"))), ","), F.lit("]"))
    return F.concat(F.lit('{"type":"Polygon","coordinates":['), F.array_join(F.transform(rings, ring), ","), F.lit("]}"))


def feature_collection(polygons: Column) -> Column:
    """GeoJSON features of an array of polygons, numbered in order."""
    features = F.transform(polygons, lambda p, i: F.concat(F.lit('{"type":"Feature","geometry":'), polygon_json(p), F.lit(',"properties":{"id":'), i.cast("string"), F.lit("}}")))
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))
