"""Bounded labelled samples and small linear models over hashed text features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: F.Column) -> F.Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most `rows` labelled documents that are not held out, those first in the order of a hash of their id.
    Rows without a label or an id are left out; of several labels the largest counts, and of several documents of one id that whose
    text has the least hash, so that no id brings more than one row. The ids are bounded by `rows`, so they can be sent to all
    tasks."""
    named = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    chosen = named.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id").agg(F.max("_label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("first.text", "label")


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.rate, self.t = np.zeros(size), np.zeros(size), rate, 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Rows:
    """Sparse rows: features, values and where each row starts."""

    def __init__(self, features: np.ndarray, values: np.ndarray, lengths: np.ndarray, size: int) -> None:
        self.features, self.values, self.size = features, values, size
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.n = len(lengths)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * w[self.features], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.features, weights=self.values * g[self.row], minlength=self.size)
