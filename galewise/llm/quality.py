"""Ordinal quality classifier: cumulative-link regression on graded ratings.

Every grade shares one weight vector over hashed features of a text; ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold[k] - w.x). The result is the expected grade and the probability of at least
the grade that is to be selected.

Features are rates over the words of the whole text: the hashed word, its hashed shape (letter case, digits and
runs of signs) and whether it repeats the word before it. So a word adds one number to the score, which each
worker keeps for the words it has seen.

Scale: the model is fitted on the driver from at most `train_rows` labelled documents (a documented bound);
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise.llm.common import LOWER, fresh, mapped_with, per_batch, sliced, texts_of
from galewise.llm.learning import Adam, Rows, held_out, labelled_sample, sigmoid

#: Most labelled documents that the model is fitted on.
TRAIN_ROWS = 6_000
SIZE = 1 << 18
REPEATS, FEW = 0, 1
STEPS = 150
#: Words that a worker keeps the weight of; a cache only.
CACHED_WORDS = 500_000
#: Letters, other case, digits; signs stay.
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def word_features(word: bytes) -> tuple[int, int]:
    """Hashed word and hashed shape; places 0 and 1 are for features of the whole text."""
    shape = _RUNS.sub(rb"\1\1", word.translate(_SHAPE))
    return 2 + zlib.crc32(word.translate(LOWER)) % (SIZE - 2), 2 + zlib.crc32(shape, 1) % (SIZE - 2)


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and their rates over the words of a text."""
    words = text.split()
    n = len(words)
    counts: dict[int, float] = {FEW: 1.0 / (1 + n)}
    if n:
        counts[REPEATS] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
        for word in words:
            for f in word_features(word):
                counts[f] = counts.get(f, 0.0) + 1 / n
    return np.fromiter(counts, dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=np.float64, count=len(counts))


class Ordinal:
    """Fitted weights, thresholds and grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> None:
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    @classmethod
    def fit(cls, x: Rows, labels: np.ndarray, steps: int = STEPS, l2: float = 1e-6) -> Ordinal:
        """Full-batch likelihood. One grade alone gives that grade for all; no rows give grade 0."""
        grades = np.unique(labels) if len(labels) else np.zeros(1, dtype=np.int64)
        k = len(grades)
        if k == 1:
            return cls(np.zeros(x.size), np.zeros(0), grades)
        y = np.searchsorted(grades, labels)
        share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
        first = np.log(share / (1 - share))
        w, t = np.zeros(x.size), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        down_w, down_t = Adam(x.size, 0.3), Adam(k - 1, 0.05)
        for _ in range(steps):
            g_w, g_t = cls.gradients(x, y, w, t)
            w += down_w.step(g_w + l2 * w)
            t += down_t.step(g_t)
        return cls(w, cls.cuts(t), grades)

    @staticmethod
    def cuts(t: np.ndarray) -> np.ndarray:
        """Ordered thresholds of free numbers: the first, and the logarithms of the steps between them."""
        return t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))])

    @classmethod
    def gradients(cls, x: Rows, y: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean negative log likelihood of the grades' places y, by the weights and by the thresholds' free numbers."""
        k, score, cut = len(t) + 1, x.times(w), np.concatenate([[-np.inf], cls.cuts(t), [np.inf]])
        high, low = sigmoid(cut[y + 1] - score), sigmoid(cut[y] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # of log p by the upper and the lower cut
        g_cut = -(np.bincount(y, weights=d_high, minlength=k)[:-1] - np.bincount(y, weights=d_low, minlength=k)[1:]) / len(y)
        return x.back((d_high - d_low) / len(y)), np.concatenate([[g_cut.sum()], [g_cut[i:].sum() * np.exp(t[i]) for i in range(1, k - 1)]])

    def judged(self, score: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of grade at_least or more."""
        below = sigmoid(self.thresholds[None, :] - score[:, None])
        cumulative = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        p = np.diff(cumulative, axis=1)
        return p @ self.grades, p[:, self.grades >= at_least].sum(1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Ordinal:
    """The model from at most train_rows labelled documents, none of them held out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [text_features(t) for t in texts_of(batch.column(0))]
        columns = [batch.column(1), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(columns, names=["label", "features", "rates"])

    rows = labelled_sample(docs, labels, label_col, train_rows, id_col, text_col).mapInArrow(per_batch(run), "label int, features array<int>, rates array<float>").toArrow().combine_chunks()
    label, features, rates = (rows.column(name).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type) for name in ("label", "features", "rates"))
    x = Rows(np.asarray(features.flatten()), np.asarray(rates.flatten()), np.asarray(features.value_lengths(), dtype=np.int64), SIZE)
    y = np.asarray(label)
    del rows, label, features, rates
    model = Ordinal.fit(x, y)
    pa.default_memory_pool().release_unused()  # the driver has more to do
    return model


class _Scorer:
    def __init__(self, model: Ordinal) -> None:
        self.model, self.places, self.added = model, {}, np.zeros(1 << 16)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self.places) > CACHED_WORDS:
            self.places.clear()
        w, places = self.model.weights, self.places
        split = [t.split() for t in texts]
        n = np.array([len(x) for x in split], dtype=np.int64)
        words = [x for s in split for x in s]
        for word in set(words).difference(places):
            at = places[word] = len(places)
            if at >= len(self.added):
                self.added = np.concatenate([self.added, np.zeros_like(self.added)])
            a, b = word_features(word)
            self.added[at] = w[a] + w[b]
        at = np.fromiter(map(places.__getitem__, words), dtype=np.int64, count=len(words))
        text = np.repeat(np.arange(len(n)), n)
        same = np.concatenate([[False], (at[1:] == at[:-1]) & (text[1:] == text[:-1])]) if len(at) else np.zeros(0, dtype=bool)
        total = np.bincount(text, weights=self.added[at] + w[REPEATS] * same, minlength=len(n))
        return total / np.maximum(n, 1) + w[FEW] / (1 + n)


def with_grades(docs: DataFrame, model: Ordinal, at_least: int = 1, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the expected grade and tail probability of each row, and the names of these columns. Null and empty texts are judged by
    having no words."""
    score = fresh(docs.columns, "_expected")
    tail = fresh([*docs.columns, score], "_tail")
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        scorer = _Scorer(sent.value)
        for batch in sliced(batches):
            expected, p = sent.value.judged(scorer(texts_of(batch.column(at))), at_least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(p)], names=[*batch.schema.names, score, tail])

    return mapped_with(docs, run, [T.StructField(score, T.DoubleType()), T.StructField(tail, T.DoubleType())]), score, tail


def graded(docs: DataFrame, labels: DataFrame, label_col: str = "quality", at_least: int = 1, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: id, held_out, expected_grade, p_selected (probability of grade at_least or more), kept.

    A null text is empty. Repeated rows give repeated rows, an empty table none. Without labels every text has grade 0 for sure and
    nothing is kept unless at_least is 0. Other columns are ignored.
    """
    model = fit(docs, labels, label_col, id_col, text_col, train_rows)
    own, score, tail = with_grades(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), model, at_least, text_col)
    return own.select(id_col, held_out(F.col(id_col)).alias("held_out"), F.col(score).alias("expected_grade"), F.col(tail).alias("p_selected"), (F.col(tail) >= keep_from).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, label_col: str = "quality", at_least: int = 1, keep_from: float = 0.5, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier keeps, with the same columns, whatever their names.

    Null and empty texts are judged by having no words; texts of any length by all their words. Of repeated rows all stay or all go.
    Without labels nothing is kept unless at_least is 0. An empty table gives none.
    """
    model = fit(docs, labels, label_col, id_col, text_col, train_rows)
    own, _, tail = with_grades(docs, model, at_least, text_col)
    return own.filter(F.col(tail) >= keep_from).select(*[F.col(f"`{c}`") for c in docs.columns])
