"""Toxicity after noisy-channel deobfuscation.

What a writer meant is decoded from what stands there: each sign of a suspicious word opens a few letters (itself,
the letters it is drawn for, nothing), and a Viterbi search through that lattice finds the letters which the
channel's costs and a character trigram model make likeliest. Suspicious are words with digits or signs among
letters, letters of another script that look alike, a letter three times in a row, letters cut by points or
hyphens, and single letters set apart by spaces. Words as they stand and as restored are scored together.

The character model counts the trigrams of all documents: partial sums of a fixed 27^3 table a task. The score is a
logistic regression on the presence of hashed words and word beginnings, fitted on the driver on at most
`train_rows` labelled documents that are not held out; only features which tell the classes apart stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import per_batch, sliced, texts_of
from galewise.llm.learning import Adam, Rows, held_out, labelled_sample, sigmoid

#: Most labelled documents that the model is fitted on.
TRAIN_ROWS = 12_000
SIZE = 1 << 22
THRESHOLD = 0.7
CACHED_WORDS = 400_000
#: Letters that a sign is drawn for, likeliest first.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiouh", "%": "aeiou",
    "а": "a", "с": "c", "е": "e", "і": "i", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ο": "o", "α": "a", "ε": "e", "ι": "i",
}
_CODES = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 for b in range(256)], dtype=np.int64)
_SUSPECT = re.compile(r"(?=[^a-z]*[0-9@$!|+(<€£¡*#%]{3})[0-9@$!|+(<€£¡*#%.\-_]{3,}$|(?=.*[a-z])(?:.*[0-9@$!|+(<€£¡*#%асеіорѕтухоαει]|.*([a-z])\1\1|(?:[a-z][.\-_*~/\\])+[a-z]$)")
_EDGE = " .,;:?\"'()[]{}"
_JUNK_END = re.compile(r"(?:[%&*#$]{3,}|!{2,})$")
_DOUBLE = re.compile(r"(.)\1")
_CUT = ".-_*~/\\'`^"


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of letter trigrams; 0 stands for anything else, and a word begins anew after it."""
    x = _CODES[np.frombuffer(b"  " + b"  ".join(texts) + b" ", dtype=np.uint8)]
    before = x[:-2] * (x[1:-1] != 0)
    return np.bincount((before * 27 + x[1:-1]) * 27 + x[2:], minlength=27**3)


class CharModel:
    """log P(letter | two before), interpolated with shorter contexts."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(27, 27, 27).astype(np.float64)
        c2 = c3.sum(0)
        p1 = (c2.sum(0) + 1) / (c2.sum() + 27)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)
        self.log = np.log(p3)
        self.rows = self.log.tolist()


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """From all texts: each task sends the sums of its batches, which meet in one table of 27^3 numbers."""

    def run(batches):
        total = np.zeros(27**3, dtype=np.int64)
        for batch in sliced(batches):
            total += trigram_counts(texts_of(batch.column(0)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    counts = np.zeros(27**3, dtype=np.int64)
    for row in docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 27^3 rows at most
        counts[row["gram"]] = row["n"]
    return CharModel(counts)


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each sign of a word, or run of one letter, the letters that it may stand for and what each of these costs. Of a repeated sign
    each may be another letter, or a repeat of the one before."""
    found = []
    for sign, own in groupby(word.lower()):
        times = len(list(own))
        if "a" <= sign <= "z":
            found.append([(sign * times, 0.0)] if times <= 2 else [(sign, 0.5), (sign * 2, 1.0)])
        elif sign in SIGNS:
            letters = [(letter, 0.4 + 0.3 * rank) for rank, letter in enumerate(SIGNS[sign])]
            found += [[*letters, ("", 20.0 if k == 0 else 8.0 if k == 1 else 4.0)] for k in range(times)]
        else:
            found.append([("", 0.2 if sign in _CUT else 1.0)])
    return found


def restore(word: str, model: CharModel) -> str:
    """The likeliest letters behind a word: the cheapest way through its lattice, with the model's cost of each letter and of the end."""
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ways in lattice(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in beams.items():
            for letters, price in ways:
                x, y, total = a, b, cost + price
                for letter in letters:
                    z = ord(letter) - 96
                    total -= model.rows[x][y][z]
                    x, y = y, z
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (text, letters) if letters else text)
        beams = after
    return "".join(_unrolled(min(((cost - model.rows[a][b][0], text) for (a, b), (cost, text) in beams.items()), key=lambda x: x[0])[1]))


def _unrolled(last: tuple | None) -> list[str]:
    """What a way has gone through, from its last step back, in order."""
    found = []
    while last is not None:
        last, own = last
        found.append(own)
    return found[::-1]


def drawn(word: str) -> str:
    """The letters with which each sign goes first, whatever the model says: it knows little of words that nobody writes plainly."""
    return "".join(letters for ways in lattice(word) for letters, _ in ways[:1])


#: The cost of a word's end in a spaced run, and how much dearer than the best a way to cut it may be.
BREAK, SLACK = 1.5, 5.5


def restore_run(run: str, model: CharModel, price: float = BREAK) -> list[str]:
    """The likeliest words behind single signs set apart by spaces, where a word may end before any sign. Accented letters count as
    their base in the model and stay as they are."""
    signs = run.lower()
    beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for at, sign in enumerate(signs):
        base = unicodedata.normalize("NFD", sign)[0]
        if "a" <= base <= "z":
            ways = [(base, sign, 0.0)]
            if signs[max(0, at - 2) : at] == sign * 2 or signs[at + 1 : at + 3] == sign * 2 or signs[max(0, at - 1) : at + 2] == sign * 3:
                ways.append(("", "", 0.3))
        elif sign in SIGNS:
            ways = [(letter, letter, 0.4 + 0.3 * rank) for rank, letter in enumerate(SIGNS[sign])] + [("", "", 12.0)]
        else:
            ways = [("", "", 0.2 if sign in _CUT else 1.0)]
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in beams.items():
            starts = [(a, b, cost, text)] + ([(0, 0, cost + price - model.rows[a][b][0], (text, " "))] if b else [])
            for x, y, total, before in starts:
                for letter, kept, own in ways:
                    if letter:
                        z = ord(letter) - 96
                        state, sum_ = (y, z), total + own - model.rows[x][y][z]
                    else:
                        state, sum_ = (x, y), total + own
                    if state not in after or sum_ < after[state][0]:
                        after[state] = (sum_, (before, kept) if kept else before)
        beams = after
    _, last = min(((cost - model.rows[a][b][0], text) for (a, b), (cost, text) in beams.items()), key=lambda x: x[0])
    return "".join(_unrolled(last)).split()


def words_of_run(letters: str, model: CharModel, slack: float = SLACK) -> set[str]:
    """All words of the ways to cut a spaced run's letters that cost at most `slack` more than the best: the trigrams alone are too
    weak to find the one right way. Words may be of any length: what a word costs goes by its last two letters, so that the best ways to and
    from each place take linear time, and a word is drawn out only while some way through it is cheap enough."""
    codes = [ord(unicodedata.normalize("NFD", c)[0]) - 96 for c in letters]
    n, rows = len(codes), model.rows
    pair = lambda i: rows[codes[i - 2]][codes[i - 1]]  # behind a word's second letter or a later one
    first = lambda i: rows[0][codes[i - 1]]  # behind its first letter
    begin = [(BREAK if i else 0.0) - rows[0][0][c] for i, c in enumerate(codes)]
    # least costs of the ways to a place: all words ended, one letter into a word, more letters into it
    forth, one, more = [0.0] + [math.inf] * n, [math.inf] * (n + 1), [math.inf] * (n + 1)
    for i in range(1, n + 1):
        one[i] = forth[i - 1] + begin[i - 1]
        if i > 1:
            more[i] = min(one[i - 1] - first(i - 1)[codes[i - 1]], more[i - 1] - pair(i - 1)[codes[i - 1]] if i > 2 else math.inf)
        forth[i] = min(one[i] - first(i)[0], more[i] - pair(i)[0] if i > 1 else math.inf)
    # and of the ways on from there
    back, from_one, from_more = [0.0] * (n + 1), [math.inf] * (n + 1), [math.inf] * (n + 1)
    for i in range(n, 0, -1):
        on = lambda row: -row[codes[i]] + from_more[i + 1] if i < n else math.inf  # noqa: B023, E731
        from_one[i] = min(back[i] - first(i)[0], on(first(i)))
        from_more[i] = min(back[i] - pair(i)[0], on(pair(i))) if i > 1 else math.inf
        back[i - 1] = begin[i - 1] + from_one[i]
    most, found = forth[n] + slack + 1e-9, set()
    for start in range(n):
        total, at = forth[start] + begin[start], start + 1
        while total + (from_one if at == start + 1 else from_more)[at] <= most:
            row = first(at) if at == start + 1 else pair(at)
            if total - row[0] + back[at] <= most:
                found.add(letters[start:at])
            if at == n:
                break
            total -= row[codes[at]]
            at += 1
    return found


def bare(word: str) -> str:
    """A word in lower case without the signs around it."""
    return _JUNK_END.sub("", word.lower().strip(_EDGE)).strip(_EDGE)


def hashed(word: str) -> list[int]:
    """The word and its beginnings of four to six letters."""
    own = word.encode()
    found = [zlib.crc32(own) % SIZE]
    found += [zlib.crc32(word[:n].encode(), n) % SIZE for n in (4, 5, 6) if len(word) > n]
    return found


class Features:
    """Hashed features of texts, restored words among them."""

    def __init__(self, model: CharModel, only: frozenset[int] | None = None) -> None:
        self.model, self.only, self.known = model, only, {}

    def of_word(self, raw: bytes) -> tuple[int, ...]:
        word = bare(raw.decode("utf-8", "replace"))
        if not word:
            return ()
        found = hashed(word)
        if _SUSPECT.match(word):
            clean = word.rstrip("!*#%$")
            meant = {restore(word, self.model), restore(clean, self.model), drawn(clean)}
            for text in meant | {_DOUBLE.sub(r"\1", x) for x in meant}:
                if len(text) > 2:
                    found += hashed(text)
        return tuple(x for x in found if self.only is None or x in self.only)

    def of_text(self, text: bytes) -> set[int]:
        words, known, found = text.split(), self.known, set()
        for word in set(words):
            own = known.get(word)
            if own is None:
                if len(known) > CACHED_WORDS:
                    known.clear()
                own = known[word] = self.of_word(word)
            if own:
                found.update(own)
        for spaced in _spaced(words):
            meant = {restore(spaced, self.model), *words_of_run("".join(restore_run(spaced, self.model)), self.model)}
            for text in meant | {_unaccented(x) for x in meant}:
                if len(text) > 2:
                    found.update(x for x in hashed(text) if self.only is None or x in self.only)
        return found


def _unaccented(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _is_single(word: bytes) -> bool:
    """Whether a word of two to four bytes is one code point."""
    return word[0] >= 0xC2 and len(word) == (2 if word[0] < 0xE0 else 3 if word[0] < 0xF0 else 4)


def _spaced(words: list[bytes]) -> list[str]:
    """Runs of three or more single signs, put together, and runs of three or more pieces of one or two letters in which there are
    both."""
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    single = lengths == 1
    for at in np.flatnonzero((lengths > 1) & (lengths <= 4)).tolist():
        single[at] = _is_single(words[at])
    if not single.any():
        return []
    found = [b"".join(words[a:b]) for a, b in _stretches(single) if b - a >= 3]
    short = single | (lengths == 2)
    found += [b"".join(words[a:b]) for a, b in _stretches(short) if b - a >= 3 and single[a:b].any() and not single[a:b].all()]
    return [x.decode("utf-8", "replace") for x in found]


def _stretches(marks: np.ndarray) -> list[list[int]]:
    """(start, end) of the runs of marks."""
    return np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))).reshape(-1, 2).tolist()


class Scorer:
    """Weights of the features that tell the classes apart."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = dict(zip(features.tolist(), weights.tolist(), strict=True)), bias

    def __call__(self, present: set[int]) -> float:
        return float(sigmoid(self.bias + math.fsum(self.weights[x] for x in present)))


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Scorer:
    """Logistic regression from at most train_rows labelled documents, none of them held out. Without labels the score is 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features = Features(sent.value)
        for batch in sliced(batches):
            found = [sorted(features.of_text(t)) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    table = labelled_sample(docs, labels, label_col, train_rows, id_col, text_col).mapInArrow(run, "label int, features array<int>").toArrow()
    if not table.num_rows:
        return Scorer(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    y = (np.asarray(table.column("label")) > 0).astype(np.float64)
    lists = table.column("features").combine_chunks()
    lengths, flat = np.asarray(lists.value_lengths(), dtype=np.int64), np.asarray(lists.flatten())
    row_y = np.repeat(y, lengths)
    ones, zeros = np.bincount(flat, weights=row_y, minlength=SIZE), np.bincount(flat, weights=1 - row_y, minlength=SIZE)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    p1, p0 = (ones + 0.1) / (n1 + 0.2), (zeros + 0.1) / (n0 + 0.2)
    spread = np.sqrt(np.maximum((ones + zeros) / (n1 + n0), 1e-9) * (1 / n1 + 1 / n0))
    telling = np.flatnonzero(((p1 - p0) / spread > 5) & (ones >= 4) & (p1 > 3 * p0))
    place = np.full(SIZE, -1, dtype=np.int64)
    place[telling] = np.arange(len(telling))
    kept = place[flat] >= 0
    per_row = np.bincount(np.repeat(np.arange(len(y)), lengths)[kept], minlength=len(y))
    x = Rows(place[flat[kept]], np.ones(int(kept.sum())), per_row, len(telling))
    w, b = np.zeros(len(telling)), np.array([math.log(n1 / n0)])
    down_w, down_b = Adam(len(telling), 0.05), Adam(1, 0.05)
    for _ in range(400):
        g = (sigmoid(x.times(w) + b[0]) - y) / len(y)
        w += down_w.step(x.back(g) + 2e-5 * w)
        b += down_b.step(np.array([g.sum()]))
    return Scorer(telling, w, float(b[0]))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of docs: id, held_out, score (0 to 1), predicted.

    Null and empty texts have no features; their score is the model's bias. Repeated rows get equal scores. Without labels all
    scores are 0.5. An empty table gives no rows; other columns are ignored.
    """
    model = char_model(docs, text_col)
    scorer = fit(docs, labels, model, label_col, id_col, text_col, train_rows)
    sent = docs.sparkSession.sparkContext.broadcast((model, scorer))

    def run(batches):
        chars, score = sent.value
        features = Features(chars, frozenset(score.weights))
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(features.of_text(t)) for t in texts_of(batch.column(1))], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def restored_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, word, restored) for each suspicious word of each text, as it stands and as decoded."""
    model = docs.sparkSession.sparkContext.broadcast(char_model(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            words = text.split()
            found = sorted({w for w in (bare(x.decode("utf-8", "replace")) for x in set(words)) if w and _SUSPECT.match(w)})
            out += [(name, w, restore(w, model.value)) for w in found]
            out += [(name, w, " ".join(restore_run(w, model.value))) for w in sorted(set(_spaced(words)) - set(found))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((batch.schema.field(0).type, pa.string(), pa.string()))], names=["id", "word", "restored"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(per_batch(run), f"id {kind}, word string, restored string").withColumnRenamed("id", id_col)
