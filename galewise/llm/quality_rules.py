"""Quality rules: distribution divergence from language references.

A document's histogram of character classes and its histogram of a language's commonest words are compared with
the references of each language by Jensen-Shannon distance; the closest language counts, so that a wrong or missing
language mark does no harm. Short texts, whose histograms say little, are not judged: there are least lengths for either.
References are the sums over all documents marked with the language, for languages with words enough; texts that are marked
with a language without a reference are not judged either.

Besides, there are base counts: characters in words, sign characters, repeated lines, and words in windows of five
that the text has more than once.

Scale: one pass over the texts, one task a split and no shuffle; the histograms are written as narrow rows, from which
the references (a few numbers for each of a fixed list of languages) and the verdicts are made. No Python runs on the
executors. Each text's words are one array of its row; windows are compared by 64-bit hashes, sorted within the row only
where a window is repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import SPACE_CLASS, SPACES, written

#: Common words of the languages that have references.
COMMON = {
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "nicht"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
LANGUAGES = tuple(COMMON)
WORDS = tuple(sorted({w for own in COMMON.values() for w in own}))
CLASSES = ("lower", "upper", "digit", "space", "point", "sign", "other")
SIGNS = "#*$%&|<>"
WINDOW = 5
#: Least words and characters of a text that is judged, and the distances from which it fails. The distance of words is taken
#: beyond what a sample of so many words from the reference itself has: sqrt(cells / (8 ln 2 words)).
LEAST_WORDS, LEAST_CHARS = 80, 200
MOST_WORDS_DISTANCE, MOST_CLASS_DISTANCE = 0.12, 0.33
#: Least words of a language's documents together, for a reference.
LEAST_REFERENCE = 2_000
SAMPLING = 12 / (8 * math.log(2))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, signs: str) -> Column:
    for sign in signs:
        text = F.replace(text, F.lit(sign), F.lit(""))
    return text


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))


def _repeated(hashes: Column) -> Column:
    """Words in windows (given by their hashes, in order) that are found twice or more."""

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        twice = F.filter(
            F.transform(pairs, lambda x, i: F.when(((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i + 1 < n) & (F.get(pairs, i + 1)["h"] == x["h"])), x["i"])),
            lambda x: x.isNotNull(),
        )
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(F.array_sort(twice), start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])

    sorted_pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(sorted_pairs, covered))


def _windows(words: Column) -> Column:
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW))))


def _common_counts(words: Column) -> Column:
    """How often each of WORDS is among the words, in their order."""
    found = F.filter(F.transform(words, F.lower), lambda w: w.isin(*WORDS))

    def counts(line: Column) -> Column:
        return F.array(*[((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("long") for w in WORDS])

    return _let(F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")), counts)


def _class_counts(text: Column) -> Column:
    """Code points of each class, in the order of CLASSES."""

    def rest(r: Column) -> Column:
        left = lambda pattern: F.length(r) - F.length(F.regexp_replace(r, pattern, ""))
        upper, digit, space, point, sign = left("[A-Z]+"), left("[0-9]+"), left(SPACE_CLASS + "+"), left("[.,;:?!'\"()-]+"), left("[#-&*-+/<-@\\[-`{-~]+")
        spaces = F.length(text) - F.length(_without(text, " "))
        other = F.length(r) - upper - digit - space - point - sign
        return F.array(F.length(text) - F.length(r) - spaces, upper, digit, space + spaces, point, sign, other)

    return _let(F.regexp_replace(text, "[a-z ]+", ""), rest).cast("array<long>")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes, commons) for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    text = F.col("text")
    lines = _let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _let(_windows(w), _repeated).alias("repeat"), _common_counts(w).alias("commons")))
    own = own.select("id", "lang", F.length(_without(text, SPACES)).cast("long").alias("word_chars"), (F.octet_length(text) - F.octet_length(_without(text, SIGNS))).cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"), F.length(text).cast("long").alias("n_chars"), _class_counts(text).alias("classes"), of_words.alias("w"))
    return own.select("id", "lang", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeat").cast("long").alias("n_repeat_words"), "n_chars", "classes", F.col("w.commons").alias("commons"))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each of LANGUAGES with documents: shares of the character classes, and of its common words and all other words."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(len(WORDS))]
    out = {}
    for row in rows.filter(F.col("lang").isin(*LANGUAGES)).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect():  # a row for each of LANGUAGES at most
        classes = [row[f"c{i}"] for i in range(len(CLASSES))]
        words = [row[f"w{WORDS.index(w)}"] for w in COMMON[row["lang"]]]
        if row["n"] >= LEAST_REFERENCE:
            out[row["lang"]] = ([c / max(1, sum(classes)) for c in classes], [w / row["n"] for w in words] + [1 - sum(words) / row["n"]])
    return out


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance in bits, between 0 and 1, of an array of shares."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / (2 * math.log(2))))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, most_words_distance: float = MOST_WORDS_DISTANCE, most_class_distance: float = MOST_CLASS_DISTANCE) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_distance,
    class_distance (to the closest language; null for texts too short to be judged, or without references), kept.

    A null text is empty and fails the base rule, as it has under ten words. A null language adds to no reference and is
    judged like any other; a language without a reference is not judged, so that only the base rules drop its texts. Repeated rows give repeated rows; an empty table gives none; other columns are ignored.
    """
    rows, _ = written(measured(docs, id_col, text_col, lang_col), "measured")
    refs = references(rows)
    n_words, n_chars = F.col("n_words"), F.col("n_chars")
    by_word, by_class = [], []
    for lang, (classes, words) in sorted(refs.items()):
        own = F.array(*[F.col("commons")[WORDS.index(w)] / n_words for w in COMMON[lang]])
        rest = F.greatest(F.lit(0.0), 1 - F.aggregate(own, F.lit(0.0), lambda s, x: s + x))
        by_word.append(_distance(F.concat(own, F.array(rest)), words))
        by_class.append(_distance(F.transform("classes", lambda x: x / n_chars), classes))
    least = lambda x: F.least(*x) if len(x) > 1 else x[0] if x else F.lit(None).cast("double")
    known = F.col("lang").isNull() | F.col("lang").isin(*refs)
    rows = rows.withColumn("words_distance", F.when(known & (n_words >= least_words), least(by_word))).withColumn("class_distance", F.when(known & (n_chars >= least_chars), least(by_class)))
    failed = (n_words < 10) | (100 * F.col("n_repeat_words") > 20 * n_words)
    fits = (F.coalesce(F.col("words_distance") - F.sqrt(F.lit(SAMPLING) / n_words), F.lit(0.0)) < most_words_distance) & (F.coalesce("class_distance", F.lit(0.0)) < most_class_distance)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "words_distance", "class_distance", (~failed & fits).alias("kept"))
