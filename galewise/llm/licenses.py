"""Fuzzy search for short license notices.

A notice may be found with up to k edits. Cut into k + 1 pieces, at least one stands in the text as it is
(pigeonhole), so that exact search for the pieces finds every candidate; the regex library then matches the whole
notice with bounded errors around each candidate, and reports where.

Texts are compared as words: A-Z lower-cased, joined by single spaces. Edits are single bytes of that form.

An occurrence is a run of whole words within the edits. From the first that there is, the one with the fewest errors among those that
overlap it counts; what stands before it is searched again, and the search goes on behind it. So no run of words within the edits is
left that overlaps no occurrence, and none of fewer errors overlaps one.

Scale: one pass without a shuffle. The notices are a short list that is part of the code or given as a parameter.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import LOWER_WORDS, per_batch, texts_of

#: Phrases that count exactly as they stand, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Public notices and their labels, in words as they are compared.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu general public license", "gpl"),
    ("general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("cc by sa 4 0", "cc-by"),
    ("cc by nc 4 0", "cc-by"),
    ("cc by nc sa 4 0", "cc-by"),
    ("all rights reserved", "reserved"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
    ("apache license version 2 0", "apache"),
    ("apache software license", "apache"),
    ("the mit license", "mit"),
    ("bsd 2 clause license", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu free documentation license", "gfdl"),
    ("eclipse public license", "epl"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("boost software license version 1 0", "boost"),
    ("sil open font license version 1 1", "ofl"),
    ("artistic license 2 0", "artistic"),
    ("academic free license", "afl"),
    ("open software license", "osl"),
    ("microsoft public license", "ms-pl"),
    ("python software foundation license", "psf"),
    ("creative commons zero v1 0 universal", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("creative commons attribution sharealike", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by"),
    ("open database license", "odbl"),
    ("open government licence v3 0", "ogl"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("permission to copy and distribute verbatim copies of this document", "verbatim"),
)
#: Public license identifiers in words, and their labels. They stand behind SPDX_TAG, without an edit.
SPDX_TAG = "spdx license identifier"
SPDX = (
    ("0bsd", "bsd"), ("afl 3 0", "afl"), ("agpl 3 0", "agpl"), ("apache 1 1", "apache"), ("apache 2 0", "apache"), ("artistic 2 0", "artistic"),
    ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("bsd 4 clause", "bsd"), ("bsl 1 0", "boost"), ("cc by 4 0", "cc-by"), ("cc by sa 4 0", "cc-by"), ("cc0 1 0", "cc0"),
    ("cddl 1 0", "cddl"), ("epl 1 0", "epl"), ("epl 2 0", "epl"), ("eupl 1 2", "eupl"), ("gfdl 1 3", "gfdl"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("isc", "isc"),
    ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("mit", "mit"), ("mit 0", "mit"), ("mpl 1 1", "mpl"), ("mpl 2 0", "mpl"), ("ms pl", "ms-pl"), ("odbl 1 0", "odbl"),
    ("ofl 1 1", "ofl"), ("osl 3 0", "osl"), ("psf 2 0", "psf"), ("unlicense", "public-domain"), ("wtfpl", "wtfpl"), ("zlib", "zlib"),
)
#: One edit for so many bytes of a notice.
BYTES_PER_EDIT = 12
#: (text, label) or (text, label, edits).
ALL_NOTICES = (*NOTICES, *((f"{SPDX_TAG} {name}", label, 0) for name, label in SPDX))


class Notice:
    """A notice, the edits it may have and the pieces that one of must stand."""

    def __init__(self, text: str, label: str, edits: int | None = None) -> None:
        self.text, self.label = text.encode(), label
        self.edits = len(self.text) // BYTES_PER_EDIT if edits is None else edits
        self.most = len(self.text) + self.edits
        edges = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        # bounded by words on both sides; the first within the edits, and the one with the fewest errors
        core = rb"(?<![^ ])(?:" + regex.escape(self.text.decode()).encode() + rb"){e<=" + str(self.edits).encode() + rb"}(?![^ ])"
        self.first, self.best = regex.compile(core), regex.compile(rb"(?b)" + core)

    def windows(self, text: bytes, seen: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """Ranges that an occurrence around an exact piece may take, to the words' ends, overlapping ones joined. seen keeps where pieces
        stand, as notices share some."""
        found = []
        for offset, piece in self.pieces:
            if piece not in seen:
                seen[piece] = spots = []
                at = text.find(piece)
                while at >= 0:
                    spots.append(at)
                    at = text.find(piece, at + 1)
            found += [(max(0, at - offset - self.edits - 1), at - offset + self.most + 1) for at in seen[piece]]
        found.sort()
        joined: list[list[int]] = []
        for a, b in found:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return [(max(0, text.rfind(b" ", 0, a + 1)), self._end(text, b)) for a, b in joined]

    def _end(self, text: bytes, at: int) -> int:
        """The end of the word at a place."""
        end = text.find(b" ", at)
        return end if end >= 0 else len(text)

    def occurrences(self, text: bytes, seen: dict[bytes, list[int]] | None = None) -> list[tuple[int, int, int]]:
        """(start, end, errors) of each occurrence."""
        found: list[tuple[int, int, int]] = []
        done = 0
        for a, b in self.windows(text, {} if seen is None else seen):
            if b > max(a, done):
                found += self._within(text, max(a, done), b)
                done = b
        return found

    def _within(self, text: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
        found = []
        while (m := self.first.search(text, a, b)) is not None:
            start, own = m.start(), (m.start(), m.end(), sum(m.fuzzy_counts))
            while own[2]:  # those of fewer errors that overlap it, until there are none
                better = self.best.search(text, start, min(b, self._end(text, own[1] + self.most)))
                if better is None or sum(better.fuzzy_counts) >= own[2]:
                    break
                own = (better.start(), better.end(), sum(better.fuzzy_counts))
            if own[0] > start:
                found += self._within(text, start, own[0])
            found.append(own)
            a = max(own[1], own[0] + 1)
        return found


def compared(text: bytes) -> bytes:
    """Lower-cased words with one space between them and at both ends."""
    return b" " + b" ".join(text.translate(LOWER_WORDS).split()) + b" "


def places(form: bytes, phrase: bytes) -> list[int]:
    """First words of the places where the phrase's words stand."""
    found, at, own = [], -1, b" " + phrase + b" "
    word = last = 0
    while (at := form.find(own, at + 1)) >= 0:
        word += form.count(b" ", last, at)
        last = at
        found.append(word)
    return found


def notices_of(text: bytes, notices: list[Notice], phrases=PHRASES) -> dict:
    """Base places, and fuzzy findings as (label, first word, words, errors, similarity)."""
    form = compared(text)
    n_words = form.count(b" ") - 1 if len(form) > 2 else 0
    base = {label: places(form, phrase.encode()) for phrase, label in phrases}
    fuzzy = []
    seen: dict[bytes, list[int]] = {}
    for notice in notices:
        word = last = 0
        for start, end, errors in notice.occurrences(form, seen):
            while start < end and form[start] == 32:
                start += 1
            word += form.count(b" ", last, start)
            last = start
            fuzzy.append((notice.label, word - 1, form.count(b" ", start, end) + 1, errors, 1 - errors / len(notice.text)))
    return {"n_words": n_words, "base": base, "fuzzy": sorted(fuzzy, key=lambda x: (x[1], x[0], x[2]))}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=ALL_NOTICES) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices (array of structs
    label, first_word, n_words, errors).

    The score is 1 if a phrase stands as it is, else the similarity of the closest notice, else 0. Null and empty texts have no words
    and score 0. Repeated rows give repeated rows, an empty table none; other columns are ignored. Texts of any length are searched
    whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64())]))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    given = tuple(notices)

    def run(batches):
        own = [Notice(*x) for x in given]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in names[1:]]
            for text in texts_of(batch.column(1)):
                found = notices_of(text, own)
                spots = [p for x in found["base"].values() for p in x]
                labels = {label for label, x in found["base"].items() if x}
                row = (found["n_words"], len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in found["fuzzy"]})))
                score = 1.0 if spots else max((x[4] for x in found["fuzzy"]), default=0.0)
                for column, value in zip(out, (*row, score, [dict(zip(("label", "first_word", "n_words", "errors"), x[:4], strict=True)) for x in found["fuzzy"]]), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=names)

        yield from per_batch(one)(batches)

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:long,n_words:long,errors:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


