"""Occurrences of notices against all runs of words, by a dynamic programme."""

import random
import time

import pytest

from galewise.llm import licenses


def spans(form, notice, edits):
    """{(start, end): errors} of all runs of whole words within the edits."""
    starts = [i + 1 for i in range(len(form) - 1) if form[i : i + 1] == b" " and form[i + 1 : i + 2] != b" "]
    ends = {i for i in range(1, len(form)) if form[i : i + 1] == b" " and form[i - 1 : i] != b" "}
    out = {}
    for a in starts:
        row = list(range(len(notice) + 1))
        for b in range(a, min(len(form), a + len(notice) + edits)):
            new = [row[0] + 1]
            for j, c in enumerate(notice, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != form[b])))
            row = new
            if b + 1 in ends and row[-1] <= edits:
                out[a, b + 1] = row[-1]
    return out


def meets(x, y):
    return x[0] < y[1] and y[0] < x[1]


def held_against_all_runs(text, notice):
    form = licenses.compared(text.encode())
    got = {(a + (form[a : a + 1] == b" "), b - (form[b - 1 : b] == b" ")): e for a, b, e in notice.occurrences(form)}
    every = spans(form, notice.text, notice.edits)
    for x, e in got.items():
        assert every.get(x) is not None and every[x] <= e, (form, x, e)
    assert not any(meets(x, y) for x in got for y in got if x != y)
    for x, e in every.items():
        over = [g for y, g in got.items() if meets(x, y)]
        assert over, (form, x, e, got)
        assert min(over) <= e, (form, x, e, got)
    return got


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_words(seed):
    rng = random.Random(seed)
    notice = licenses.Notice(rng.choice(["abc de abcd ef", "general public license", "aa aa aa aa", "cc by sa 4 0"]), "x", rng.choice([1, 2, 3]))
    parts = []
    for _ in range(rng.randrange(2, 7)):
        v = list(notice.text.decode())
        for _ in range(rng.randrange(0, notice.edits + 2)):
            at = rng.randrange(len(v))
            v[at : at + rng.choice([0, 1])] = rng.choice(["", "a", " ", "z", "by"])
        parts += ["".join(v), *rng.choices(["abc", "de", "aa", "license", "public", "q", "cc by"], k=rng.randrange(3))]
    held_against_all_runs(" ".join(parts), notice)


def test_the_first_of_two_is_not_lost():
    own = licenses.Notice("gnu general public license", "gpl")
    near, exact = "gnu generl public license", "gnu general public license"
    for text in (f"see {near} {exact}", f"see {exact} {near} x", f"{near} {near} {exact} {near}", f"{near} or {exact}"):
        got = held_against_all_runs(text, own)
        assert len(got) == text.count("gnu")


def test_identifiers_stand_without_an_edit():
    own = [licenses.Notice(*x) for x in licenses.ALL_NOTICES]
    labels = lambda text: {x[0] for x in licenses.notices_of(text, own)["fuzzy"]}
    assert labels(b"// SPDX-License-Identifier: Apache-2.0") == {"apache"}
    assert labels(b"# SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl"} and labels(b"SPDX-License-Identifier: LGPL-2.1-only") == {"lgpl"}
    assert labels(b"SPDX-License-Identifier: MIT") == {"mit"} and not labels(b"SPDX-License-Identifier: MIL")


def test_labels_are_no_single_string():
    assert all(len(x) in (2, 3) and x[0] == " ".join(x[0].split()) for x in licenses.ALL_NOTICES)
    assert len({x[0] for x in licenses.ALL_NOTICES}) == len(licenses.ALL_NOTICES)


@pytest.mark.parametrize("text", ["gnu generl public license ", "general public ", "gnu general public license", "license"])
def test_a_megabyte_takes_linear_time(text):
    own = [licenses.Notice(*x) for x in licenses.ALL_NOTICES]
    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        licenses.notices_of((text * (n // len(text))).encode(), own)
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 5
