"""Words of spaced runs against all ways to cut them, and words of signs of any length."""

import math
import random
import time

import pytest

from galewise.llm import toxicity


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel(toxicity.trigram_counts([b"the cat sat on the mat and other words of a plain text as they stand " * 50]))


def all_ways(letters, model, slack):
    """Costs of all words of all ways to cut the letters; every start with every end."""
    n, rows, costs = len(letters), model.rows, {}
    for start in range(n):
        a = b = 0
        total = toxicity.BREAK if start else 0.0
        for end in range(start + 1, n + 1):
            z = ord(letters[end - 1]) - 96
            total -= rows[a][b][z]
            a, b = b, z
            costs[start, end] = total - rows[a][b][0]
    forth, back = [0.0] + [math.inf] * n, [math.inf] * n + [0.0]
    for end in range(1, n + 1):
        forth[end] = min(forth[s] + costs[s, end] for s in range(end))
    for start in reversed(range(n)):
        back[start] = min(costs[start, e] + back[e] for e in range(start + 1, n + 1))
    return {letters[s:e] for (s, e), own in costs.items() if forth[s] + own + back[e] <= forth[n] + slack + 1e-9}


@pytest.mark.parametrize("seed", range(20))
def test_all_ways_to_cut(model, seed):
    rng = random.Random(seed)
    for slack in (0.0, toxicity.SLACK, 30.0):
        letters = "".join(rng.choice(["the", "cat", "xq", "a", "on", "plain", "zz", "abcdefghijklmnopqrstuvwxyzabcdef"]) for _ in range(rng.randrange(1, 9)))
        assert toxicity.words_of_run(letters, model, slack) == all_ways(letters, model, slack)


def test_long_words_of_a_run(model):
    """A word of more than 24 letters that the model knows is one of the words."""
    long = "otherwordsofaplaintextastheystand"
    known = toxicity.CharModel(toxicity.trigram_counts([long.encode() + b" " for _ in range(200)]))
    assert long in toxicity.words_of_run(long, known) and toxicity.words_of_run("", known) == set()


def test_words_of_signs_of_any_length(model):
    assert toxicity._SUSPECT.match("@$$" * 9) and toxicity.restore("@$$" * 9, model).count("s") >= 9
    took = []
    for n in (3_000, 30_000):
        began = time.process_time()
        assert len(toxicity.restore("@$$" * (n // 3), model)) >= n // 2
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1
