"""Quantiles by selection against sorted values, and exact tails against all choices."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewise.operators import ranks
from galewise.operators import significance as sg
from galewise.operators import statistics as st

INF, MOST = float("inf"), 1.7976931348623157e308


def quantile(values, share):
    values, at = sorted(values), share * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("sorted_", [0, 3, 10_000])
def test_quantiles_of_all_kinds_of_values(spark, monkeypatch, sorted_):
    monkeypatch.setattr(ranks, "SORTED", sorted_)
    monkeypatch.setattr(ranks, "BUCKETS", 4)
    rng = random.Random(1)
    groups = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(300)], "equal": [2.5] * 50, "one": [7.0], "two": [1.0, 2.0], "far": [*range(100), 1e300], "near": [1.0 + k * 2.0**-52 for k in range(40)],
        "crowd": [5.0] * 90 + [rng.random() for _ in range(60)], "ends": [-INF, -MOST, -1.0, 0.0, 1.0, MOST, INF], "zeros": [0.0, -0.0, 0.0, 1.0], "tiny": [k * 5e-324 for k in range(9)],
    }
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("none", float("nan")), ("spread", None), ("spread", float("nan"))]
    shares = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0, "q5": 0.9}
    got = {r["g"]: r for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(quantile(own, share), nan_ok=True, rel=1e-15), (g, name)


def test_quantiles_of_no_family_and_no_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    assert ranks.quantiles(df, [], "v", {"m": 0.5}).collect()[0]["m"] == 5.0
    assert ranks.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None)], "algorithm string, length double")
    got = {r["algorithm"]: r for r in st.descriptive(df).collect()}
    assert (got["a"]["mean"], got["a"]["median"], got["a"]["n"]) == (2.0, 2.0, 2) and got["b"]["median"] is None and got["b"]["n"] == 0


def test_signed_rank_counts(spark):
    got = {r["n"]: r["c"] for r in spark.range(1, 51).select("id", F.col("id").alias("n"), sg.signed_rank_counts(F.col("id")).alias("c")).collect()}
    for n in range(1, 11):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert got[n] == np.bincount(sums).tolist()
    assert sum(got[50]) == 2**50 and got[50] == got[50][::-1]


def test_rank_sum_counts(spark):
    pairs = [(m, n) for m in range(1, 6) for n in range(m, 8)] + [(8, 250)]
    got = {(r["m"], r["n"]): r["c"] for r in spark.createDataFrame(pairs, "m long, n long").select("m", "n", sg.rank_sum_counts(F.col("m"), F.col("n")).alias("c")).collect()}
    for m, n in pairs[:-1]:
        us = [sum(own) - m * (m - 1) // 2 for own in itertools.combinations(range(m + n), m)]
        assert got[m, n] == np.bincount(us).tolist()
    assert sum(got[8, 250]) == math.comb(258, 8)


def test_exact_where_it_is_called_for(spark):
    rng = random.Random(2)
    small, tied, zero, large = [rng.uniform(-1, 1) for _ in range(9)], [1.0, -1.0, 2.0], [0.0, 1.0, 2.0], [rng.uniform(-1, 1) for _ in range(51)]
    rows = [(name, "x", v) for name, own in (("small", small), ("tied", tied), ("zero", zero), ("large", large)) for v in own]
    got = {r["first"]: r for r in sg.exact_signed_p(st.wilcoxon(spark.createDataFrame(rows, "first string, second string, delta double"), ties=True)).collect()}
    order = sorted(range(9), key=lambda k: abs(small[k]))
    w = min(sum(i + 1 for i, k in enumerate(order) if (small[k] > 0) == up) for up in (True, False))
    sums = [sum(k for k, s in zip(range(1, 10), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=9)]
    assert got["small"]["p_exact"] == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 512))
    assert [got[k]["p_exact"] for k in ("tied", "zero", "large")] == [None] * 3
    a, b = [rng.random() for _ in range(3)], [rng.random() for _ in range(12)]
    rows = [("f", "a", v) for v in a] + [("f", "b", v) for v in b] + [("t", "a", 1.0), ("t", "b", 1.0)] + [("l", s, rng.random()) for s in "ab" for _ in range(9)]
    got = {r["family"]: r for r in sg.exact_rank_sum_p(st.mann_whitney(spark.createDataFrame(rows, "family string, side string, v double"), ["family"], "side", "v", ties=True)).collect()}
    u = sum(x > y for x in a for y in b)
    us = [sum(own) - 3 for own in itertools.combinations(range(15), 3)]
    assert got["f"]["p_exact"] == pytest.approx(min(1, 2 * sum(v <= min(u, 36 - u) for v in us) / len(us)))
    assert got["t"]["p_exact"] is None and got["l"]["p_exact"] is None
