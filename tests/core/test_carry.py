"""Values carried over ranges, windows of keys, and lookups by part of a text, against loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from galewise.operators import ranks
from galewise.operators import temporal as tm
from galewise.queries import catalog

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def at(k):
    return START + datetime.timedelta(minutes=5 * k)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_last_values(spark, share):
    rng = random.Random(3)
    rows = [(g, at(k), rng.random() if rng.random() < share else None) for g, n in (("a", 500), ("b", 3), ("c", 60)) for k in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r["g"], r["slot"]): (r["last"], r["seen"]) for r in ranks.with_last(spark.createDataFrame(rows, "g string, slot timestamp_ntz, v double"), ["g"], "slot", "v", "last", "seen").collect()}
        near = tm.carried_within(spark.createDataFrame(rows, "g string, slot timestamp_ntz, v double"), ["g"], "slot", "v", 4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = {}, {}
    for g, slot, v in rows:
        if v is not None:
            last[g] = (v, slot)
        want[g, slot] = last.get(g, (None, None))
    assert got == want
    assert {(r["g"], r["slot"]): r["v_filled"] for r in near} == {(g, s): v if seen and s - seen <= datetime.timedelta(minutes=20) else None for (g, s), (v, seen) in want.items()}


def test_carried_over_all_rows(spark):
    rows = [(at(k), float(k) if k in (3, 250) else None) for k in range(400)]
    got = tm.carried_far(spark.createDataFrame(rows, "slot timestamp_ntz, v double"), [], "slot", "v").orderBy("slot").collect()
    assert [r["v_filled"] for r in got] == [None] * 3 + [3.0] * 247 + [250.0] * 150
    assert got[0].asDict().keys() == {"slot", "v", "v_filled"}


@pytest.mark.parametrize("name", ["locf_gap_fill", "asof_bounded", "sliding_keys", "timestamp_lookup", "train_test_split", "list_scenes"])
def test_no_single_partition(spark, name):
    plan = catalog.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_windows_of_keys(spark):
    keys = [("s", f"k{k:03}") for k in range(40)] + [("t", "k000"), ("t", "k001")]
    got = {(r["g"], r["t_idx"]): (r["time_key"], r["keys"]) for r in tm.sliding_windows(spark.createDataFrame(keys, "g string, time_key string"), 3, ["g"]).collect()}
    assert got == {("s", t): (f"k{t:03}", [f"k{t + i:03}" for i in range(3)]) for t in range(38)}
    one = tm.sliding_windows(spark.createDataFrame(keys[:3], "g string, time_key string").select("time_key"), 1).collect()
    assert sorted((r["t_idx"], r["keys"]) for r in one) == [(k, [f"k{k:03}"]) for k in range(3)]


def test_lookups_by_part(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab_1é") for _ in range(n))
    known = [(k, text(rng.randrange(0, 9))) for k in range(200)] + [(200, None)]
    wanted = {text(rng.randrange(0, 6)) for _ in range(60)} | {"", "a", "ab", "nothing here", known[5][1]}
    got = {r["wanted"]: (r["idx"], r["timestamp"]) for r in tm.first_match(spark.createDataFrame([(w,) for w in wanted] + [(None,), ("a",)], "wanted string"), spark.createDataFrame(known, "idx long, timestamp string")).collect()}
    want = {}
    for w in wanted:
        found = [((0 if t == w else 1 if t.startswith(w) else 2), k, t) for k, t in known if t is not None and w in t]
        if found:
            want[w] = min(found)[1:]
    assert got == want and len(want) > 20


def test_offsets_of_files(spark):
    files = [(f"f{k:02}", n) for k, n in enumerate([3, 0, 5, 1])]
    got = {r["file"]: r["start"] for r in tm.offsets(spark.createDataFrame(files, "file string, n long")).collect()}
    assert got == {"f00": 0, "f01": 3, "f02": 3, "f03": 8}
    parts = {r["file"]: r["part"] for r in tm.split_by_order(spark.createDataFrame(files, "file string, n long"), 2).collect()}
    assert parts == {"f00": "train", "f01": "train", "f02": "test"}
    assert tm.split_by_order(spark.createDataFrame(files, "file string, n long").filter(F.lit(False)), 2).count() == 0
