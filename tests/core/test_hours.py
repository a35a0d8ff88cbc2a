"""The live hour windows against the batch ones, over shuffled, late and missing slots."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from galewise.operators import temporal as tm
from galewise.streaming import hours

START = datetime.datetime(2024, 1, 1)


def observed(seed):
    """Rows of a day and a half: slots are missing, some hours miss their first, some begin without an informative row."""
    rng = random.Random(seed)
    out = []
    for k in range(18 * 12):
        if rng.random() < 0.75:
            out += [(START + datetime.timedelta(minutes=5 * k, seconds=rng.randrange(300)), round(rng.uniform(0, 60), 2)) for _ in range(rng.randrange(1, 4))]
    return out


def batch(spark, rows):
    df = spark.createDataFrame(rows, "ts timestamp_ntz, value double").withColumn("slot", F.window("ts", "5 minutes")["start"])
    got = tm.hour_windows(tm.slot_totals(df), tm.informative_hours(df, F.col("value") > 40)).collect()
    return {r["hour"]: [pytest.approx(x, abs=1e-3) for x in r["sequence"]] for r in got}


def streamed(spark, files, tmp_path, late):
    """The stream of one file after the other."""
    source, name = tmp_path / "in", f"hours_{abs(hash(str(tmp_path)))}"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(source / f"part={k:03}"))
    live = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = hours.hour_sequences(live, 40.0, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return {r["hour"]: r["sequence"] for r in spark.table(name).collect()}


def test_shuffled_within_the_watermark(spark, tmp_path):
    rows = observed(1)
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[0] + datetime.timedelta(minutes=rng.uniform(0, 45)))
    files = [order[k : k + 60] for k in range(0, len(order), 60)]
    end = START + datetime.timedelta(days=3)
    got = streamed(spark, [*files, [(end, 1.0)], [(end, 1.0)]], tmp_path, "2 hours")
    want = batch(spark, rows)
    assert got == want and 3 < len(want) < 18


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    first = [(START + datetime.timedelta(minutes=5 * k), 50.0 + k) for k in range(12)]
    late = [(START + datetime.timedelta(minutes=7), 1_000.0)]
    end = START + datetime.timedelta(days=1)
    got = streamed(spark, [first, [(end, 1.0)], [(end, 2.0)], late, [(end, 3.0)]], tmp_path, "10 minutes")
    assert got == {START: [50.0 + k for k in range(12)]}


def test_nothing_is_told_to_the_next_hour():
    assert hours.filled([5.0, 0.0, 7.0] + [0.0] * 9, [1, 0, 2] + [0] * 9, 1) == [5.0, 5.0] + [7.0] * 10
    assert hours.filled([0.0, 3.0] + [0.0] * 10, [0, 1] + [0] * 10, 0) is None
