import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from galewise.kernels import routes, special
from galewise.kernels.experiment import Experiment
from galewise.operators import significance


def test_known_tails():
    # textbook values
    assert special.normal_tail(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert special.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_tail(9.487729037, 4) == pytest.approx(0.05, abs=1e-8)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(math.erfc(math.sqrt(3.841458821 / 2)), abs=1e-12)
    assert special.beta_part(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)
    assert special.gamma_tail(3, 2) == pytest.approx(math.exp(-2) * (1 + 2 + 2), abs=1e-12)


def test_normality():
    rng = np.random.default_rng(0)
    w, p = special.shapiro_wilk(rng.normal(size=500))
    assert w > 0.98 and p > 1e-3
    assert special.shapiro_wilk(rng.exponential(size=500))[1] < 1e-10
    # p is uniform where the values are normal
    share = np.mean([special.shapiro_wilk(rng.normal(size=20))[1] < 0.1 for _ in range(300)])
    assert 0.05 < share < 0.16
    assert special.shapiro_wilk([1.0, 2.0, 3.0])[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        special.shapiro_wilk(np.zeros(5_001))


def test_tables_with_p(spark):
    rows = spark.createDataFrame([(2.228138852, 10), (None, 10)], "t double, df int")
    got = [r["p"] for r in significance.with_p(rows, "t", "t", "df").collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-8) and got[1] is None
    ci = significance.intervals(spark.createDataFrame([(10.0, 2.0, 11), (1.0, None, 1)], "mean double, sd double, n long")).collect()
    assert ci[0]["ci_high"] - 10 == pytest.approx(2.228138852 * 2 / math.sqrt(11), abs=1e-6) and ci[1]["ci_low"] is None
    few = significance.normality(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double"), ["g"], "v")
    assert {r["g"]: r["n"] for r in few.collect()} == {"a": 1, "b": 3} and few.filter("g = 'a'").first()["p"] is None


def test_a_step_is_led_out_of_the_next_obstacle():
    coming = [(60_000, -20_000), (110_000, -20_000), (110_000, 20_000), (60_000, 20_000)]
    keys = [routes.Obstacles([]), routes.Obstacles([coming]), routes.Obstacles([coming])]
    plain = routes.fly((0, 0), (200_000, 0), keys, routes.Rules())
    led = routes.fly((0, 0), (200_000, 0), keys, routes.Rules(correct=True))
    assert keys[1].holder(plain.segments[0][-1]) is not None
    assert keys[1].holder(led.segments[0][-1]) is None and not led.intermediate
    assert routes.length(led.segments[0]) <= 75_000 + 1e-6


def test_an_experiment_of_a_person():
    e = Experiment((0.0, 0.0), (160_000.0, 0.0)).started()
    assert e.act("confirm") is e
    e = e.act("waypoint", 50_000, 0)
    assert e.act("confirm") is e  # short of a step, and not at the goal
    e = e.act("waypoint", 100_000, 0).act("confirm")
    assert e.position == (75_000, 0) and e.t == 1 and e.drawn == () and e.heading == (1.0, 0.0)
    e = e.act("waypoint", 155_000, 0)
    assert e.drawn[-1] == (160_000.0, 0.0)
    e = e.act("confirm")
    assert e.position == (160_000.0, 0.0) and e.complete and len(e.flown) == 2
    assert e.act("waypoint", 1, 1) is e
    for _ in range(9):
        e = e.act("zoom_in")
    assert e.zoom == 10 and e.act("add_layer", key="a").act("remove_layer").layers == ("a",)
    assert e.act("reset").position is None


def test_live_experiments(spark, tmp_path):
    from galewise.streaming import flights

    clicks = [("e", 0, "waypoint", 80_000.0, 0.0), ("e", 1, "confirm", None, None), ("e", 2, "waypoint", 119_000.0, 0.0), ("e", 3, "confirm", None, None)]
    spark.createDataFrame([(*c, 0.0, 0.0, 120_000.0, 0.0) for c in clicks], flights.CLICKS).write.parquet(str(tmp_path / "c"))
    q = flights.experiments(spark.readStream.schema(flights.CLICKS).parquet(str(tmp_path / "c"))).writeStream.format("memory").queryName("people").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("people").orderBy("seq").collect()
    assert [(r["seq"], r["complete"]) for r in rows] == [(1, False), (3, True)] and rows[-1]["distance_m"] == pytest.approx(120_000)
    assert spark.table("people").filter(F.col("segments") == 2).count() == 1
