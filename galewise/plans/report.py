"""The report: statistics of all phases in one tall table with p-values and corrections, the best windows, and their text.

Phase 1 asks whether residuals are normal and how often differences are zero; phase 2 compares all pairs of algorithms, by the test that
phase 1 calls for; phase 3 compares all algorithms over complete blocks; phase 4 looks for a trend over windows; phase 5 holds gains against
difficulty; phase 6 describes differences and spreads. Tables are small after the aggregates: a row for each family of a test.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.operators import significance as sg
from galewise.operators import statistics as st
from galewise.sources.shared import written

ALPHA = 0.05
#: Share of zero differences from which ranks are used, however normal residuals are.
MOST_ZEROS = 0.05
COLUMNS = "phase int, test string, comparison string, statistic double, p_value double, p_corrected double, is_significant boolean, effect_size double, effect_label string, n long, alpha double, correction string"


def _pair() -> Column:
    return F.concat_ws(" vs ", "first", "second")


def diagnostics(results: DataFrame, deltas: DataFrame, alpha: float = ALPHA, by: tuple = ("first", "second")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normality of each algorithm's residuals in each window, shares of zero differences, and one row with `nonparametric`: whether any
    window's residuals of three or more are not normal (too many to be tested count as such), or differences are zero too often."""
    normal = sg.normality(st.residuals(results), ["algorithm", "window_size"], "residual", alpha)
    zeros = st.zero_inflation(deltas, by)
    failed = normal.filter("n >= 3 and not coalesce(is_normal, false)").select(F.lit(True).alias("bad")).unionByName(zeros.filter(F.col("zero_share") > MOST_ZEROS).select(F.lit(True).alias("bad")))
    return normal, zeros, failed.agg((F.count("*") > 0).alias("nonparametric"))


def paired(deltas: DataFrame, gate: DataFrame, by: tuple = ("first", "second")) -> DataFrame:
    """(by, test, statistic, p, effect_size, effect_label, n) by signed ranks or by t, as the gate says."""
    ranks = sg.with_p(sg.exact_signed_p(st.wilcoxon(deltas, by, ties=True)), "z", "z").withColumn("p", F.coalesce("p_exact", "p")).select(*by, F.lit("wilcoxon").alias("test"), F.col("w").alias("statistic"), F.when(F.col("n") == 0, 1.0).otherwise(F.col("p")).alias("p"), F.col("effect").alias("effect_size"), st.rank_biserial_label(F.col("effect")).alias("effect_label"), "n")
    means = sg.with_p(st.paired_t(deltas, by), "t", "t", "df").select(*by, F.lit("paired_t").alias("test"), F.col("t").alias("statistic"), "p", F.col("d").alias("effect_size"), F.col("effect").alias("effect_label"), "n")
    return ranks.crossJoin(F.broadcast(gate)).filter("nonparametric").unionByName(means.crossJoin(F.broadcast(gate)).filter("not nonparametric")).drop("nonparametric")


def _tall(rows: DataFrame, phase: int, test, comparison: Column, statistic: Column, p: Column | None = None, effect: Column | None = None, label: Column | None = None, n: Column | None = None) -> DataFrame:
    or_null = lambda c, kind: (c if c is not None else F.lit(None)).cast(kind)
    return rows.select(F.lit(phase).alias("phase"), (F.lit(test) if isinstance(test, str) else test).alias("test"), comparison.alias("comparison"), statistic.cast("double").alias("statistic"), or_null(p, "double").alias("p_value"), or_null(effect, "double").alias("effect_size"), or_null(label, "string").alias("effect_label"), or_null(n, "long").alias("n"))


def _judged(rows: DataFrame, correction: str, alpha: float, size: Column | None = None) -> DataFrame:
    """Corrected p within each test, and whether it is below alpha; size: how many tests were asked for, where that counts."""
    if correction == "holm":
        rows = st.holm(rows.filter("p_value is not null"), ["phase", "test"], "p_value", ("comparison",), monotone=False, size=size).withColumnRenamed("p_holm", "p_corrected")
    elif correction == "bh":
        rows = st.benjamini_hochberg(rows.filter("p_value is not null"), ["phase", "test"], "p_value", ("comparison",)).withColumnRenamed("p_bh", "p_corrected")
    else:
        rows = rows.withColumn("p_corrected", F.col("p_value"))
    return rows.withColumn("is_significant", F.col("p_corrected") < alpha).withColumn("alpha", F.lit(alpha)).withColumn("correction", F.lit(correction)).select(*[c.split()[0] for c in COLUMNS.split(", ")])


def stat_results(results: DataFrame, blocks: list[str] = ["subject_id", "window_size"], alpha: float = ALPHA) -> DataFrame:
    """All phases over one result table (algorithm, subject_id, window_size, length, success), one row for each family of each test."""
    results, _ = written(results, "results")
    deltas, _ = written(st.deltas(results), "deltas")  # ten parts read them
    normal, zeros, gate = diagnostics(results, deltas, alpha)
    window = F.concat(F.lit("window "), F.col("window_size").cast("string"))
    tested = paired(deltas, gate)
    mcnemar = sg.with_p(st.mcnemar(results).withColumn("df", F.lit(1)), "chi2", "statistic", "df")
    friedman = sg.with_p(st.friedman(results, blocks).withColumn("df", F.col("k") - 1), "chi2", "chi2", "df")
    conover = sg.with_p(st.conover(results, blocks), "t", "t", "df")
    trend = sg.with_p(st.jonckheere(results, "window_size", "length", ("algorithm",)), "z", "z")
    gain = st.spearman(deltas, ["first", "second"], "length_1", "delta").withColumn("df", F.col("n") - 2)
    gain = sg.with_p(gain.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.col("df"), 1 - F.col("rho") * F.col("rho")))).filter("n >= 3"), "t", "t", "df")
    spread = sg.with_p(st.levene(results, "algorithm", "length", ("window_size",)).withColumn("d1", F.col("k") - 1).withColumn("d2", F.col("n") - F.col("k")), "f", "statistic", "d1", "d2")
    described = st.descriptive(deltas, "delta", ("first", "second"))
    parts = [
        _judged(_tall(normal.filter("n >= 3"), 1, "shapiro_wilk", F.concat(F.col("algorithm"), F.lit(" "), window), F.col("w"), F.col("p"), n=F.col("n")), "none", alpha),
        _judged(_tall(zeros, 1, "zero_inflation", _pair(), F.col("zero_share")), "none", alpha),
        _judged(_tall(tested, 2, F.col("test"), _pair(), F.col("statistic"), F.col("p"), F.col("effect_size"), F.col("effect_label"), F.col("n")), "holm", alpha),
        _judged(_tall(mcnemar, 2, "mcnemar", _pair(), F.col("statistic"), F.col("p"), n=F.col("b") + F.col("c")), "holm", alpha),
        _judged(_tall(friedman, 3, "friedman", F.lit("algorithms"), F.col("chi2"), F.col("p"), F.col("kendall_w"), n=F.col("n")), "bh", alpha),
        _judged(_tall(conover, 3, "conover", _pair(), F.col("t"), F.col("p")), "holm", alpha),
        _judged(_tall(trend, 4, "jonckheere", F.col("algorithm"), F.col("z"), F.col("p")), "none", alpha),
        _judged(_tall(gain, 5, "spearman", _pair(), F.col("rho"), F.col("p"), n=F.col("n")), "bh", alpha),
        _judged(_tall(described, 6, "degradation", _pair(), F.col("median"), effect=F.col("mean"), n=F.col("n")), "none", alpha),
        _judged(_tall(spread, 6, "levene", window, F.col("statistic"), F.col("p"), n=F.col("n")), "none", alpha),
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Plan:
    """What a report is asked for: pairs without and with masks (phase 2), groups of algorithms (factor, algorithms, window) held against each
    other (3), pairs before and after optimisation at a window or at all of them, -1 (5), and predictions against their truth (6). Validity of
    predicted paths, and best windows, are asked for flagged algorithms only."""

    masking: tuple[tuple[str, str], ...] = ()
    groups: tuple[tuple[str, tuple[str, ...], int], ...] = ()
    optimisation: tuple[tuple[str, str, int], ...] = ()
    degradation: tuple[tuple[str, str], ...] = ()
    flagged: tuple[str, ...] = ()

    def pairs(self) -> list[tuple[int, str, str, str, int, int, bool]]:
        """(phase, comparison, first, second, window, place in its phase, whether one is flagged)."""
        some = [(2, f"{a} vs {b}", a, b, -1) for a, b in self.masking]
        some += [(5, f"{a} vs {b}" + (f" (ws={w})" if w >= 0 else ""), a, b, w) for a, b, w in self.optimisation]
        some += [(6, f"{a} vs {b}", a, b, -1) for a, b in self.degradation]
        return [(*x, k, x[2] in self.flagged or x[3] in self.flagged) for k, x in enumerate(some)]


def asked_pairs(results: DataFrame, plan: Plan) -> DataFrame:
    """(phase, comparison, place, flagged, subject_id, window_size, both lengths, successes and validities, delta) of all pairs asked for, in two
    equi-joins; those without a common row have none. The table of pairs is the caller's list."""
    asked = results.sparkSession.createDataFrame(plan.pairs(), "phase int, comparison string, first string, second string, at int, place int, flagged boolean")
    valid = F.col("is_pred_path_valid") if "is_pred_path_valid" in results.columns else F.lit(None).cast("boolean")
    side = lambda name, n: results.select(F.col("algorithm").alias(name), "subject_id", "window_size", F.col("length").alias(f"length_{n}"), F.col("success").alias(f"success_{n}"), valid.alias(f"valid_{n}"))
    one = side("first", 1).join(F.broadcast(asked), "first").filter("at < 0 or at = window_size")
    met = one.join(side("second", 2), ["second", "subject_id", "window_size"])
    return met.withColumn("delta", st.relative_difference(F.col("length_1"), F.col("length_2"))).drop("at", "first", "second")


def planned_results(results: DataFrame, plan: Plan, blocks: list[str] = ["subject_id", "window_size"], alpha: float = ALPHA) -> DataFrame:
    """The phases for the families that a plan asks for, as stat_results gives them for all pairs. Holm counts the pairs that phase 2 was asked for, whether
    they are there or not; Conover's tests are there for factors that Friedman's test, corrected over all factors, finds different; the
    interaction of masks, by rank sums of differences, where there are two pairs and both have rows."""
    spark = results.sparkSession
    results, _ = written(results, "results")
    rows, _ = written(asked_pairs(results, plan), "asked")
    by = ["phase", "comparison"]
    judged = lambda df, size=None, correction="holm": _judged(df, correction, alpha, size)
    window = F.concat(F.lit("window "), F.col("window_size").cast("string"))
    known = rows.filter("phase = 2") if plan.masking else st.deltas(results).withColumn("comparison", _pair()).withColumn("phase", F.lit(2))
    normal, zeros, gate = diagnostics(results, known.select("comparison", "delta"), alpha, ("comparison",))
    tests = rows.filter("phase in (2, 5)")
    tested = paired(tests.select(*by, "delta"), gate, tuple(by))
    mcnemar = sg.with_p(st.discordant(tests, by).withColumn("df", F.lit(1)), "chi2", "statistic", "df")
    validity = sg.with_p(st.discordant(tests.filter("flagged and valid_1 is not null and valid_2 is not null"), by, "valid").withColumn("df", F.lit(1)), "chi2", "statistic", "df")
    two = rows.filter("phase = 2").withColumn("side", F.col("place"))
    there = two.agg((F.count_distinct("place") == 2).alias("both"))  # one row
    crossed = sg.with_p(sg.exact_rank_sum_p(st.mann_whitney(two.crossJoin(F.broadcast(there)).filter("both"), ["phase"], "side", "delta", ties=True)), "z", "z")
    members = spark.createDataFrame([(f, a, w) for f, names, w in plan.groups for a in names], "factor string, algorithm string, at int")
    grouped = results.join(F.broadcast(members), "algorithm").filter("at < 0 or at = window_size")
    friedman = sg.with_p(st.friedman(grouped, blocks, ("factor",)).withColumn("df", F.col("k") - 1), "chi2", "chi2", "df")
    friedman, _ = written(judged(_tall(friedman, 3, "friedman", F.col("factor"), F.col("chi2"), F.col("p"), F.col("kendall_w"), n=F.col("n")), None, "bh"), "friedman")
    found = friedman.filter("is_significant").select(F.col("comparison").alias("factor"))
    posthoc = sg.with_p(st.conover(grouped.join(found, "factor", "left_semi"), blocks, ("factor",)), "t", "t", "df")
    posthoc = _tall(posthoc, 3, F.concat(F.lit("conover: "), F.col("factor")), _pair(), F.col("t"), F.col("p"))
    trend = sg.with_p(st.jonckheere(results, "window_size", "length", ("algorithm",)), "z", "z")
    gain = st.spearman(rows.filter("phase = 5"), by, "length_1", "delta").filter("n >= 3").withColumn("df", F.col("n") - 2)
    gain = sg.with_p(gain.withColumn("t", F.col("rho") * F.sqrt(F.try_divide(F.col("df"), 1 - F.col("rho") * F.col("rho")))), "t", "t", "df")
    spread = sg.with_p(st.levene(results, "algorithm", "length", ("window_size",)).filter("k >= 2").withColumn("d1", F.col("k") - 1).withColumn("d2", F.col("n") - F.col("k")), "f", "statistic", "d1", "d2")
    described = st.descriptive(rows.filter("phase = 6"), "delta", ("comparison",))
    of = lambda df, phase: df.filter(F.col("phase") == phase)
    asked = F.lit(len(plan.masking))
    parts = [
        judged(_tall(normal.filter("n >= 3"), 1, "shapiro_wilk", F.concat(F.col("algorithm"), F.lit(" "), window), F.col("w"), F.col("p"), n=F.col("n")), None, "none"),
        judged(_tall(zeros, 1, "zero_inflation", F.col("comparison"), F.col("zero_share")), None, "none"),
        judged(_tall(crossed, 2, "masking_interaction", F.lit("first pair vs second pair"), F.col("u"), F.coalesce("p_exact", "p"), F.col("effect"), st.rank_biserial_label(F.col("effect")), F.col("n1") + F.col("n2")), None, "none"),
        friedman,
        judged(posthoc),
        judged(_tall(trend, 4, "jonckheere", F.col("algorithm"), F.col("z"), F.col("p")), None, "none"),
        judged(_tall(gain, 5, "spearman", F.col("comparison"), F.col("rho"), F.col("p"), n=F.col("n")), None, "bh"),
        judged(_tall(described, 6, "degradation", F.col("comparison"), F.col("median"), effect=F.col("mean"), n=F.col("n")), None, "none"),
        judged(_tall(spread, 6, "levene", window, F.col("statistic"), F.col("p"), n=F.col("n")), None, "none"),
    ]
    for phase, correction, size in ((2, "holm", asked), (5, "bh", None)):
        parts.append(judged(_tall(of(tested, phase), phase, F.col("test"), F.col("comparison"), F.col("statistic"), F.col("p"), F.col("effect_size"), F.col("effect_label"), F.col("n")), size, correction))
        parts.append(judged(_tall(of(mcnemar, phase), phase, "mcnemar", F.col("comparison"), F.col("statistic"), F.col("p"), n=F.col("b") + F.col("c")), size, correction))
        parts.append(judged(_tall(of(validity, phase), phase, "mcnemar_validity", F.col("comparison"), F.col("statistic"), F.col("p"), n=F.col("b") + F.col("c")), None, correction))
    return reduce(DataFrame.unionByName, parts)


def optimal_windows(results: DataFrame, resamples: int = 1_000, flagged: tuple[str, ...] | None = None) -> DataFrame:
    """For each algorithm (or the flagged ones) the first window whose bootstrap range overlaps that of the least median, and the window of the best ratio of
    changes, with rates and counts."""
    results = results if flagged is None else results.filter(F.col("algorithm").isin(*flagged))
    medians = st.bootstrap_medians(results, ["algorithm", "window_size"], resamples)
    chosen = st.first_overlapping(medians).join(medians, ["algorithm", "window_size"])
    best = st.best_windows(results).select("algorithm", F.col("window_size").alias("eta_window"), F.col("ratio").alias("eta"))
    sums = results.groupBy("algorithm").agg(F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("length").alias("mean_length"), F.count_if("success").alias("n_success"), F.count("*").alias("n_total"))
    return chosen.select("algorithm", F.col("window_size").alias("optimal_window"), F.col("median").alias("bootstrap_median"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high")).join(best, "algorithm", "left").join(sums, "algorithm")


def conclusions(stats: DataFrame) -> DataFrame:
    """(phase, test, n_tests, n_significant, strongest): how many tests of each kind are significant, and the comparison of the least
    corrected p."""
    tests = stats.filter("p_value is not null")
    return tests.groupBy("phase", "test").agg(F.count("*").alias("n_tests"), F.count_if("is_significant").alias("n_significant"), F.min_by("comparison", F.struct("p_corrected", "comparison")).alias("strongest"))


def _number(v) -> str:
    return "—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def _section(title: str, names: list[str], rows: list) -> list[str]:
    if not rows:
        return []
    return ["", f"## {title}", "", f"| {' | '.join(names)} |", "|" + "-|" * len(names), *[f"| {' | '.join('✓' if r[c] is True else '—' if r[c] is False else _number(r[c]) for c in names)} |" for r in rows]]


def markdown(stats: DataFrame, windows: DataFrame | None = None) -> str:
    """The tables as text: a section for each test of each phase, the best windows by falling ratio, and what is significant; empty
    sections are left out."""
    lines, found = ["# Comparison of algorithms"], {}
    for r in stats.orderBy("phase", "test", "comparison").collect():  # a row for each family of a test
        found.setdefault((r["phase"], r["test"]), []).append(r)
    for (phase, test), rows in found.items():
        lines += _section(f"Phase {phase}: {test}", ["comparison", "statistic", "p_value", "p_corrected", "is_significant", "effect_size", "effect_label", "n"], rows)
    if windows is not None:
        lines += _section("Best windows", ["algorithm", "optimal_window", "bootstrap_median", "ci_low", "ci_high", "eta_window", "eta", "success_rate", "mean_length", "n_success", "n_total"], windows.orderBy(F.col("eta").desc_nulls_last(), "algorithm").collect())
    lines += _section("Conclusions", ["phase", "test", "n_tests", "n_significant", "strongest"], conclusions(stats).orderBy("phase", "test").collect())
    return "\n".join(lines) + "\n"
