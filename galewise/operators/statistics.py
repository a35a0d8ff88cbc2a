"""Paired statistics over result tables.

A result table has algorithm, subject_id, window_size, length and success. Everything is a grouped aggregate, a window
over the few families or the rows of one block, or an equi-join on (subject, window); no statistic collects a group. Ranks and quantiles of
whole families are counted (operators/ranks.py).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.operators.ranks import quantiles, ranked_values, with_before

TINY = 1e-10


def midrank(partition: list, value: str) -> Column:
    """Rank with ties averaged, within the partition: for small ones, as a block of all algorithms."""
    order = W.partitionBy(*partition).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / 2


def preprocessed(results: DataFrame, shortest: float, longest: float, suspicious: list[str] | None = None) -> DataFrame:
    """Lengths within bounds (inclusive), without suspicious timestamps, windows from 0, and subject ids of timestamp and direction."""
    if "success" not in results.columns:
        results = results.withColumn("success", F.lit(True))
    kept = results.filter(F.col("length").between(shortest, longest) & ~F.isnan("length"))
    if suspicious:
        kept = kept.filter(~F.col("timestamp").isin(suspicious))
    return kept.withColumn("window_size", F.col("window_size") - 1).withColumn("subject_id", F.concat_ws("_", "timestamp", "direction"))


def row_counts(results: DataFrame, kept: Column) -> DataFrame:
    """Rows and kept rows of each algorithm."""
    return results.groupBy("algorithm").agg(F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"))


def descriptive(results: DataFrame, value: str = "length", by: tuple = ("algorithm",)) -> DataFrame:
    """Mean, median and spread of each family. NaN counts as null; families of nulls alone have nulls and n 0."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    sums = results.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("variance"), F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"))
    return sums.join(quantiles(results, list(by), value, {"median": 0.5}), list(by), "left").select(*by, "mean", "median", "sd", "variance", "n", "least", "most")


def rates(results: DataFrame, flag: str = "success") -> DataFrame:
    """Share of rows with the flag by algorithm and window."""
    return results.groupBy("algorithm", "window_size").agg(F.avg(F.col(flag).cast("int")).alias("rate"))


def relative_difference(a: Column, b: Column, guard: float = TINY) -> Column:
    return (a - b) / ((a + b) / 2 + guard)


def pairs(results: DataFrame, values: tuple = ("length",)) -> DataFrame:
    """All pairs of algorithms a < b on equal subject and window, in one equi-join."""
    side = lambda name, n: results.select("subject_id", "window_size", F.col("algorithm").alias(name), *[F.col(v).alias(f"{v}_{n}") for v in values])
    return side("first", 1).join(side("second", 2), ["subject_id", "window_size"]).filter("first < second")


def deltas(results: DataFrame) -> DataFrame:
    """Relative differences of lengths for all pairs of algorithms."""
    return pairs(results).withColumn("delta", relative_difference(F.col("length_1"), F.col("length_2")))


def zero_inflation(differences: DataFrame, by: tuple = ("first", "second")) -> DataFrame:
    return differences.groupBy(*by).agg(F.coalesce(F.avg((F.col("delta") == 0).cast("int")), F.lit(0.0)).alias("zero_share"))


def residuals(results: DataFrame) -> DataFrame:
    """Lengths without the mean of their family, which is joined: families are few and may hold any share of the rows."""
    means = results.groupBy("algorithm", "window_size").agg(F.avg("length").alias("_mean"))
    own = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("algorithm", "window_size")]
    met = results.join(means.withColumnsRenamed({"algorithm": "_algorithm", "window_size": "_window_size"}), own[0] & own[1])
    return met.withColumn("residual", F.col("length") - F.col("_mean")).drop("_mean", "_algorithm", "_window_size")


def by_window(results: DataFrame) -> DataFrame:
    """Validity rate and mean length of each algorithm and window."""
    return results.groupBy("algorithm", "window_size").agg(F.avg(F.col("success").cast("int")).alias("rate"), F.avg("length").alias("mean_length"))


def window_changes(results: DataFrame) -> DataFrame:
    """Relative change of rate and length against the window before, and their ratio (null where the length hardly changes)."""
    order = W.partitionBy("algorithm").orderBy("window_size")
    s, length = F.col("rate"), F.col("mean_length")
    rows = by_window(results).withColumn("d_rate", (s - F.lag(s).over(order)) / (F.lag(s).over(order) + TINY)).withColumn("d_length", (length - F.lag(length).over(order)) / (F.lag(length).over(order) + TINY))
    return rows.withColumn("ratio", F.when(F.abs("d_length") > TINY, F.col("d_rate") / F.col("d_length")))


def best_windows(results: DataFrame) -> DataFrame:
    """The window of the largest ratio for each algorithm, the first of equal ones; windows without one come last."""
    order = W.partitionBy("algorithm").orderBy(F.col("ratio").desc_nulls_last(), "window_size")
    return window_changes(results).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def paired_t(differences: DataFrame, by: tuple = ("first", "second")) -> DataFrame:
    """t, degrees of freedom, Cohen's d and its label of each family of differences."""
    rows = differences.groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))
    rows = rows.withColumn("t", F.col("mean") / (F.col("sd") / F.sqrt("n"))).withColumn("df", F.col("n") - 1).withColumn("d", F.col("mean") / (F.col("sd") + TINY))
    return rows.withColumn("effect", cohen_label(F.col("d")))


def cohen_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def rank_biserial_label(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "small").when(size < 0.5, "medium").otherwise("large")


def wilcoxon(differences: DataFrame, by: tuple = ("first", "second"), ties: bool = False) -> DataFrame:
    """Signed ranks over non-zero differences: W, tie-corrected z and rank-biserial effect. Families of zeros alone give W 0. With ties also
    how many differences are zero, and how much others are tied."""
    by = list(by)
    rows = differences.withColumn("size", F.abs("delta"))
    ranked = ranked_values(rows.filter("delta <> 0"), by, "size", {"up": F.count_if(F.col("delta") > 0)})
    m = F.col("m")
    sums = ranked.groupBy(*by).agg(F.sum(m).alias("n"), F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(m * F.col("rank")).alias("all"), F.sum(m * (m * m - 1)).alias("tied"))
    n = F.col("n")
    sums = sums.withColumn("w", F.least(F.col("plus"), F.col("all") - F.col("plus")))
    sums = sums.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)).withColumn("effect", 1 - 4 * F.col("w") / (n * (n + 1)))
    families = rows.groupBy(*by).agg(F.count_if(F.col("delta") == 0).alias("zeros"))
    more = [F.coalesce("tied", F.lit(0)).alias("tied"), "zeros"] if ties else []
    return families.join(sums.select(*by, "n", "w", "z", "effect", "tied"), by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), "z", F.coalesce("effect", F.lit(0.0)).alias("effect"), *more)


def mann_whitney(samples: DataFrame, by: list[str], group: str, value: str, ties: bool = False) -> DataFrame:
    """U of the smaller group name against the other within each family of two groups, z (with and without ties) and effect; with ties also how
    much values are tied."""
    low = samples.groupBy(*by).agg(F.min(group).alias("_low"))
    rows = samples.join(low, by)
    first = F.col(group) == F.col("_low")
    m = F.col("m")
    ranked = ranked_values(rows, by, value, {"mine": F.count_if(first)})
    sums = ranked.groupBy(*by).agg(F.sum("mine").alias("n1"), F.sum(m - F.col("mine")).alias("n2"), F.sum(F.col("mine") * F.col("rank")).alias("r1"), F.sum(m * (m * m - 1)).alias("tied"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sums = sums.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    away = F.abs(F.col("u") - n1 * n2 / 2)
    sums = sums.withColumn("z", F.try_divide(away - 0.5, F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tied"), n * (n - 1))))))  # null where all values are equal
    return sums.withColumn("effect", F.try_divide(away, F.sqrt(n1 * n2 * (n + 1) / 12) * F.sqrt(n))).drop("r1", *([] if ties else ["tied"]))


def complete_blocks(results: DataFrame, by: list[str], factor: tuple = ()) -> DataFrame:
    """Rows of blocks that every algorithm of their factor has: counts meet the number of algorithms. Without a factor that is one row."""
    full = results.groupBy(*factor, *by).agg(F.count_distinct("algorithm").alias("m"))
    every = results.groupBy(*factor).agg(F.count_distinct("algorithm").alias("k"))
    met = full.join(every, list(factor)) if factor else full.crossJoin(F.broadcast(every))
    return results.join(met.filter(F.col("m") == F.col("k")).select(*factor, *by), [*factor, *by], "left_semi")


def friedman(results: DataFrame, by: list[str], factor: tuple = ()) -> DataFrame:
    """Tie-corrected chi-square over complete blocks, Kendall's W, blocks and conditions, of each factor."""
    ranked = _block_ranks(results, by, factor)
    per = ranked.groupBy(*factor, "algorithm").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"))
    out = per.groupBy(*factor).agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum("tied").alias("tied"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    out = out.withColumn("chi2", F.try_divide(12 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1), 1 - F.col("tied") / (n * k * (k * k - 1))))
    return out.select(*factor, "n", "k", "chi2", (F.col("chi2") / (n * (k - 1))).alias("kendall_w"))


def _block_ranks(results: DataFrame, by: list[str], factor: tuple = ()) -> DataFrame:
    block = [*factor, *by]
    return complete_blocks(results, by, factor).withColumn("rank", midrank(block, "length")).withColumn("ties", F.count("*").over(W.partitionBy(*block, "length")))


def conover(results: DataFrame, by: list[str], factor: tuple = ()) -> DataFrame:
    """Post-hoc t of rank sums for all pairs of conditions of each factor, with degrees of freedom."""
    ranked = _block_ranks(results, by, factor)
    per = ranked.groupBy(*factor, "algorithm").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.sum(F.col("rank") * F.col("rank")).alias("a"))
    every = W.partitionBy(*factor)  # a row for each condition
    per = per.withColumn("k", F.count("*").over(every)).withColumn("a", F.sum("a").over(every)).withColumn("rr", F.sum(F.col("r") * F.col("r")).over(every))
    a, b = per.select(*factor, F.col("algorithm").alias("first"), F.col("r").alias("r1"), "n", "k", "a", "rr"), per.select(*[F.col(c).alias(f"_{c}") for c in factor], F.col("algorithm").alias("second"), F.col("r").alias("r2"))
    on = F.col("first") < F.col("second")
    for c in factor:
        on = on & (F.col(c) == F.col(f"_{c}"))
    met = a.join(b, on)
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    df = (n - 1) * (k - 1)
    return met.select(*factor, "first", "second", F.try_divide(F.abs(F.col("r1") - F.col("r2")), F.sqrt(F.try_divide(2 * (n * F.col("a") - F.col("rr")), df))).alias("t"), df.alias("df"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of the ranks of x and y within each family, from the counts of their pairs of values."""
    pairs_ = rows.groupBy(*by, x, y).agg(F.count("*").alias("_c"))
    rank = lambda v, name: ranked_values(rows, by, v).select(*by, v, F.col("rank").alias(name))
    ranked = pairs_.join(rank(x, "rx"), [*by, x]).join(rank(y, "ry"), [*by, y])
    c, rx, ry = F.col("_c").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(c * rx).alias("sx"), F.sum(c * ry).alias("sy"), F.sum(c * rx * ry).alias("xy"), F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy"))
    n = F.col("n")
    cov = lambda a, b, ab: F.col(ab) / n - F.col(a) / n * (F.col(b) / n)
    # null where one side is constant
    return sums.select(*by, F.try_divide(cov("sx", "sy", "xy"), F.sqrt(cov("sx", "sx", "xx")) * F.sqrt(cov("sy", "sy", "yy"))).alias("rho"), "n")


def mcnemar(results: DataFrame) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic of each pair of algorithms."""
    return discordant(pairs(results, ("success",)), ["first", "second"])


def discordant(paired: DataFrame, by: list[str], flag: str = "success") -> DataFrame:
    """The same for pairs of rows (flag_1, flag_2) of each family; pairs with a null don't count."""
    one, two = F.col(f"{flag}_1"), F.col(f"{flag}_2")
    rows = paired.groupBy(*by).agg(F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"))
    off = F.abs(F.col("b") - F.col("c")) - 1
    return rows.withColumn("statistic", F.when(F.col("b") + F.col("c") == 0, 0.0).otherwise(off * off / (F.col("b") + F.col("c"))))


def levene(samples: DataFrame, group: str, value: str, by: tuple = ()) -> DataFrame:
    """One-way F of absolute deviations from group medians, within each family."""
    medians = quantiles(samples, [*by, group], value, {"middle": 0.5})
    z = samples.join(medians, [*by, group]).select(*by, group, F.abs(F.col(value) - F.col("middle")).alias("z"))
    per = z.groupBy(*by, group).agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    whole = per.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("ss").alias("ss"))
    k, n = F.col("k"), F.col("n")
    return whole.select(*by, "k", "n", F.try_divide((n - k) / (k - 1) * (F.col("between") - F.col("s") * F.col("s") / n), F.col("ss") - F.col("between")).alias("statistic"))


def rm_anova(results: DataFrame, by: list[str]) -> DataFrame:
    """Repeated measures over complete blocks: F of conditions against the residual, and eta squared."""
    rows = complete_blocks(results, by)
    mean = lambda keys, name: rows.groupBy(*keys).agg(F.avg("length").alias(name), F.count("*").alias("m"))
    grand = rows.agg(F.avg("length").alias("g"))  # one row, as all that follow
    spread = lambda means, name: means.crossJoin(F.broadcast(grand)).agg(F.sum(F.col("m") * (F.col(name) - F.col("g")) * (F.col(name) - F.col("g"))).alias(f"ss_{name}"), F.count("*").alias(f"n_{name}"))
    total = rows.select(F.col("length").alias("v"), F.lit(1).alias("m")).crossJoin(F.broadcast(grand)).agg(F.sum((F.col("v") - F.col("g")) * (F.col("v") - F.col("g"))).alias("total"))
    sums = total.crossJoin(spread(mean(["algorithm"], "c"), "c")).crossJoin(spread(mean(by, "s"), "s"))
    k, n = F.col("n_c"), F.col("n_s").cast("double")
    error = F.col("total") - F.col("ss_c") - F.col("ss_s")
    return sums.select(k.alias("k"), n.alias("n"), (F.col("ss_c") / (k - 1) / (error / ((k - 1) * (n - 1)))).alias("f"), (F.col("ss_c") / F.col("total")).alias("eta2"))


def jonckheere(samples: DataFrame, group: str, value: str, by: tuple = ()) -> DataFrame:
    """Trend over ordered groups within each family: J is what each value exceeds in lower groups, from running counts and not from
    pairs of values. Groups are a handful, values may be any number."""
    keys = list(by) or ["_all"]
    rows = samples if by else samples.withColumn("_all", F.lit(1))
    counts = rows.groupBy(*keys, group, value).agg(F.count("*").alias("m"))
    sizes = rows.groupBy(*keys, group).agg(F.count("*").alias("n"))
    # for every pair of groups: the values of both, with how often each has them
    other = sizes.select(*keys, F.col(group).alias("other"))
    met = counts.join(other, keys).filter(F.col(group) != F.col("other"))
    low = F.col(group) < F.col("other")
    both = met.groupBy(*keys, F.least(group, "other").alias("low"), F.greatest(group, "other").alias("high"), value).agg(F.sum(F.when(low, F.col("m")).otherwise(0)).alias("m1"), F.sum(F.when(low, 0).otherwise(F.col("m"))).alias("m2"))
    placed = with_before(both, [*keys, "low", "high"], [value], {"m1": "below"})
    j = placed.groupBy(*keys).agg(F.sum(F.col("m2") * (F.col("below") + F.col("m1") / 2)).alias("j"))
    n = F.col("n")
    sums = sizes.groupBy(*keys).agg(F.sum(n).cast("double").alias("_n"), F.sum(n * n).alias("n2"), F.sum(n * n * (2 * n + 3)).alias("n3"))
    n = F.col("_n")
    mean, var = (n * n - F.col("n2")) / 4, (n * n * (2 * n + 3) - F.col("n3")) / 72
    return sums.join(j, keys).select(*by, "j", mean.alias("mean"), var.alias("variance"), F.try_divide(F.col("j") - mean, F.sqrt(var)).alias("z"))


def holm(tests: DataFrame, family: list[str], p: str = "p", order: tuple = (), monotone: bool = True, size: Column | None = None) -> DataFrame:
    """Step-down adjusted p: p * (m - place), at most 1, and with monotone never below that of a smaller p. m is the number of tests there
    are, or size, where more were asked for."""
    w = W.partitionBy(*family).orderBy(p, *order)
    m = size if size is not None else F.count("*").over(W.partitionBy(*family))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    rows = tests.withColumn("p_holm", raw)
    return rows.withColumn("p_holm", F.max("p_holm").over(w.rowsBetween(W.unboundedPreceding, 0))) if monotone else rows


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p", order: tuple = ()) -> DataFrame:
    """Step-up adjusted p: the least of p * m / place over this and larger p, at most 1."""
    w = W.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(W.partitionBy(*family))
    rows = tests.withColumn("place", F.row_number().over(w)).withColumn("q", F.col(p) * m / F.col("place"))
    down = W.partitionBy(*family).orderBy(F.col("place").desc()).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("p_bh", F.least(F.lit(1.0), F.min("q").over(down))).drop("place", "q")


def boxplot(results: DataFrame, by: tuple = ("algorithm", "window_size"), value: str = "length") -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = quantiles(results, list(by), value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return results.join(q, list(by)).groupBy(*by, "q1", "q2", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"), F.count_if(inside.isNull()).alias("n_outliers"))


def bootstrap_medians(results: DataFrame, by: list[str], resamples: int = 1_000, seed: int = 42) -> DataFrame:
    """Mean and 95 % range of bootstrap medians of lengths.

    The k-th smallest of n draws with replacement stands at the place that the k-th smallest of n uniform numbers points to. So only
    that number is drawn for each resample, from its own (beta) distribution and by a hash of (seed, resample, family), and the
    values at the places are looked up: reruns agree, and no resample is ever spread out."""
    rows = results.filter(F.col("length").isNotNull()).select(*by, "length", "subject_id").withColumn("_one", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
    placed = with_before(rows, by, ["length", "subject_id", "_row"], {"_one": "place"}).select(*by, "place", "length")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))

    @F.pandas_udf("struct<low: long, high: long>")
    def drawn(n: pd.Series, h: pd.Series) -> pd.DataFrame:
        n = n.to_numpy()
        low, high = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
        for i, (size, key) in enumerate(zip(n.tolist(), h.tolist(), strict=True)):
            rng, k = np.random.default_rng(key % 2**64), (size + 1) // 2
            u = rng.beta(k, size - k + 1)
            v = u if size % 2 else u + (1 - u) * (1 - rng.random() ** (1 / (size - k)))  # the next larger one
            low[i], high[i] = min(int(u * size), size - 1), min(int(v * size), size - 1)
        return pd.DataFrame({"low": low, "high": high})

    draws = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.withColumn("d", drawn("n", F.xxhash64(F.lit(seed), "b", *by))).select(*by, "b", F.explode(F.array("d.low", "d.high")).alias("place"))
    medians = draws.join(placed, [*by, "place"]).groupBy(*by, "b").agg(F.avg("length").alias("m"))
    return medians.groupBy(*by).agg(F.avg("m").alias("median"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))  # a bounded number of resamples


def first_overlapping(windows: DataFrame, algorithm: str = "algorithm") -> DataFrame:
    """The first window whose range overlaps that of the window with the least bootstrap median."""
    order = W.partitionBy(algorithm).orderBy("median", "window_size")
    best = windows.withColumn("best_low", F.first("low").over(order)).withColumn("best_high", F.first("high").over(order))
    return best.filter("low <= best_high and high >= best_low").groupBy(algorithm).agg(F.min("window_size").alias("window_size"))
