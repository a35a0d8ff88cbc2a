"""p-values beside statistics, confidence intervals, and normality by group. The tables are small by then; tails are computed in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewise.kernels import special

TAILS = {
    "z": lambda z, a, b: 2 * special.normal_tail(abs(z)),
    "t": lambda t, df, b: special.t_two_sided(t, df),
    "f": special.f_tail,
    "chi2": lambda x, df, b: special.chi2_tail(x, df),
}


def with_p(rows: DataFrame, kind: str, statistic: str, df1: str | None = None, df2: str | None = None) -> DataFrame:
    """rows with the two-sided (z, t) or upper (f, chi2) p of a statistic; null where it is null."""
    tail = TAILS[kind]

    @F.pandas_udf("double")
    def p(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else min(1.0, max(0.0, tail(v, c, d))) for v, c, d in zip(x, a, b, strict=True)], dtype="float64")

    number = lambda c: F.col(c).cast("double") if c else F.lit(0.0)
    return rows.withColumn("p", p(number(statistic), number(df1), number(df2)))


#: As in SciPy's defaults: signed ranks are exact up to so many differences without a tie, rank sums where one sample is so small, without ties;
#: the larger one may have so many, as the number of its sums grows with both.
EXACT_SIGNED, EXACT_SMALLER, EXACT_LARGER = 50, 8, 250


def signed_rank_counts(n: Column) -> Column:
    """In how many of the 2^n choices of signs the ranks 1..n with a plus have the sum 0, 1, 2, ...; exact up to 62."""
    at = lambda c, s: F.coalesce(F.get(c, s), F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1).cast("long")), lambda c, k: F.transform(F.sequence(F.lit(0), F.size(c) + k - 1), lambda s: at(c, s) + at(c, s - k)))


def rank_sum_counts(small: Column, large: Column) -> Column:
    """In how many of the choices of `small` of small + large ranks U is 0, 1, 2, ...: the coefficients of the product of
    (1 - q^(large + i)) / (1 - q^i) for i from 1 to small."""
    at = lambda c, s: F.coalesce(F.get(c, s), F.lit(0).cast("long"))
    places = F.sequence(F.lit(0), (small * large).cast("int"))

    def step(c: Column, i: Column) -> Column:
        cut = F.transform(places, lambda s: at(c, s) - at(c, s - (large.cast("int") + i)))
        return F.transform(F.array(cut), lambda d: F.transform(places, lambda s: F.aggregate(F.sequence(F.lit(0), F.floor(s / i).cast("int")), F.lit(0).cast("long"), lambda x, k: x + at(d, s - k * i))))[0]

    return F.aggregate(F.sequence(F.lit(1), small.cast("int")), F.array(F.lit(1).cast("long")), step)


def _two_sided(counts: Column, upto: Column) -> Column:
    sum_ = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * sum_(F.slice(counts, 1, upto.cast("int") + 1)) / sum_(counts))


def exact_signed_p(rows: DataFrame) -> DataFrame:
    """rows of wilcoxon(ties=True) with p_exact: two-sided, from the null distribution of the smaller rank sum; null beyond EXACT_SIGNED
    differences and where some are tied or zero."""
    fit = (F.col("n").between(1, EXACT_SIGNED)) & (F.col("tied") == 0) & (F.col("zeros") == 0)
    known = rows.filter(fit).select("n").distinct().withColumn("_counts", signed_rank_counts(F.col("n")))  # EXACT_SIGNED rows at most
    return rows.join(F.broadcast(known), "n", "left").withColumn("p_exact", F.when(fit, _two_sided(F.col("_counts"), F.col("w")))).drop("_counts")


def exact_rank_sum_p(rows: DataFrame) -> DataFrame:
    """rows of mann_whitney(ties=True) with p_exact, from the null distribution of the smaller U; null where values are tied, the smaller sample has
    more than EXACT_SMALLER values or the larger one more than EXACT_LARGER."""
    small, large = F.least("n1", "n2"), F.greatest("n1", "n2")
    fit = small.between(1, EXACT_SMALLER) & (large <= EXACT_LARGER) & (F.col("tied") == 0)
    sized = rows.withColumn("_small", small).withColumn("_large", large).withColumn("_fit", fit)
    known = sized.filter("_fit").select("_small", "_large").distinct()
    known = known.withColumn("_counts", rank_sum_counts(F.col("_small"), F.col("_large")))  # EXACT_SMALLER * EXACT_LARGER rows at most
    u = F.least(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    return sized.join(known, ["_small", "_large"], "left").withColumn("p_exact", F.when(F.col("_fit"), _two_sided(F.col("_counts"), u))).drop("_small", "_large", "_fit", "_counts")


def intervals(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """The t interval (ci_low, ci_high) of tables with mean, sd and n; null below two values."""

    @F.pandas_udf("double")
    def reach(sd: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if k < 2 or pd.isna(s) else special.t_quantile((1 + confidence) / 2, k - 1) * s / k**0.5 for s, k in zip(sd, n, strict=True)], dtype="float64")

    r = reach(F.col("sd"), F.col("n"))
    return rows.withColumn("ci_low", F.col("mean") - r).withColumn("ci_high", F.col("mean") + r)


def normality(rows: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """W, p and whether p is over alpha, for each group of 3 to 5000 values; other groups give nulls. Larger groups are counted and never
    gathered."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, w double, p double, is_normal boolean"
    sizes = rows.groupBy(*by).agg(F.count(value).alias("n"))
    fit = sizes.filter(F.col("n").between(3, 5_000))

    def run(key, own):
        w, p = special.shapiro_wilk(own[value].dropna().to_numpy())
        return pd.DataFrame([(*key, int(own[value].count()), w, p, p > alpha)], columns=[*by, "n", "w", "p", "is_normal"])

    tested = rows.join(fit.select(*by), by, "left_semi").select(*by, value).groupBy(*by).applyInPandas(run, schema)
    rest = sizes.filter(~F.col("n").between(3, 5_000)).select(*by, "n", F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("boolean").alias("is_normal"))
    return tested.unionByName(rest)
