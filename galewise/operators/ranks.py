"""Places, ranks and quantiles by counting.

A family may hold any share of all rows, so that no window runs over one. For ranks equal values are counted first; the distinct values are
dealt out by range, and each range learns from the ranges' totals what comes before it. Quantiles are selected by histograms, without an order of
all values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.sources.shared import drop_path, written


def _dealt(rows: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, list[str]]:
    """rows in ranges of their order, written, with the range's number, and the columns of a family: one for all rows where by is empty."""
    given = rows if by else rows.withColumn("_all", F.lit(1))
    keys = list(by) or ["_all"]
    return written(given.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "dealt")[0], keys


def with_before(counts: DataFrame, by: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """counts and, for each amount, a column (its name in `amounts`) with the sum over the rows that come before within `by`. Rows differ in
    their order."""
    dealt, keys = _dealt(counts, by, order)
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in amounts])
    ranges = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(ranges), F.lit(0)).alias(f"_{c}") for c in amounts])
    own = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.join(offsets, [*keys, "_range"])
    return rows.select(*counts.columns, *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(name) for c, name in amounts.items()])


def with_last(rows: DataFrame, by: list[str], order: str, value: str, name: str, seen: str | None = None) -> DataFrame:
    """rows and, as `name`, the last value that isn't null among this row and those before it within `by`; as `seen` the order of the row that it
    comes from. Each range tells its last value on, and ranges learn from those before them. Families with a null in `by` are left out; rows
    of a family differ in their order."""
    dealt, keys = _dealt(rows, by, [order])
    at = F.when(F.col(value).isNotNull(), F.col(order))
    tells = dealt.groupBy(*keys, "_range").agg(F.max_by(value, at).alias("_v"), F.max(at).alias("_at"))
    ranges = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    told = tells.select(*keys, "_range", *[F.last(c, ignorenulls=True).over(ranges).alias(c) for c in ("_v", "_at")])
    own = W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    met = dealt.join(told, [*keys, "_range"])
    here = lambda c, before: F.coalesce(F.last(c, ignorenulls=True).over(own), F.col(before))
    return met.select(*rows.columns, here(F.col(value), "_v").alias(name), *([here(at, "_at").alias(seen)] if seen else []))


def ranked_values(rows: DataFrame, by: list[str], value: str, sums: dict[str, F.Column] | None = None) -> DataFrame:
    """(by, value, m, rank): each distinct value, how often it is there, and its rank with ties averaged; and further sums over its rows."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("m"), *[c.alias(name) for name, c in (sums or {}).items()])
    return with_before(counts, by, [value], {"m": "_before"}).withColumn("rank", F.col("_before") + (F.col("m") + 1) / 2).drop("_before")


#: Buckets that a range of values is counted in, and values of a range that are sorted in one row.
BUCKETS, SORTED = 1_024, 10_000
_MOST = 1.7976931348623157e308


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles of value as a double, between two values in proportion. Nulls and NaN are left out;
    families of these alone too.

    Found by selection: values are counted in buckets between the least and the most of their family, the bucket that holds a place is
    counted in buckets in its turn, and so on, until all ranges that are left hold one value, or so few that they are sorted. What is shuffled are counts of
    buckets, and the values of the last ranges."""
    keys = list(by) or ["_all"]
    own = rows.select(*[F.col(c) for c in by], *([] if by else [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    ends = own.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    spot = lambda share: F.lit(share) * (F.col("_n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(spot(s)), F.ceil(spot(s))) for s in shares.values()])))
    sizes, _ = written(ends, "ends")
    open_, path = sizes.select(*keys, F.explode(wanted).alias("_place"), "_low", "_high", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_c")), None
    spark = rows.sparkSession
    while (most := open_.filter("_low < _high").agg(F.max("_c")).first()[0] or 0) > SORTED:
        ranges = open_.filter("_low < _high").select(*keys, "_low", "_high", "_before").distinct()
        half = lambda c: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.col(c))) / 2
        wide = half("_high") - half("_low")
        bucket = F.when(wide > 0, F.least(F.lit(BUCKETS - 1), F.floor((half("_v") - half("_low")) / wide * BUCKETS))).otherwise((F.col("_v") > F.col("_low")).cast("long"))
        counts = own.join(ranges, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_low", "_high", "_before", bucket.alias("_bucket")).agg(F.count("*").alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        sums = F.sum("_m").over(W.partitionBy(*keys, "_low", "_high").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))  # BUCKETS rows at most
        placed = counts.withColumn("_first", F.col("_before") + F.coalesce(sums, F.lit(0))).drop("_before")
        met = open_.filter("_low < _high").join(placed, [*keys, "_low", "_high"]).filter("_first <= _place and _place < _first + _m")
        narrowed = met.select(*keys, "_place", F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.col("_first").alias("_before"), F.col("_m").alias("_c"))
        open_, new = written(open_.filter("_low = _high").unionByName(narrowed), "ranges")
        if path:
            drop_path(spark, path)
        path = new
    found = open_.filter("_low = _high").select(*keys, "_place", F.col("_low").alias("_value"))
    if most:
        left = open_.filter("_low < _high")
        ranges = left.select(*keys, "_low", "_high").distinct()
        lists = own.join(ranges, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_low", "_high").agg(F.sort_array(F.collect_list("_v")).alias("_list"))  # SORTED values at most
        found = found.unionByName(left.join(lists, [*keys, "_low", "_high"]).select(*keys, "_place", F.get("_list", (F.col("_place") - F.col("_before")).cast("int")).alias("_value")))
    at = sizes.select(*keys, "_n").join(found, keys).groupBy(*keys, "_n").agg(*[F.max(F.when(F.col("_place") == f(spot(s)), F.col("_value"))).alias(f"_{e}_{n}") for n, s in shares.items() for e, f in (("low", F.floor), ("high", F.ceil))])
    between = lambda n, s: F.when(F.col(f"_low_{n}") == F.col(f"_high_{n}"), F.col(f"_low_{n}")).otherwise(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (spot(s) - F.floor(spot(s))))
    return at.select(*by, *[between(n, s).alias(n) for n, s in shares.items()])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows, which differ in their order, numbered from 0 in it."""
    return with_before(rows.withColumn("_one", F.lit(1)), [], order, {"_one": name}).drop("_one")
