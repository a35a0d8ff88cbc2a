"""Mixing sources to target weights by entropy balancing.

A document's rate is the number of copies it should give. Among all rates that meet each source's token target and
stay within the cap, those of least entropy relative to taking every document once are exponential tilts,
min(cap, exp(lambda * size / mean size)), with one multiplier a source. The multipliers solve a convex dual; each
Newton step sums over the table of (source, size) cells, safeguarded by a bracket.

Rates are then rounded into copies. Documents of one source and size are alike to every constraint, so that rounding
works on cells: systematically from the largest size down, which leaves a rest of less than a few large documents, and
then the rest is made up from the smallest documents up. The copies of a cell are dealt to its documents in the order
of a hash; cells are cut into blocks of a bounded number of rows for that, with the blocks' offsets from counts.

Scale: one pass over the texts; everything after it is on narrow rows or on cells, whose number is bounded by sources
times distinct sizes. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.llm.common import drop_path, native_word_count, written
from galewise.operators.ranks import with_before

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Rows of a cell that are ranked together.
BLOCK_ROWS = 2_000
#: Crowded hashes are sent to all tasks up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Newton steps in one job, most jobs, and the relative error at which the dual counts as solved.
STEPS, ROUNDS, TOLERANCE = 8, 10, 1e-6


def targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source_size, docs, target): a share of all sizes dealt by weight, in the code point order of sources, null last. No
    target exceeds cap times its source's size; what is over goes to the others by weight. In closed form: sources in the order
    of cap * size / weight fill up one after the other, and the level of the rest is the highest that this order gives."""
    per = cells.groupBy("key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    per = with_before(per.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1)), [], ["none", "source"], {"one": "place"})
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("full", cap * F.col("source_size"))
    filled = with_before(per.withColumn("fill", F.col("full") / F.col("weight")), [], ["fill", "key"], {"full": "before", "weight": "lighter"})
    sums = per.agg((share * F.sum("source_size")).alias("budget"), F.sum("weight").alias("weights"))  # one row, as the next
    levels = filled.crossJoin(F.broadcast(sums)).agg(F.max(F.try_divide(F.col("budget") - F.col("before"), F.col("weights") - F.col("lighter"))).alias("level"))
    return per.crossJoin(F.broadcast(levels)).select("key", "source_size", "docs", F.least(F.col("full"), F.col("weight") * F.col("level")).alias("target"))


def rate(cap: float) -> Column:
    """Rate of a cell under its source's multiplier."""
    tilt = F.least(F.lit(cap), F.exp(F.col("lam") * F.col("z")))
    return F.when(F.col("size") == 0, 1.0).when(F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)), cap).otherwise(tilt)


def _step(cells: DataFrame, cap: float) -> DataFrame:
    """One safeguarded Newton step of the dual for all sources: sums over each source's cells, which stay where they are."""
    every = W.partitionBy("key")
    met = cells.withColumn("r", rate(cap)).withColumn("tokens", F.col("n") * F.col("size") * F.col("r"))
    met = met.withColumn("f", F.sum("tokens").over(every) - F.col("target")).withColumn("g", F.sum(F.when(F.col("r") < cap, F.col("tokens") * F.col("z")).otherwise(0.0)).over(every))
    met = met.withColumn("lo", F.when(F.col("f") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") < 0, F.col("hi")).otherwise(F.col("lam")))
    newton = F.when(F.col("g") > 0, F.col("lam") - F.try_divide("f", "g"))
    inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
    between = F.when(F.col("lo") <= -1e9, 2 * F.col("hi") - 1).when(F.col("hi") >= 1e9, 2 * F.col("lo") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
    error = F.when(_settled(cap), 0.0).otherwise(F.abs("f") / F.greatest("target", F.lit(1.0)))
    return met.withColumn("error", error).withColumn("lam", F.when(F.col("error") <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise(between)).select(cells.columns)


def _settled(cap: float) -> Column:
    """Sources without words or with full targets need no multiplier."""
    return (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12)))


def solved(cells: DataFrame, aims: DataFrame, cap: float = CAP) -> DataFrame:
    """(key, size, n, source_size, target, z, lam): the cells with their sources' multipliers. Cells are dealt by source once; the steps of
    a job follow each other without a shuffle. A source has no more cells than its documents have sizes."""
    spark = cells.sparkSession
    now = cells.select("key", "size", "n").join(aims, "key").withColumn("z", F.coalesce(F.try_divide(F.col("size") * F.col("docs"), F.col("source_size")), F.lit(0.0))).drop("docs")
    now = now.withColumn("lam", F.lit(0.0)).withColumn("lo", F.lit(-1e12)).withColumn("hi", F.lit(1e12)).withColumn("error", F.lit(1.0))
    path = None
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            now = _step(now, cap)
        after, new = written(now, "dual")
        if path:
            drop_path(spark, path)
        now, path = after, new
        error = now.agg(F.max("error")).first()[0] or 0.0
        if error <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual is not solved after {ROUNDS * STEPS} steps: relative error {error}")
    return now.drop("lo", "hi", "error")


def copies_of_cells(cells: DataFrame, cap: float = CAP) -> DataFrame:
    """(key, size, n, k, source_size, target, rate): k copies for the n documents of a solved cell, at most cap times n."""
    met = cells.withColumn("rate", rate(cap))
    met = met.withColumn("room", F.floor(F.col("n") * cap)).withColumn("due", F.col("n") * F.col("rate"))
    down = W.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    so_far = F.sum("due").over(down)
    met = met.withColumn("k", F.floor(so_far + 0.5) - F.floor(so_far - F.col("due") + 0.5))
    met = met.withColumn("k", F.greatest(F.lit(0), F.least(F.col("room"), F.col("k"))).cast("long"))
    met = met.withColumn("rest", F.col("target") - F.sum(F.col("k") * F.col("size")).over(W.partitionBy("key")))
    free = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.col("room") - F.col("k")).otherwise(F.col("k"))
    up = W.partitionBy("key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    met = met.withColumn("free", free)
    left = F.abs("rest") - F.coalesce(F.sum(F.col("free") * F.col("size")).over(up), F.lit(0))
    more = F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("free"), F.greatest(F.lit(0), F.floor(F.try_divide(left, F.col("size")) + 0.5))))
    return met.select("key", "size", "n", (F.col("k") + F.signum("rest").cast("long") * more).cast("long").alias("k"), "source_size", "target", "rate")


def mixed_rows(docs: DataFrame, carry: bool, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, rate, copies, and with carry the struct _doc of its columns."""
    own = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []),
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("key"), F.col(source_col).alias("source"),
        native_word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    own, _ = written(own, "sized")  # written, so that row numbers stay as they are when a task is run again
    cells, _ = written(own.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "cells")
    plan, _ = written(copies_of_cells(solved(cells, targets(cells, weights, share, cap), cap), cap), "copies")
    blocks = max(1, -(-(cells.agg(F.sum("n")).first()[0] or 0) // block_rows))
    own = own.withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
    counted, full = _counted(own, parts := ["block"]), 4 * block_rows
    if (counted.agg(F.max("m")).first()[0] or 0) > full:
        # equal rows have one hash and fall into one block: those of a crowded hash are cut into parts by their row number. They are alike,
        # so that it doesn't matter which of them come first
        crowded = counted.filter(F.col("m") > full).select("key", "size", "block")
        hot, _ = written(own.join(crowded, ["key", "size", "block"], "left_semi").groupBy("key", "size", "h").agg(F.count("*").alias("m")).filter(F.col("m") > block_rows).select("key", "size", "h", F.ceil(F.col("m") / block_rows).alias("cuts")), "crowded")
        own = own.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["key", "size", "h"], "left")
        # in a block: first what is not crowded, then each crowded hash, part by part
        is_hot = F.col("cuts").isNotNull()
        own = own.withColumn("crowd", F.when(is_hot, F.col("h")).otherwise(0)).withColumn("cut", F.when(is_hot, F.pmod(F.xxhash64("row"), F.col("cuts"))).otherwise(-1)).withColumn("is_crowd", is_hot).drop("cuts")
        counted = _counted(own, parts := ["block", "is_crowd", "crowd", "cut"])
    cell = ["key", "size", *parts]
    met = own.join(counted.drop("m").join(plan, ["key", "size"]), cell)
    rank = F.col("offset") + F.row_number().over(W.partitionBy(*cell).orderBy("h", "id", "row"))
    extra = F.when(rank <= F.col("k") % F.col("n"), 1).otherwise(0)
    return met.select(*(["_doc"] if carry else []), "id", "size", "source_size", "target", "rate", (F.floor(F.col("k") / F.col("n")) + extra).cast("long").alias("copies"))


def _counted(rows: DataFrame, parts: list[str]) -> DataFrame:
    """(key, size, parts, m, offset): rows of each part of a cell, and rows of the cell in the parts before it."""
    before = W.partitionBy("key", "size").orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)
    return rows.groupBy("key", "size", *parts).agg(F.count("*").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target (of its source), taken (words the mix takes, repeats counted), rate,
    copies.

    A null text has size 0, and documents of size 0 stay as they are, with nothing taken. A null source is a source of its own and
    comes last. Repeated rows are documents of their own. Which document of equal source and size gives one copy more is decided
    by a hash of its id and text, so that reruns agree. An empty table gives no rows; other columns are ignored.
    """
    rows = mixed_rows(docs, False, id_col, text_col, source_col, weights, share, cap, block_rows)
    return rows.select(F.col("id").alias(id_col), "size", F.col("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The mix itself: rows of docs, each as often as the mix takes it, with the same columns, whatever their names.

    Null and empty texts stay once each. A null source is a source of its own. Repeated rows are documents of their own; texts of any
    length count by their words. An empty table gives none.
    """
    rows = mixed_rows(docs, True, id_col, text_col, source_col, weights, share, cap, block_rows)
    return rows.filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_doc.*")
