"""Slots, hours, gaps and incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.functions.time import ends_month, time_key
from galewise.operators.ranks import with_before, with_last


def slot_totals(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """One frame a slot: what was seen, and how much."""
    return rows.groupBy(*by, "slot").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def informative_hours(rows: DataFrame, flag: Column) -> DataFrame:
    """Hours whose minute-0 slot has a row with the flag, and how many such rows it has."""
    first = rows.filter(F.minute("slot") == 0)
    return first.groupBy(F.date_trunc("hour", "slot").cast("timestamp_ntz").alias("hour")).agg(F.count_if(flag).alias("n_informative")).filter("n_informative > 0")


def hour_windows(slots: DataFrame, hours: DataFrame, value: str = "total", size: int = 12) -> DataFrame:
    """For each informative hour the twelve values in order of slots; missing slots repeat the last one, and hours that miss minute 0
    are dropped."""
    grid = hours.select("hour", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).withColumn("slot", F.col("hour") + F.make_interval(mins=F.col("i") * 5))
    filled = carried(grid.join(slots.select("slot", value), "slot", "left"), ["hour"], "slot", value)
    packed = filled.groupBy("hour").agg(F.array_sort(F.collect_list(F.struct("i", f"{value}_filled"))).alias("s"), F.count(f"{value}_filled").alias("n"))
    return packed.filter(F.col("n") == size).select("hour", F.transform("s", lambda x: x[f"{value}_filled"]).alias("sequence"))


def carried(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Last observation carried forward within groups of a bounded number of rows, as the slots of an hour."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(f"{value}_filled", F.last(value, ignorenulls=True).over(w))


def carried_far(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Last observation carried forward without a bound, over any number of rows."""
    return with_last(rows, by, order, value, f"{value}_filled")


def carried_within(rows: DataFrame, by: list[str], order: str, value: str, slots: int, minutes: int = 5) -> DataFrame:
    """Last observation carried forward over so many slots at most. Rows are a grid; the time is compared, and not counted rows."""
    found = with_last(rows, by, order, value, "_last", "_seen")
    fresh = F.col("_seen") >= F.col(order) - F.expr(f"interval {slots * minutes} minutes")
    return found.select(*rows.columns, F.when(fresh, F.col("_last")).alias(f"{value}_filled"))


def slot_grid(rows: DataFrame, by: list[str], minutes: int = 5) -> DataFrame:
    """All slots between the first and the last of each key, or of the whole table."""
    ends = rows.groupBy(*by).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b", F.expr(f"interval {minutes} minutes"))).alias("slot"))


def sliding_windows(keys: DataFrame, size: int, by: list[str] = []) -> DataFrame:
    """Windows [t, t + size) over the dense order of keys; the last ones are dropped where they are not full. Each key goes to the windows that
    it is in; a window has size rows."""
    placed = with_before(keys.select(*by, "time_key").withColumn("_one", F.lit(1)), by, ["time_key"], {"_one": "at"}).drop("_one")
    first = F.greatest(F.lit(0), F.col("at") - size + 1)
    spread = placed.withColumn("t_idx", F.explode(F.sequence(first, F.col("at"))))
    packed = spread.groupBy(*by, "t_idx").agg(F.sort_array(F.collect_list("time_key")).alias("keys")).filter(F.size("keys") == size)
    return packed.select(*by, F.get("keys", F.lit(0)).alias("time_key"), F.col("t_idx").cast("int").alias("t_idx"), "keys")


def scene_keys(scenes: DataFrame, forward: int = 30, backward: int = 5, minutes: int = 5) -> DataFrame:
    """Time keys that a scene needs: obstacles and images forward, images alone backward."""
    step = F.expr(f"interval {minutes} minutes")
    ts = F.col("ts")
    keys = F.sequence(ts - F.expr(f"interval {backward * minutes} minutes"), ts + F.expr(f"interval {(forward - 1) * minutes} minutes"), step)
    return scenes.select("scene", "ts", F.explode(keys).alias("at")).select("scene", time_key(F.col("at")).alias("time_key"), (F.col("at") >= ts).alias("need_csv"))


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no output yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def monthly(rows: DataFrame, ts: str = "slot") -> DataFrame:
    """Month of each row and whether its slot closes it."""
    return rows.withColumn("month", F.date_format(ts, "yyyy-MM")).withColumn("closes", ends_month(F.col(ts)))


#: Letters of the parts by which texts are indexed.
GRAM = 3


def _grams(text: Column, whole: bool) -> Column:
    """The parts of GRAM letters of a text; with whole the shorter ones, and the empty one, too."""
    n = F.length(text)
    sizes = range(GRAM + 1) if whole else (GRAM,)
    parts = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[parts(k) for k in sizes])))


def first_match(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """For each wanted text the first known one (by idx): an exact match, else one that begins with it, else one that holds it.

    Known texts are indexed by their parts of three letters and less. A wanted text holds a part that is in all that hold it: of its parts the
    one in the fewest known texts fetches candidates, by equality, and these are compared. Nulls match nothing; an empty text is held by all."""
    asked = wanted.filter("wanted is not null").select("wanted").distinct()
    parts = asked.select("wanted", F.explode(F.when(F.length("wanted") >= GRAM, _grams(F.col("wanted"), False)).otherwise(F.array("wanted"))).alias("gram"))
    index = known.filter("timestamp is not null").select("idx", "timestamp", F.explode(_grams(F.col("timestamp"), True)).alias("gram"))
    counts = index.select("gram").join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    keyed = parts.join(counts, "gram", "left").groupBy("wanted").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    met = index.join(keyed, "gram").filter(F.col("timestamp").contains(F.col("wanted")))
    rank = F.when(F.col("timestamp") == F.col("wanted"), 0).when(F.col("timestamp").startswith(F.col("wanted")), 1).otherwise(2)
    return met.groupBy("wanted").agg(F.min_by(F.struct("idx", "timestamp"), F.struct(rank, F.col("idx"))).alias("m")).select("wanted", "m.idx", "m.timestamp")


def split_by_order(files: DataFrame, train: int) -> DataFrame:
    """Train and test by the order of file names: the first `train`, then one."""
    place = F.col("_place")
    placed = with_before(files.withColumn("_one", F.lit(1)), [], ["file"], {"_one": "_place"}).drop("_one")
    return placed.withColumn("part", F.when(place < train, "train").when(place == train, "test")).filter("part is not null").drop("_place")


def offsets(files: DataFrame) -> DataFrame:
    """First global index of each file."""
    return with_before(files, [], ["file"], {"n": "start"})


def located(indices: DataFrame, files: DataFrame) -> DataFrame:
    """(index, file, offset) of global indices; those past the end are dropped. Indices and files meet in ranges of equal width, as many as
    there are files."""
    placed = offsets(files)
    width = F.greatest(F.lit(1), F.ceil(F.sum("n") / F.count("*"))).cast("long")
    each = files.agg(width.alias("width"))  # one row
    cover = placed.filter("n > 0").crossJoin(F.broadcast(each)).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("n") - 1) / F.col("width"))))).drop("width")
    dealt = indices.crossJoin(F.broadcast(each)).withColumn("cell", F.floor(F.col("index") / F.col("width"))).drop("width")
    met = dealt.join(cover, "cell").filter("index >= start and index < start + n")
    return met.select("index", "file", (F.col("index") - F.col("start")).alias("offset"))
