"""Time keys, hours, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.functions import time as ft
from galewise.operators import temporal as tm
from galewise.operators.ranks import numbered
from galewise.queries.registry import registry
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
KEYS = f"with {tb.OBSERVATIONS}, slots as (select distinct slot from observations)"
FMT = "'%Y_%m_%d_%H_%M_%S'"


def _slots(spark, sf_dir):
    return tb.observations(spark, sf_dir).select("slot").distinct()


@query(f"{KEYS} select strftime(slot, {FMT}) as time_key, slot, epoch(slot)::bigint as seconds from slots")
def time_keys(spark, sf_dir):
    rows = _slots(spark, sf_dir).withColumn("time_key", ft.time_key(F.col("slot")))
    return rows.select("time_key", ft.key_time(F.col("time_key")).alias("slot"), F.unix_seconds(F.col("slot").cast("timestamp")).alias("seconds"))


@query(f"{KEYS} select strftime(slot, {FMT}) as time_key, array_to_string([strftime(slot - i * interval '5 minutes', {FMT}) for i in [5, 4, 3, 2, 1, 0]], ',') as keys from slots")
def past_keys(spark, sf_dir):
    return _slots(spark, sf_dir).select(ft.time_key(F.col("slot")).alias("time_key"), F.array_join(ft.past_keys(F.col("slot")), ",").alias("keys"))


@query(f"{KEYS} select strftime(slot, {FMT}) as time_key, array_to_string([strftime(slot + i * interval '5 minutes', {FMT}) for i in [1, 2, 3]], ',') as three, array_to_string([strftime(slot + i * interval '5 minutes', {FMT}) for i in [1, 2, 3, 4, 5, 6]], ',') as zero_as_six, 0 as n_zero from slots")
def future_keys(spark, sf_dir):
    s = F.col("slot")
    return _slots(spark, sf_dir).select(ft.time_key(s).alias("time_key"), F.array_join(ft.future_keys(s, 3), ",").alias("three"), F.array_join(ft.future_keys(s, 0, zero_as=6), ",").alias("zero_as_six"), F.size(ft.future_keys(s, 0)).alias("n_zero"))


MONTHS = "hours as (select unnest(generate_series(timestamp '2024-01-31 20:00:00', timestamp '2024-03-01 02:00:00', interval '5 minutes')) as slot)"


@query(f"with {MONTHS} select slot, month(slot + interval '5 minutes') <> month(slot) as last_slot, month(slot + interval '1 hour') <> month(slot) as last_hour from hours")
def month_end_slots(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-31 20:00:00").cast("timestamp_ntz"), F.lit("2024-03-01 02:00:00").cast("timestamp_ntz"), F.expr("interval 5 minutes"))).alias("slot"))
    return grid.select("slot", ft.ends_month(F.col("slot")).alias("last_slot"), ft.ends_month(F.col("slot"), "1 hour").alias("last_hour"))


TOTALS = f"with {tb.OBSERVATIONS}, totals as (select slot, count(*) as n, round(sum(value), 4) as total from observations group by 1)"
HOURS = f"{TOTALS}, hours as (select date_trunc('hour', slot) as hour, count(*) filter (where value > 40) as n_informative from observations where minute(slot) = 0 group by 1 having count(*) filter (where value > 40) > 0)"


@query(f"{HOURS} select hour::timestamp as hour, n_informative from hours")
def informative_hours(spark, sf_dir):
    return tm.informative_hours(tb.observations(spark, sf_dir), F.col("value") > 40)


@query(f"""{HOURS}, grid as (select hour, i, hour + i * interval '5 minutes' as slot from hours, range(0, 12) t(i)), j as (select g.*, total from grid g left join totals t on g.slot = t.slot),
f as (select *, last_value(total ignore nulls) over (partition by hour order by slot rows unbounded preceding) as v from j)
select hour::timestamp as hour, array_to_string(list(v::decimal(18, 2) order by i), ',') as sequence from f group by hour having count(v) = 12""")
def hour_windows(spark, sf_dir):
    rows = tb.observations(spark, sf_dir)
    out = tm.hour_windows(tm.slot_totals(rows), tm.informative_hours(rows, F.col("value") > 40))
    return out.select("hour", F.array_join(F.transform("sequence", lambda v: v.cast("decimal(18,2)").cast("string")), ",").alias("sequence"))


GRID = f"{TOTALS}, grid as (select unnest(generate_series((select min(slot) from totals), (select max(slot) from totals), interval '5 minutes')) as slot)"


@query(f"{GRID} select slot, total, last_value(total ignore nulls) over (order by slot rows unbounded preceding) as total_filled from grid left join totals using (slot)")
def locf_gap_fill(spark, sf_dir):
    slots = tm.slot_totals(tb.observations(spark, sf_dir)).drop("n")
    return tm.carried_far(tm.slot_grid(slots, []).join(slots, "slot", "left"), [], "slot", "total")


@query(f"{GRID}, seen as (select slot as at, total as v from totals) select g.slot, t.total, case when s.at >= g.slot - interval '10 minutes' then s.v end as total_filled from grid g left join totals t using (slot) asof left join seen s on g.slot >= s.at")
def asof_bounded(spark, sf_dir):
    slots = tm.slot_totals(tb.observations(spark, sf_dir)).drop("n")
    return tm.carried_within(tm.slot_grid(slots, []).join(slots, "slot", "left"), [], "slot", "total", 2)


@query(f"{KEYS}, k as (select strftime(slot, {FMT}) as time_key, row_number() over (order by slot) - 1 as t_idx from slots), m as (select count(*) as n from k) select a.time_key, a.t_idx::integer as t_idx, string_agg(b.time_key, ',' order by b.t_idx) as keys from k a join k b on b.t_idx between a.t_idx and a.t_idx + 2 cross join m where a.t_idx + 2 < m.n group by all")
def sliding_keys(spark, sf_dir):
    keys = _slots(spark, sf_dir).select(ft.time_key(F.col("slot")).alias("time_key"))
    return tm.sliding_windows(keys, 3).select("time_key", "t_idx", F.array_join("keys", ",").alias("keys"))


SCENES = f"with {tb.OBSERVATIONS}, scenes as (select distinct date_trunc('day', slot) + interval '12 hours' as ts from observations)"


@query(f"{SCENES} select strftime(ts, {FMT}) as scene, strftime(ts + i * interval '5 minutes', {FMT}) as time_key, i >= 0 as need_csv from scenes, range(-5, 30) t(i)")
def scene_keys(spark, sf_dir):
    ts = F.date_trunc("day", "slot").cast("timestamp_ntz") + F.expr("interval 12 hours")
    scenes = tb.observations(spark, sf_dir).select(ts.alias("ts")).distinct().withColumn("scene", ft.time_key(F.col("ts")))
    return tm.scene_keys(scenes)


@query(f"with {tb.OBSERVATIONS} select slot, count(*) as n from observations where slot not in (select slot from observations where event_type = 'error') group by 1")
def incremental_antijoin(spark, sf_dir):
    rows = tb.observations(spark, sf_dir)
    return tm.not_done(rows, rows.filter("event_type = 'error'"), ["slot"]).groupBy("slot").agg(F.count("*").alias("n"))


@query(f"with {tb.OBSERVATIONS} select strftime(slot, '%Y-%m') as month, month(slot + interval '5 minutes') <> month(slot) as closes, count(*) as n from observations group by all")
def month_partitions(spark, sf_dir):
    return tm.monthly(tb.observations(spark, sf_dir)).groupBy("month", "closes").agg(F.count("*").alias("n"))


@query(f"{KEYS} select slot, 'https://radar.example/' || strftime(slot, '%Y/%m/%d/%Y%m%d%H%M') || '_composite.tif' as url from slots")
def url_template(spark, sf_dir):
    return _slots(spark, sf_dir).select("slot", ft.radar_url(F.col("slot"), "https://radar.example/%Y/%m/%d/%Y%m%d%H%M_composite.tif").alias("url"))


@query(f"""{KEYS}, known as (select strftime(slot, {FMT}) as timestamp, row_number() over (order by slot) as idx from slots),
wanted as (select unnest(['2024_01_05', '2024_01_07_12', '01_09_0', '2024_01_10_00_00_00', 'nothing']) as wanted)
select wanted, idx, timestamp from wanted join known on contains(timestamp, wanted)
qualify row_number() over (partition by wanted order by case when timestamp = wanted then 0 when starts_with(timestamp, wanted) then 1 else 2 end, idx) = 1""")
def timestamp_lookup(spark, sf_dir):
    known = _slots(spark, sf_dir).select(ft.time_key(F.col("slot")).alias("timestamp"))
    known = numbered(known, ["timestamp"], "idx").withColumn("idx", F.col("idx") + 1)
    wanted = spark.createDataFrame([(x,) for x in ("2024_01_05", "2024_01_07_12", "01_09_0", "2024_01_10_00_00_00", "nothing")], "wanted string")
    return tm.first_match(wanted, known)


FILES = "files as (select strftime(o_orderdate, '%Y-%m') as file, count(*) as n from orders group by 1)"


def _files(spark, sf_dir):
    return tb.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file")).agg(F.count("*").alias("n"))


@query(f"with {FILES} select file, n, case when row_number() over (order by file) <= 40 then 'train' else 'test' end as part from files qualify row_number() over (order by file) <= 41")
def train_test_split(spark, sf_dir):
    return tm.split_by_order(_files(spark, sf_dir), 40)


@query(f"with {FILES}, o as (select file, n, coalesce(sum(n) over (order by file rows between unbounded preceding and 1 preceding), 0)::bigint as start from files), i as (select o_orderkey as index from orders) select index, file, index - start as offset from i join o on index >= start and index < start + n")
def frame_offset_lookup(spark, sf_dir):
    indices = tb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"))
    return tm.located(indices, _files(spark, sf_dir))


@query("select c.c_custkey as idx, c.c_name as timestamp, c.c_acctbal as ax, s.s_acctbal as bx from customer c join supplier s on c.c_custkey = s.s_suppkey")
def positional_zip(spark, sf_dir):
    a = tb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("timestamp"), F.col("c_acctbal").alias("ax"))
    return a.join(tb.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("bx")), "idx")
