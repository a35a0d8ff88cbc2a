"""Statistics of result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from galewise.operators import significance as sg
from galewise.operators import statistics as st
from galewise.plans import report
from galewise.queries.registry import registry, rounded
from galewise.sources import tables as tb

QUERIES, ORACLES, query = registry()
PAIRS = f"""{tb.RUNS},
pairs as (select a.subject_id, a.window_size, a.algorithm as first, b.algorithm as second, a.length as length_1, b.length as length_2,
  a.success as success_1, b.success as success_2 from runs a join runs b on a.subject_id = b.subject_id and a.window_size = b.window_size and a.algorithm < b.algorithm),
deltas as (select *, (length_1 - length_2) / ((length_1 + length_2) / 2 + 1e-10) as delta from pairs)"""
#: Rows of subjects and windows that all five algorithms have.
BLOCKS = f"""{tb.RUNS}, full_keys as (select subject_id, window_size from runs group by all having count(distinct algorithm) = (select count(distinct algorithm) from runs)),
blocks as (select r.* from runs r semi join full_keys f on r.subject_id = f.subject_id and r.window_size = f.window_size),
ranked as (select *, rank() over (partition by subject_id, window_size order by length) + (count(*) over (partition by subject_id, window_size, length) - 1) / 2.0 as rk,
  count(*) over (partition by subject_id, window_size, length) as ties from blocks)"""
KEY = ["subject_id", "window_size"]


@query("""select l_returnflag || '-' || l_linestatus as algorithm, l_linenumber - 1 as window_size, strftime(l_shipdate, '%Y_%m_%d') as timestamp,
  l_returnflag as direction, strftime(l_shipdate, '%Y_%m_%d') || '_' || l_returnflag as subject_id, l_extendedprice as length, true as success
from lineitem where l_extendedprice between 1000 and 50000 and strftime(l_shipdate, '%Y_%m_%d') not in ('1995_01_01')""")
def preprocess_results(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("algorithm"), F.col("l_linenumber").alias("window_size"), F.date_format("l_shipdate", "yyyy_MM_dd").alias("timestamp"), F.col("l_returnflag").alias("direction"), F.col("l_extendedprice").alias("length"))
    return st.preprocessed(rows, 1_000.0, 50_000.0, ["1995_01_01"])


@query("select l_returnflag || '-' || l_linestatus as algorithm, count(*) as n_rows, count(*) filter (where l_extendedprice between 1000 and 50000) as n_kept from lineitem group by 1")
def row_counts(spark, sf_dir):
    return st.row_counts(tb.priced(spark, sf_dir), F.col("length").between(1_000, 50_000))


@query(f"with {tb.PRICED} select algorithm, round(avg(length), 6) as mean, round(quantile_cont(length, 0.5), 6) as median, round(stddev_samp(length), 6) as sd, round(var_samp(length), 2) as variance, count(*) as n, min(length) as least, max(length) as most from priced group by 1")
def descriptive_stats(spark, sf_dir):
    return rounded(st.descriptive(tb.priced(spark, sf_dir)).withColumn("variance", F.round("variance", 2)))


@query(f"with {tb.RUNS} select algorithm, window_size, round(avg(success::integer), 6) as rate from runs group by all")
def success_rates(spark, sf_dir):
    return rounded(st.rates(tb.runs(spark, sf_dir)))


@query(f"with {tb.RUNS}, flagged as (select * from (values ('view'), ('click')) t(algorithm)) select algorithm, window_size, round(avg((length > 40)::integer), 6) as rate from runs semi join flagged using (algorithm) group by all")
def valid_rates(spark, sf_dir):
    flagged = spark.createDataFrame([("view", True), ("click", True), ("error", False)], "algorithm string, plot_pred_valid_rate boolean").filter("plot_pred_valid_rate")
    rows = tb.runs(spark, sf_dir).withColumn("is_pred_path_valid", F.col("length") > 40).join(flagged, "algorithm", "left_semi")
    return rounded(st.rates(rows, "is_pred_path_valid"))


@query(f"with {tb.RUNS}, m as (select algorithm, window_size, avg(success::integer) as rate, avg(length) as mean_length from runs group by all), d as (select *, (rate - lag(rate) over w) / (lag(rate) over w + 1e-10) as d_rate, (mean_length - lag(mean_length) over w) / (lag(mean_length) over w + 1e-10) as d_length from m window w as (partition by algorithm order by window_size)) select algorithm, window_size, round(rate, 6) as rate, round(mean_length, 6) as mean_length, round(d_rate, 6) as d_rate, round(d_length, 6) as d_length, round(case when abs(d_length) > 1e-10 then d_rate / d_length end, 4) as ratio from d")
def window_deltas(spark, sf_dir):
    return rounded(st.window_changes(tb.runs(spark, sf_dir)).withColumn("ratio", F.round("ratio", 4)))


@query(f"with {tb.RUNS}, m as (select algorithm, window_size, avg(success::integer) as rate, avg(length) as mean_length from runs group by all), d as (select *, (rate - lag(rate) over w) / (lag(rate) over w + 1e-10) as d_rate, (mean_length - lag(mean_length) over w) / (lag(mean_length) over w + 1e-10) as d_length from m window w as (partition by algorithm order by window_size)), r as (select *, case when abs(d_length) > 1e-10 then d_rate / d_length end as ratio from d) select algorithm, window_size, round(ratio, 4) as ratio from r qualify row_number() over (partition by algorithm order by ratio desc nulls last, window_size) = 1")
def eta_optimal(spark, sf_dir):
    return rounded(st.best_windows(tb.runs(spark, sf_dir)).select("algorithm", "window_size", "ratio"), 4)


@query(f"with {tb.RUNS} select algorithm, subject_id, window_size, round(length - avg(length) over (partition by algorithm, window_size), 6) as residual from runs")
def window_residuals(spark, sf_dir):
    return rounded(st.residuals(tb.runs(spark, sf_dir)).select("algorithm", "subject_id", "window_size", "residual"))


@query(f"with {PAIRS} select first, second, subject_id, window_size, length_1, length_2, round(delta, 6) as delta from deltas")
def pairwise_delta(spark, sf_dir):
    return st.deltas(tb.runs(spark, sf_dir)).select("first", "second", "subject_id", "window_size", "length_1", "length_2", F.round("delta", 6).alias("delta"))


@query(f"with {PAIRS} select first, second, coalesce(avg((round(delta, 1) = 0)::integer), 0) as zero_share from deltas group by all")
def zero_inflation(spark, sf_dir):
    return st.zero_inflation(st.deltas(tb.runs(spark, sf_dir)).withColumn("delta", F.round("delta", 1)))


@query(f"with {PAIRS} select first, second, round(avg(delta), 6) as mean, round(quantile_cont(delta, 0.5), 6) as median, round(stddev_samp(delta), 6) as sd, round(var_samp(delta), 6) as variance, count(*) as n, round(min(delta), 6) as least, round(max(delta), 6) as most from deltas group by all")
def degradation(spark, sf_dir):
    return rounded(st.descriptive(st.deltas(tb.runs(spark, sf_dir)), "delta", ("first", "second")))


@query(f"with {PAIRS} select first, second, count(*) as n, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) as t, count(*) - 1 as df, round(avg(delta) / (stddev_samp(delta) + 1e-10), 6) as d, case when abs(avg(delta) / (stddev_samp(delta) + 1e-10)) < 0.2 then 'negligible' when abs(avg(delta) / (stddev_samp(delta) + 1e-10)) < 0.5 then 'small' when abs(avg(delta) / (stddev_samp(delta) + 1e-10)) < 0.8 then 'medium' else 'large' end as effect from deltas group by all")
def paired_t(spark, sf_dir):
    return rounded(st.paired_t(st.deltas(tb.runs(spark, sf_dir))).select("first", "second", "n", "t", "df", "d", "effect"))


@query(f"with {PAIRS}, r as (select first, second, round(delta, 3) as delta, rank() over (partition by first, second order by abs(round(delta, 3))) + (count(*) over (partition by first, second, abs(round(delta, 3))) - 1) / 2.0 as rk, count(*) over (partition by first, second, abs(round(delta, 3))) as ties from deltas where round(delta, 3) <> 0), s as (select first, second, count(*) as n, sum(case when delta > 0 then rk else 0 end) as plus, sum(rk) as tot, sum(ties * ties - 1) as tied from r group by all) select first, second, n, least(plus, tot - plus) as w, round((least(plus, tot - plus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48), 6) as z, round(1 - 4 * least(plus, tot - plus) / (n * (n + 1)), 6) as effect from s")
def wilcoxon(spark, sf_dir):
    return rounded(st.wilcoxon(st.deltas(tb.runs(spark, sf_dir)).withColumn("delta", F.round("delta", 3))))


MW = f"""with {PAIRS}, f as (select first || '~' || second as family, 'a' as side, length_1 as v from pairs union all select first || '~' || second, 'b', length_2 from pairs),
r as (select *, rank() over (partition by family order by v) + (count(*) over (partition by family, v) - 1) / 2.0 as rk, count(*) over (partition by family, v) as ties from f),
s as (select family, count(*) filter (where side = 'a') as n1, count(*) filter (where side = 'b') as n2, sum(case when side = 'a' then rk else 0 end) as r1, sum(ties * ties - 1) as tied from r group by family),
u as (select *, r1 - n1 * (n1 + 1) / 2 as u, (n1 + n2)::double as n from s)
select family, n1, n2, u, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tied / (n * (n - 1)))), 6) as z, round(abs(u - n1 * n2 / 2) / sqrt(n1 * n2 * (n + 1) / 12) / sqrt(n), 6) as effect from u"""


@query(MW)
def mann_whitney(spark, sf_dir):
    p = st.pairs(tb.runs(spark, sf_dir)).withColumn("family", F.concat_ws("~", "first", "second"))
    long = p.select("family", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("length_1").alias("v")), F.struct(F.lit("b").alias("side"), F.col("length_2").alias("v")))).alias("x")).select("family", "x.side", "x.v")
    return rounded(st.mann_whitney(long, ["family"], "side", "v"))


#: In how many choices of signs the ranks to k have a sum.
SIGNS = """with recursive counts(k, c) as (select 0, [1::bigint] union all select k + 1, [coalesce(c[s + 1], 0) + case when s > k then coalesce(c[s - k], 0) else 0 end for s in range(0, len(c) + k + 1)] from counts where k < 50)"""


@query(f"""{SIGNS}, {PAIRS}, f as (select first, second, window_size, subject_id % 10 as part, delta from deltas), r as (select *, rank() over (partition by first, second, window_size, part order by abs(delta)) as rk, count(*) over (partition by first, second, window_size, part, abs(delta)) as ties from f),
s as (select first, second, window_size, part, count(*) as n, sum(case when delta > 0 then rk else 0 end) as plus, max(ties) as ties, min(abs(delta)) as least from r group by all having n <= 50 and max(ties) = 1 and least > 0)
select first, second, window_size, part, n, least(plus, n * (n + 1) // 2 - plus)::double as w, round(least(1, 2 * list_sum(c[1:least(plus, n * (n + 1) // 2 - plus)::int + 1]) / list_sum(c)), 9) as p_exact from s join counts on k = n""")
def wilcoxon_exact(spark, sf_dir):
    """Exact p of signed ranks, for families of up to 50 differences that aren't tied."""
    d = st.deltas(tb.runs(spark, sf_dir)).withColumn("part", F.col("subject_id") % 10)
    by = ["first", "second", "window_size", "part"]
    return rounded(sg.exact_signed_p(st.wilcoxon(d, tuple(by), ties=True)).filter("p_exact is not null").select(*by, "n", "w", "p_exact"), 9)


@query(f"""with recursive {tb.RUNS}, counts(m, n, c) as (select 0, n, [1::bigint] from range(0, 251) t(n)
 union all select m + 1, n, [list_sum([coalesce(case when s - k * (m + 1) >= 0 then c[s - k * (m + 1) + 1] end, 0) - coalesce(case when s - k * (m + 1) - n - m - 1 >= 0 then c[s - k * (m + 1) - n - m] end, 0) for k in range(0, s // (m + 1) + 1)]) for s in range(0, (m + 1) * n + 1)] from counts where m < 8 and n <= 40),
f as (select window_size, subject_id % 40 as part, algorithm, length as v from runs where algorithm in (select distinct algorithm from runs order by 1 limit 2)),
r as (select *, rank() over (partition by window_size, part order by v) as rk, count(*) over (partition by window_size, part, v) as ties, min(algorithm) over (partition by window_size, part) as low from f),
s as (select window_size, part, count(*) filter (where algorithm = low) as n1, count(*) filter (where algorithm <> low) as n2, sum(rk) filter (where algorithm = low) as r1, max(ties) as ties from r group by all having least(n1, n2) between 1 and 8 and greatest(n1, n2) <= 40 and ties = 1),
u as (select *, r1 - n1 * (n1 + 1) // 2 as u from s)
select window_size, part, n1, n2, u::double as u, round(least(1, 2 * list_sum(c[1:least(u, n1 * n2 - u)::int + 1]) / list_sum(c)), 9) as p_exact from u join counts on m = least(n1, n2) and n = greatest(n1, n2)""")
def mann_whitney_exact(spark, sf_dir):
    """Exact p of rank sums, for two samples one of which has eight values at most, without ties."""
    r = tb.runs(spark, sf_dir)
    two = r.select("algorithm").distinct().orderBy("algorithm").limit(2)
    rows = r.join(F.broadcast(two), "algorithm").withColumn("part", F.col("subject_id") % 40)
    found = sg.exact_rank_sum_p(st.mann_whitney(rows, ["window_size", "part"], "algorithm", "length", ties=True))
    return rounded(found.filter("p_exact is not null and greatest(n1, n2) <= 40").select("window_size", "part", "n1", "n2", "u", "p_exact"), 9)


@query(f"with {BLOCKS}, p as (select algorithm, sum(rk) as r, count(*) as n, sum(ties * ties - 1) as tied from ranked group by 1), t as (select count(*) as k, max(n)::double as n, sum(r * r) as rr, sum(tied) as tied from p), c as (select *, (12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1))) as chi2 from t) select n::bigint as n, k, round(chi2, 6) as chi2, round(chi2 / (n * (k - 1)), 6) as kendall_w from c")
def friedman(spark, sf_dir):
    return rounded(st.friedman(tb.runs(spark, sf_dir), KEY))


@query(f"with {BLOCKS}, p as (select algorithm, sum(rk) as r, count(*) as n, sum(rk * rk) as a from ranked group by 1), t as (select count(*) as k, sum(a) as a, sum(r * r) as rr, max(n) as n from p) select x.algorithm as first, y.algorithm as second, round(abs(x.r - y.r) / sqrt(2 * (t.n * t.a - t.rr) / ((t.n - 1) * (t.k - 1))), 6) as t, ((t.n - 1) * (t.k - 1))::double as df from p x join p y on x.algorithm < y.algorithm cross join t")
def conover(spark, sf_dir):
    return rounded(st.conover(tb.runs(spark, sf_dir), KEY))


@query(f"with {tb.RUNS}, r as (select algorithm, rank() over (partition by algorithm order by window_size) + (count(*) over (partition by algorithm, window_size) - 1) / 2.0 as rx, rank() over (partition by algorithm order by length) + (count(*) over (partition by algorithm, length) - 1) / 2.0 as ry from runs) select algorithm, round(corr(rx, ry), 6) as rho, count(*) as n from r group by 1")
def spearman(spark, sf_dir):
    return rounded(st.spearman(tb.runs(spark, sf_dir), ["algorithm"], "window_size", "length"))


@query(f"with {PAIRS}, s as (select first, second, count(*) filter (where success_1 and not success_2) as b, count(*) filter (where not success_1 and success_2) as c from pairs group by all) select first, second, b, c, round(case when b + c = 0 then 0 else (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c) end, 6) as statistic from s")
def mcnemar(spark, sf_dir):
    return rounded(st.mcnemar(tb.runs(spark, sf_dir)))


@query(f"with {tb.PRICED}, m as (select algorithm, quantile_cont(length, 0.5) as md from priced group by 1), z as (select p.algorithm, abs(length - md) as z from priced p join m using (algorithm)), p as (select algorithm, count(*) as n, sum(z) as s, sum(z * z) as ss from z group by 1), t as (select count(*) as k, sum(n) as n, sum(s) as s, sum(s * s / n) as b, sum(ss) as ss from p) select k, n::bigint as n, round((n - k) / (k - 1) * (b - s * s / n) / (ss - b), 5) as statistic from t")
def levene(spark, sf_dir):
    return rounded(st.levene(tb.priced(spark, sf_dir), "algorithm", "length"), 5)


@query(f"with {BLOCKS}, x as (select *, avg(length) over () as g, avg(length) over (partition by algorithm) as c, avg(length) over (partition by subject_id, window_size) as s from blocks), t as (select count(distinct algorithm) as k, count(*) / count(distinct algorithm) as n, sum((length - g) ** 2) as tot, sum((c - g) ** 2) as b, sum((s - g) ** 2) as u from x) select k, n::double as n, round(b / (k - 1) / ((tot - b - u) / ((k - 1) * (n - 1))), 5) as f, round(b / tot, 6) as eta2 from t")
def rm_anova(spark, sf_dir):
    return rounded(st.rm_anova(tb.runs(spark, sf_dir), KEY).withColumn("f", F.round("f", 5)))


@query(f"with {tb.RUNS}, s as (select window_size, count(*) as n from runs group by 1), c as (select a.window_size as lo, b.window_size as hi, sum(case when b.length > a.length then 1.0 when b.length = a.length then 0.5 else 0 end) as j from runs a join runs b on a.window_size < b.window_size group by all), t as (select (select sum(j) from c) as j, sum(n)::double as n, sum(n * n) as n2, sum(n * n * (2 * n + 3)) as n3 from s) select j::double as j, (n * n - n2) / 4 as mean, (n * n * (2 * n + 3) - n3) / 72 as variance, round((j - (n * n - n2) / 4) / sqrt((n * n * (2 * n + 3) - n3) / 72), 6) as z from t")
def jonckheere(spark, sf_dir):
    return st.jonckheere(tb.runs(spark, sf_dir), "window_size", "length").withColumn("z", F.round("z", 6))


FAMILY = f"{PAIRS}, tests as (select first, second, round(count(*) filter (where success_1) / (count(*) * 20.0) + 0.0005 * count(*) / 761.0, 9) as p from pairs group by all)"


def _tests(spark, sf_dir):
    p = st.pairs(tb.runs(spark, sf_dir), ("success",))
    return p.groupBy("first", "second").agg(F.round(F.count_if("success_1") / (F.count("*") * 20.0) + 0.0005 * F.count("*") / 761.0, 9).alias("p"))


@query(f"with {FAMILY}, h as (select *, least(1.0, p * (count(*) over () - row_number() over (order by p, first, second) + 1)) as raw from tests) select first, second, p, round(raw, 9) as p_raw, round(max(raw) over (order by p, first, second rows unbounded preceding), 9) as p_holm from h")
def holm(spark, sf_dir):
    rows = st.holm(_tests(spark, sf_dir), [], order=("first", "second"), monotone=False).withColumnRenamed("p_holm", "p_raw")
    return rounded(st.holm(rows, [], order=("first", "second")).select("first", "second", "p", "p_raw", "p_holm"), 9)


@query(f"with {FAMILY}, h as (select *, count(*) over () as m, row_number() over (order by p, first, second) as i from tests) select first, second, p, round(least(1.0, min(p * m / i) over (order by i desc rows unbounded preceding)), 9) as p_bh from h")
def bh_fdr(spark, sf_dir):
    return rounded(st.benjamini_hochberg(_tests(spark, sf_dir), [], order=("first", "second")), 9)


@query(f"with {BLOCKS} select algorithm, subject_id, window_size, length from blocks")
def balanced_subset(spark, sf_dir):
    return st.complete_blocks(tb.runs(spark, sf_dir), KEY).select("algorithm", "subject_id", "window_size", "length")


@query(f"with {PAIRS} select subject_id, window_size, length_1 as length_view, length_2 as length_signup from (select a.subject_id, a.window_size, a.length as length_1, b.length as length_2 from runs a join runs b using (subject_id, window_size) where a.algorithm = 'view' and b.algorithm = 'signup')")
def merge_for_comparison(spark, sf_dir):
    rows = tb.runs(spark, sf_dir)
    side = lambda a: rows.filter(F.col("algorithm") == a).select("subject_id", "window_size", F.col("length").alias(f"length_{a}"))
    return side("view").join(side("signup"), KEY)


@query(f"with {tb.RUNS}, a as (select distinct algorithm from runs) select x.algorithm as first, y.algorithm as second from a x join a y on x.algorithm < y.algorithm")
def algorithm_pairs(spark, sf_dir):
    names = tb.runs(spark, sf_dir).select("algorithm").distinct()
    return names.select(F.col("algorithm").alias("first")).join(names.select(F.col("algorithm").alias("second")), F.col("first") < F.col("second"))


@query(f"with {tb.RUNS}, c as (select subject_id from runs where algorithm = 'view' intersect select subject_id from runs where algorithm = 'click' intersect select subject_id from runs where algorithm = 'error') select subject_id from c")
def common_subjects(spark, sf_dir):
    rows = tb.runs(spark, sf_dir)
    of = lambda a: rows.filter(F.col("algorithm") == a).select("subject_id")
    return of("view").intersect(of("click")).intersect(of("error"))


@query(f"with {tb.PRICED}, q as (select algorithm, window_size, quantile_cont(length, 0.25) as q1, quantile_cont(length, 0.5) as q2, quantile_cont(length, 0.75) as q3 from priced group by all) select algorithm, window_size, round(q1, 6) as q1, round(q2, 6) as q2, round(q3, 6) as q3, min(case when length between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then length end) as low, max(case when length between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then length end) as high, count(*) filter (where not length between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers from priced join q using (algorithm, window_size) group by algorithm, window_size, q1, q2, q3")
def boxplot_stats(spark, sf_dir):
    return rounded(st.boxplot(tb.priced(spark, sf_dir)))


@query()
def bootstrap_optimal(spark, sf_dir):
    """The first window whose bootstrap range overlaps the best one's; resampling has no SQL twin."""
    return st.first_overlapping(st.bootstrap_medians(tb.runs(spark, sf_dir), ["algorithm", "window_size"]))


@query()
def confidence_intervals(spark, sf_dir):
    return rounded(sg.intervals(st.descriptive(tb.priced(spark, sf_dir))).select("algorithm", "mean", "ci_low", "ci_high"))


@query()
def paired_t_p(spark, sf_dir):
    return rounded(sg.with_p(st.paired_t(st.deltas(tb.runs(spark, sf_dir))), "t", "t", "df").select("first", "second", "t", "p"))


@query()
def friedman_p(spark, sf_dir):
    return rounded(sg.with_p(st.friedman(tb.runs(spark, sf_dir), KEY).withColumn("df", F.col("k") - 1), "chi2", "chi2", "df"))


@query()
def mcnemar_p(spark, sf_dir):
    return rounded(sg.with_p(st.mcnemar(tb.runs(spark, sf_dir)).withColumn("df", F.lit(1)), "chi2", "statistic", "df"))


@query()
def normality_by_window(spark, sf_dir):
    return rounded(sg.normality(st.residuals(tb.runs(spark, sf_dir)), ["algorithm", "window_size"], "residual"))


#: What the query's report is asked for.
PLAN = report.Plan(
    masking=(("click", "error"), ("purchase", "view")),
    groups=(("three at 3", ("click", "error", "view"), 3), ("four", ("click", "error", "purchase", "signup"), -1)),
    optimisation=(("click", "purchase", 2), ("error", "signup", -1), ("click", "none", -1)),
    degradation=(("signup", "view"), ("click", "view")),
    flagged=("view", "signup"),
)


@query(f"""with {PAIRS}, asked(phase, comparison, a, b, ws, place, flagged) as (values (2, 'click vs error', 'click', 'error', -1, 0, false), (2, 'purchase vs view', 'purchase', 'view', -1, 1, true), (5, 'click vs purchase (ws=2)', 'click', 'purchase', 2, 2, false), (5, 'error vs signup', 'error', 'signup', -1, 3, true), (6, 'signup vs view', 'signup', 'view', -1, 4, true), (6, 'click vs view', 'click', 'view', -1, 5, true)),
r as (select asked.*, d.* from asked join deltas d on d.first = a and d.second = b and (ws < 0 or ws = window_size)),
mc as (select phase, comparison, 'mcnemar' as test, count(*) filter (where success_1 and not success_2) as b, count(*) filter (where not success_1 and success_2) as c from r where phase in (2, 5) group by all
  union all select phase, comparison, 'mcnemar_validity', count(*) filter (where length_1 > 45 and not length_2 > 45), count(*) filter (where not length_1 > 45 and length_2 > 45) from r where phase in (2, 5) and flagged group by all),
g(factor, algorithm, ws) as (values ('three at 3', 'click', 3), ('three at 3', 'error', 3), ('three at 3', 'view', 3), ('four', 'click', -1), ('four', 'error', -1), ('four', 'purchase', -1), ('four', 'signup', -1)),
x as (select factor, runs.* from g join runs on g.algorithm = runs.algorithm and (ws < 0 or ws = window_size)),
full_x as (select x.* from x join (select factor, subject_id, window_size from x group by all having count(*) = case factor when 'four' then 4 else 3 end) y using (factor, subject_id, window_size)),
rk as (select *, rank() over w + (count(*) over (partition by factor, subject_id, window_size, length) - 1) / 2.0 as rk, count(*) over (partition by factor, subject_id, window_size, length) as ties from full_x window w as (partition by factor, subject_id, window_size order by length)),
fr as (select factor, count(*) as k, max(n)::double as n, sum(rr * rr) as rr, sum(tied) as tied from (select factor, algorithm, sum(rk) as rr, count(*) as n, sum(ties * ties - 1) as tied from rk group by all) group by all),
sp as (select phase, comparison, rank() over a + (count(*) over (partition by comparison, length_1) - 1) / 2.0 as rx, rank() over b + (count(*) over (partition by comparison, delta) - 1) / 2.0 as ry from r where phase = 5 window a as (partition by comparison order by length_1), b as (partition by comparison order by delta)),
mw as (select *, rank() over (order by delta) + (count(*) over (partition by delta) - 1) / 2.0 as rk from r where phase = 2)
select phase::integer as phase, test, comparison, round(case when b + c = 0 then 0 else (abs(b - c) - 1) ** 2 / (b + c) end, 6) as statistic, (b + c)::bigint as n from mc
union all select 3, 'friedman', factor, round((12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - tied / (n * k * (k * k - 1))), 6), n::bigint from fr
union all select phase, 'spearman', comparison, round(corr(rx, ry), 6), count(*) from sp group by all
union all select phase, 'degradation', comparison, round(median(delta), 6), count(*) from r where phase = 6 group by all
union all select 2, 'masking_interaction', 'first pair vs second pair', round(sum(rk) filter (where place = 0) - count(*) filter (where place = 0) * (count(*) filter (where place = 0) + 1) / 2, 6), count(*) from mw""")
def planned_report(spark, sf_dir):
    """Statistics and counts of the families that a report is asked for; those whose test phase 1 chooses are left to tests."""
    runs = tb.runs(spark, sf_dir).withColumn("is_pred_path_valid", F.col("length") > 45)
    rows = report.planned_results(runs, PLAN).filter(F.col("test").isin("mcnemar", "mcnemar_validity", "friedman", "spearman", "degradation", "masking_interaction"))
    return rounded(rows.select("phase", "test", "comparison", "statistic", "n"))
