"""Source divergence audit: how far the words of a source are from those of its language and of the other sources.

Each language keeps the terms that stand in at least `MIN_DOCS` of its documents. A source's share of a term, p, and its language's, q,
are smoothed and scaled to whole numbers; f(p, q) = floor((p - q)^2 / (p + q)).

Terms that set a source apart are found by upper bounds: a source's terms are put into buckets by their count there; the largest p and the
smallest q of a bucket bound f of all its terms. Buckets are evaluated best first, in rounds over all sources at once, until the bounds of
all that are left are strictly below the last value that would be listed.

Pairs of sources are computed from postings. A term that a source has not has the same p as all such terms there, p0. So a pair's sum is
that of two sources without a term, and corrections for the terms that one has (from a histogram of its p) and that both have (from
postings joined by term).

Scale: workers count terms by source before they are shuffled by term. No key holds more rows than there are sources of a language in
one block of a term's postings (`BLOCK`), or `BLOCK_ROWS` rows of histograms; both are dealt out over as many salts as their counts ask for. All
arithmetic is exact: shares are divided as decimals, the rest fits 64 bits.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.llm.common import drop_path, sliced, texts_of, written

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Different terms by source that a worker holds before it sends them on.
HELD = 200_000
#: Sources in a block of a term's postings, and rows of histograms in one task's share of a language.
BLOCK, BLOCK_ROWS = 256, 20_000
#: A-Z to a-z; bytes outside [a-z\x80-\xFF] to a space, so that split() gives the terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches):
    """Rows (lang, source, term, n, docs) of a partition; a row with a null term for each source that is there at all."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms) + 1, 50_000):
                own = terms[at : at + 50_000]
                some = pa.array(own, pa.binary()).cast(pa.string())
                counts = [pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())]
                if not at:
                    some, counts = pa.concat_arrays([some, pa.nulls(1, pa.string())]), [pa.concat_arrays([c, pa.array([0], pa.int64())]) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), some, *counts], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in sliced(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, words = len(n), text.translate(TERMS).split()
            n.update(words)
            docs.update(set(words))
            size += len(n) - before
            if size > HELD:
                yield from flushed()
                size = 0
    yield from flushed()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    scaled = (n + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + _div(scaled, (total + 2 * terms).cast("decimal(19,0)"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def counts_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by source, and a row with a null term for each source. Nulls are
    empty."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).alias("text"))
    rows = given.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def statistics(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """groups (lang, source, n_terms, p0: the share of a term that is not there) and postings (lang, source, term, n, p, q, blocks) of
    kept terms that are there; both are written tables."""
    counts, at = written(counts_of(docs, **columns), "counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).filter(F.col("docs") >= min_docs).drop("docs")
    kept, kept_at = written(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    own = counts.join(kept, ["lang", "term"])
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.fillna(0, ["n_terms", "lang_total", "total"]).withColumn("p0", F.when(F.col("n_terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"))))
    groups, _ = written(groups, "groups")
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    postings = own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "p0", F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"))
    postings, _ = written(postings, "postings")
    for path in (at, kept_at):
        drop_path(docs.sparkSession, path)
    return groups.select("lang", "source", "n_terms", "p0"), postings


def pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms for each two sources of a language, both ways."""
    none = f(F.col("p0"), F.col("o0"))
    # two sources without any term
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    base = _of_lang(groups, others).filter("source < other").select("lang", "source", "other", F.when(F.col("n_terms") > 0, F.col("n_terms") * none).otherwise(F.lit(0)).alias("value"))
    # the terms of one, as if the other had them not
    spread = postings.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    one = _of_lang(spread, others).filter("source <> other").select("lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"), (F.col("m") * (f(F.col("p"), F.col("o0")) - none)).alias("value"))
    # the terms of both
    left = postings.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).select("lang", "term", "block", "source", "p", "p0")
    right = postings.select("lang", "term", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("source").alias("other"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    two = left.join(right, ["lang", "term", "block"]).filter("source < other")
    both = f(F.col("p"), F.col("o")) - f(F.col("p"), F.col("o0")) - f(F.col("p0"), F.col("o")) + none
    sums = base.unionByName(one.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))).unionByName(two.groupBy("lang", "source", "other").agg(F.sum(both).alias("value")))
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    return sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def _of_lang(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with each of the others of their language; a language with many rows is dealt out over salts."""
    salts = rows.groupBy("lang").agg((F.floor(F.count("*") / BLOCK_ROWS) + 1).cast("int").alias("salts"))
    dealt = rows.join(salts, "lang").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.col("salts")).cast("int")).drop("salts")
    spread = others.join(salts, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return dealt.join(spread, ["lang", "salt"]).drop("salt")


def marked_terms(postings: DataFrame, top: int = TOP) -> tuple[DataFrame, int]:
    """(lang, source, item, value) of the `top` terms by f whose share in the source is above their language's, and the number of
    rounds that it took."""
    by = ["lang", "source"]
    bucket = F.when(F.col("n") < 16, F.col("n").cast("int")).otherwise((F.floor(F.log2("n") * 4)).cast("int"))
    rows = postings.select(*by, "term", bucket.alias("bucket"), "p", "q")
    bounds = rows.groupBy(*by, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q")).filter("p > q").select(*by, "bucket", f(F.col("p"), F.col("q")).alias("bound"))
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("bound"), "bucket"))  # buckets of a source: some hundreds at most
    bounds, _ = written(bounds.withColumn("place", order), "bounds")
    spark = postings.sparkSession
    listed = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("value"), "item"))
    best, path, rounds, reach = None, None, 0, 2
    left = bounds
    while not left.isEmpty():
        rounds += 1
        now = left.filter(F.col("place") <= reach).select(*by, "bucket")
        found = rows.join(now, [*by, "bucket"]).filter("p > q").select(*by, F.col("term").alias("item"), f(F.col("p"), F.col("q")).alias("value"))
        every = found if best is None else best.unionByName(found)
        best, new = written(every.withColumn("_at", listed).filter(F.col("_at") <= top).drop("_at"), "best")
        if path:
            drop_path(spark, path)
        path = new
        last = best.groupBy(*by).agg(F.when(F.count("*") == top, F.min("value")).alias("last"))
        left = bounds.filter(F.col("place") > reach).join(last, by, "left").filter("last is null or bound >= last").select(*bounds.columns)
        reach *= 2
    if best is None:
        best = rows.select(*by, F.col("term").alias("item"), F.col("p").alias("value")).limit(0)
    return best, rounds


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part `pair`: every other source of the language, by f summed over all its kept terms; part
    `term`: the `top` terms whose share in the source is above that in the language, by f. Ranks go from 1 in each source and part, by
    value, then by item in UTF-8 order.

    Null texts, languages and sources count as empty strings, which are a language and a source as others. A source without terms has
    its pairs; a language of one source has none, and one that keeps no term gives pairs of value 0. Repeated rows are documents of
    their own; very long texts count whole. An empty table gives none; other columns are ignored.
    """
    groups, postings = statistics(docs, min_docs, text_col=text_col, lang_col=lang_col, source_col=source_col)
    best, _ = marked_terms(postings, top)
    rows = pairs(groups, postings).withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))  # as many rows as a language has sources
    return rows.select("lang", "source", "part", "item", "value", rank.cast("int").alias("rank"))


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in SQL: all kept terms of all sources, all pairs of them.
ORACLE = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select lang, source, term, count(*) as n, count(distinct k) as docs from (select k, lang, source, unnest(w) as term from d) group by all),
kept as (select lang, term, sum(n) as n from t group by all having sum(docs) >= {MIN_DOCS}),
v as (select lang, count(*) as v, sum(n) as total from kept group by all),
g as (select lang, source, coalesce(sum(n) filter (where term in (select term from kept where kept.lang = x.lang)), 0) as total from (select distinct lang, source from d) x left join t using (lang, source) group by all),
gp as (select g.lang, g.source, kept.term, coalesce(t.n, 0) as n, 1 + ({SCALE}::hugeint * (coalesce(t.n, 0) + 2)) // (g.total + 2 * v.v)::hugeint as p,
  1 + ({SCALE}::hugeint * (kept.n + 2)) // (v.total + 2 * v.v)::hugeint as q
  from g join kept using (lang) join v using (lang) left join t on t.lang = g.lang and t.source = g.source and t.term = kept.term),
pairs as (select a.lang, a.source, b.source as item, 0::hugeint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  union all select a.lang, a.source, b.source, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) from gp a join gp b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select lang, source, 'pair' as part, item, sum(value)::bigint as value from pairs group by all
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::bigint from gp where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value, rank::integer as rank from ranked where part = 'pair' or rank <= {TOP}
"""
