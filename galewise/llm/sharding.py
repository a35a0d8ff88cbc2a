"""Shards by extendible hashing.

A document's key is hashed to 60 bits. Shards are buckets of a binary prefix tree over these bits: a bucket over the
byte limit is split on one more bit, and only it. The directory maps each prefix of a common depth to its bucket.
Nothing is split document by document: byte counts of all prefixes come from one aggregate, and a bucket is what is
not over the limit while its parent is. Prefixes that are still over the limit at the directory's depth get a deeper
directory of their own. Rows whose 60 bits are all equal can't be told apart by bits; they overflow to pages.

Scale: the directory grows with the number of shards, not of documents. It is broadcast up to `BROADCAST_ENTRIES`,
else joined by a shuffle. No Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.llm.common import written

#: Bytes of text that a shard holds at most, but for a document that is larger by itself.
LIMIT = 8 << 20
BITS = 60
#: Bits of a directory beyond those that evenly filled shards need; and of each deeper one.
SPARE, DEEPER = 4, 8
MOST_BITS = 26
BROADCAST_ENTRIES = 1 << 16


def key_hash(id_col: Column, text_col: Column) -> Column:
    """The first 60 bits of an MD5 of id and text: null and repeated ids still spread by their texts."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    return F.shiftright("h", BITS - depth)


def _directory(rows: DataFrame, base: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Over rows below prefixes of `base` bits that must be split (all rows, where base is 0): the directory entries (cell, depth,
    bits) for prefixes of `depth` bits, and the cells that are still over the limit."""
    cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d")
    nodes = cells.select("cell", "bytes", "n", level).select("d", F.expr(f"shiftright(cell, {depth} - d)").alias("bits"), "bytes", "n").groupBy("d", "bits").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    nodes, _ = written(nodes.withColumn("over", (F.col("bytes") > limit) & (F.col("n") > 1)), "nodes")
    over = nodes.filter("over")
    parents = over.filter(F.col("d") < depth).select((F.col("d") + 1).alias("d"), F.shiftleft("bits", 1).alias("bits"))
    parents = parents.unionByName(parents.withColumn("bits", F.col("bits") + 1))
    leaves = nodes.filter("not over").join(parents, ["d", "bits"], "left_semi")
    if base == 0:
        leaves = leaves.unionByName(nodes.filter("not over and d = 0"))
    first = F.expr(f"shiftleft(bits, {depth} - d)")
    span = F.expr(f"shiftleft(1L, {depth} - d)")
    entries = leaves.select(F.explode(F.sequence(first, first + span - 1)).alias("cell"), F.col("d").alias("depth"), "bits")
    return entries, over.filter(F.col("d") == depth).select(F.col("bits").alias("cell"))


def _sent(entries: DataFrame) -> DataFrame:
    return F.broadcast(entries) if entries.count() <= BROADCAST_ENTRIES else entries


def sharded_rows(docs: DataFrame, carry: bool, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: id, n_bytes, depth, shard_id, and with carry the struct _doc of its columns."""
    if limit < 1:
        raise ValueError("a shard must hold a byte")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")
    whole = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")] if carry else []), F.col(id_col).alias("id"), key_hash(F.col(id_col), F.col(text_col)).alias("h"), size, F.monotonically_increasing_id().alias("row"))
    whole, _ = written(whole, "keyed")
    rows = whole.select("h", "bytes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = min(MOST_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE)
    base, found, below = 0, whole.withColumn("depth", F.lit(None).cast("int")).withColumn("bits", F.lit(None).cast("long")), rows
    while True:
        entries, deep = _directory(below, base, depth, limit)
        entries, _ = written(entries, "directory")
        found = found.withColumn("cell", _prefix(depth)).join(_sent(entries.select("cell", F.col("depth").alias("d"), F.col("bits").alias("b"))), "cell", "left")
        found = found.withColumn("depth", F.coalesce("depth", F.col("d").cast("int"))).withColumn("bits", F.coalesce("bits", "b")).drop("cell", "d", "b")
        deep, _ = written(deep, "deep")
        if not deep.count():
            page = F.lit(None).cast("long")
            break
        if depth == BITS:
            # equal bits: pages of as many rows as fit, numbered within the partitions that rows were written in, by their offsets
            crowd = rows.withColumn("row", F.lit(0)).join(_sent(deep), F.col("h") == F.col("cell"), "left_semi")
            crowd = whole.join(_sent(deep.withColumnRenamed("cell", "h")), "h", "left_semi").select("h", "row", "bytes", F.shiftright("row", 33).alias("part"))
            parts = crowd.groupBy("h", "part").agg(F.count("*").alias("n"), F.max("bytes").alias("most"))
            parts = parts.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("most", F.max("most").over(W.partitionBy("h")))
            place = F.col("offset") + F.row_number().over(W.partitionBy("h", "part").orderBy("row")) - 1
            paged = crowd.join(parts.drop("n"), ["h", "part"]).select(F.col("row"), F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))).cast("long").alias("page"))
            found = found.join(paged, "row", "left")
            found = found.withColumn("depth", F.coalesce("depth", F.lit(BITS))).withColumn("bits", F.coalesce("bits", "h"))
            page = F.col("page")
            break
        below = below.join(_sent(deep.withColumnRenamed("cell", "_deep")), _prefix(depth) == F.col("_deep"), "left_semi")
        base, depth = depth, min(BITS, depth + DEEPER)
    name = F.concat(F.lit("s"), F.lpad(F.bin("bits"), F.col("depth"), F.lit("0")), F.coalesce(F.concat(F.lit("."), page.cast("string")), F.lit("")))
    return found.select(*(["_doc"] if carry else []), "id", F.col("bytes").alias("n_bytes"), "depth", name.alias("shard_id"))


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8 bytes of the text), depth (hash bits of its shard), shard_id ("s" and these bits;
    overflow pages have a number after a point).

    No shard holds more than limit bytes, but one with a single larger document. A null text has 0 bytes, a null id counts as the
    empty text. Repeated rows have equal hashes and go to one shard, or to its pages beyond the limit. An empty table gives no
    rows; other columns are ignored.
    """
    return sharded_rows(docs, False, id_col, text_col, limit).withColumnRenamed("id", id_col)


def with_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs and the column shard_id (it replaces one of that name); the other columns stay, whatever their names.

    A null text has 0 bytes; a document over the limit has a shard to itself. Repeated rows overflow to pages. An empty table gives none.
    """
    rows = sharded_rows(docs, True, id_col, text_col, limit)
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != "shard_id"], "shard_id")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write docs as Parquet in a folder for each shard. Rows are brought together by shard; a shard is bounded by the limit."""
    with_shards(docs, id_col, text_col, limit).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


#: The same in SQL, bucket by bucket, for rows whose keys differ.
ORACLE = f"""
with keyed as (
  select doc_id, strlen(coalesce(text, ''))::bigint as bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, {BITS // 4}))::bigint as h
  from documents),
over as (
  select d, h >> ({BITS} - d) as bits from keyed, range(0, {BITS + 1}) t(d)
  group by 1, 2 having sum(bytes) > {LIMIT} and count(*) > 1),
deep as (
  select k.doc_id, k.bytes, k.h, coalesce(max(o.d) + 1, 0) as depth
  from keyed k left join over o on (k.h >> ({BITS} - o.d)) = o.bits group by all)
select doc_id, bytes as n_bytes, depth::integer as depth,
       's' || case when depth = 0 then '' else lpad(bin(h >> ({BITS} - depth)), depth::integer, '0') end as shard_id
from deep
"""
