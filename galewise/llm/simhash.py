"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits; two documents link at `max_bits` differing bits or fewer. Cut into
`max_bits // 2 + 1` segments, two linked fingerprints differ by at most one bit in some segment. So each
segment is indexed under its one-wildcard variants (the segment with one bit deleted, and which bit),
variants meet by equality, and each meeting is verified on all 64 bits.

Scale: only distinct fingerprints are indexed, so copies cost nothing. A task reads its keys in sorted
order, joins what it verifies in a union-find of its own and emits a forest, never all pairs. Variants that
hold more than `block` fingerprints are cut into blocks, and block pairs are dealt out, so that no task ever
needs a whole hot variant. Components are found by alternating large-star and small-star rounds over tables
in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise.llm.common import LOWER, fresh, mapped_with, per_batch, texts_of, written
from galewise.operators.graphs import components

BITS = 64
SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Lanes of the deduplicating stage besides fp, differing bits of fp up to which they may link, and the share of all their bits that may
#: differ: texts of a similarity of 0.8 differ in 0.15 of them, of 0.7 in 0.19, of 0.6 in 0.23.
LANES, LANE_REACH, MOST_DIFFERENT = 5, 17, 0.18
#: Fingerprints of one variant that a task compares at once.
BLOCK = 4096
#: Groups of over this many are searched by reach, smaller ones by all their pairs.
CROWD = 24
#: Hot variants are sent to all tasks up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shingle_hashes(text: bytes, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included; of the whole word sequence where it is shorter."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) < words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - words_per_shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)], dtype="<u8")


#: Sets the bits of each byte value, for sums of bits from counts of bytes.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(2048, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 20):  # bounded memory for texts of any length
        counts += np.bincount((hashes[at : at + (1 << 20)].view(np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the same shingles that are independent of the first ones (a splitmix64 finish)."""
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: bytes, words_per_shingle: int = SHINGLE, lanes: int = 1) -> list[int]:
    """Bits set in over half the shingle hashes, and the same for further independent hashes of the shingles; no words give zeros."""
    hashes = shingle_hashes(text, words_per_shingle)
    if not len(hashes):
        return [0] * lanes
    return [_majority(hashes if k == 0 else _remixed(hashes, k)) for k in range(lanes)]


def with_fingerprints(docs: DataFrame, text_col: str = "text", words_per_shingle: int = SHINGLE, lanes: int = 1, name: str = "fp") -> DataFrame:
    """docs and a signed 64-bit column for each lane's fingerprint, `name` and `name`1 and so on; a null text has no words."""
    at, names = docs.columns.index(text_col), [f"{name}{k or ''}" for k in range(lanes)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprints(t, words_per_shingle, lanes) for t in texts_of(batch.column(at))], dtype=np.uint64).reshape(-1, lanes).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(prints[:, k]) for k in range(lanes)]], names=[*batch.schema.names, *names])

    return mapped_with(docs, per_batch(run), [T.StructField(x, T.LongType()) for x in names])


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = max_bits // 2 + 1
    if not 2 <= max_bits < BITS // 2:
        raise ValueError("two differing bits at least: else there is one segment, which a key can't hold")
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


#: A variant's key: which bit is deleted, the lane, and the rest of the segment, in one long.
_KEY = "shiftleft(shiftrightunsigned(v, b + 1), b) | (v & (shiftleft(1L, b) - 1)) | shiftleft(cast(low + b as bigint), 56) | shiftleft(cast(lane as bigint), 48)"


def _segment_values(index: list[str], max_bits: int) -> F.Column:
    """Array of the segments of the columns in index: lane, lowest bit, width and value."""
    return F.array(*[
        F.struct(F.lit(lane).alias("lane"), F.lit(low).alias("low"), F.lit(width).alias("width"), F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << width) - 1)).cast("long").alias("v"))
        for lane, c in enumerate(index) for low, width in segments(max_bits)
    ])


def _variants(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, key) for all one-wildcard variants of rows (keep, lane, low, width, v)."""
    return rows.select(*keep, "lane", "low", "v", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("b")).select(*keep, F.expr(_KEY).alias("key"))


def _hot_variants(prints: DataFrame, max_bits: int, block: int, index: list[str]) -> DataFrame:
    """Variant keys that may hold over `block` fingerprints, with a bound on how many: counted per whole segment value, of
    which a variant joins two, so that only a row for each segment is shuffled, and not one for each variant."""
    values = prints.select(F.explode(_segment_values(index, max_bits)).alias("x")).groupBy("x.lane", "x.low", "x.width", "x.v").agg(F.count("*").alias("n"))
    spread = _variants(values.filter(F.col("n") > block // 2), "n")
    return spread.groupBy("key").agg((F.sum("n") + block // 2).alias("n")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))


class _Forest:
    """Union-find over fingerprints; keeps the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((max(a, b), min(a, b)))


def _verified(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, max_bits: int, forest: _Forest, lanes: np.ndarray | None = None, most: int = 0) -> None:
    """Link verified fingerprints with equal keys; rows come sorted by key. Rows of a block pair have side 1 or 2 and are compared
    across sides alone; other rows have side 0 and are compared with each other. With lanes (a row each) at most `most` of their bits
    may differ as well."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    for start, size in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist(), strict=True):
        own = slice(start, start + size)
        _verified_crowd(side[own], fps[own], max_bits, forest, None if lanes is None else lanes[own], most)
    after = (np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1) * np.repeat(sizes <= CROWD, sizes)
    same, step = np.flatnonzero(after), 1
    while len(same):
        close = np.bitwise_count((fps[same] ^ fps[same + step]).view(np.uint64)) <= max_bits
        close &= (side[same] != side[same + step]) | (side[same] == 0)
        met = same[close]
        if lanes is not None:
            met = met[_differing(lanes[met], lanes[met + step]) <= most]
        for a, b in zip(fps[met].tolist(), fps[met + step].tolist(), strict=True):
            forest.join(a, b)
        step += 1
        same = same[after[same] >= step]


def _verified_crowd(side: np.ndarray, fps: np.ndarray, max_bits: int, forest: _Forest, lanes: np.ndarray | None = None, most: int = 0) -> None:
    """The same for one large group: each fingerprint that is reached is compared with those not yet reached, so that a group in
    which all link takes one comparison a member."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= max_bits
            close &= (side[left] != side[at]) | (side[at] == 0)
            if lanes is not None:
                met = np.flatnonzero(close)
                close[met] = _differing(lanes[left[met]], lanes[at]) <= most
            for x in left[close].tolist():
                forest.join(int(fps[at]), int(fps[x]))
                queue.append(x)
            left = left[~close]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of lanes."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, index: list[str] | None = None, reach: int | None = None, most: int | None = None) -> DataFrame:
    """(hi, lo): a forest of links between distinct fingerprints `fp` that spans each component of the verified links which its
    task has seen. No link that could join two components is lost.

    index: the columns whose segment variants bring fingerprints together (fp itself). reach: differing bits of fp up to which
    such a meeting is a link (max_bits). most: differing bits of all index columns up to which it is one; the columns then go with
    each variant, so that a pair is tested whole before it joins two trees."""
    index, reach = index or ["fp"], max_bits if reach is None else reach
    spark = prints.sparkSession
    # dealt out anew: a few small partitions would each be exploded into all variants of very many fingerprints
    prints = prints.repartition(max(prints.sparkSession.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "fp")
    carried = [] if most is None else index
    rows = _variants(prints.select("fp", *carried, F.explode(_segment_values(index, max_bits)).alias("x")).select("fp", *carried, "x.*"), "fp", *carried)
    hot, _ = written(_hot_variants(prints, max_bits, block, index), "hot-variants")
    n_hot = hot.count()
    none = F.lit(0).cast("int")
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        pairs = F.when(F.col("blocks") == 1, F.array(F.struct(none.alias("i"), none.alias("j"), none.alias("side")))).otherwise(
            F.transform(F.sequence(none, F.col("blocks") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), F.when(mine == o, 0).when(mine < o, 1).otherwise(2).cast("int").alias("side")))
        )
        # the pair (i, i) compares a block with itself; (i, j) compares two blocks with each other alone
        rows = rows.select("fp", "key", *carried, F.explode(pairs).alias("p")).select("fp", "key", "p.i", "p.j", "p.side", *carried)
    else:
        rows = rows.select("fp", "key", none.alias("i"), none.alias("j"), none.alias("side"), *carried)
    n_carried = len(carried)
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept, bound = _Forest(), None, most or 0
        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(5)]
            if n_carried:
                now.append(np.stack([np.asarray(batch.column(5 + k)) for k in range(n_carried)], axis=1))
            if kept is not None:
                now = [np.concatenate([a, b]) for a, b in zip(kept, now, strict=True)]
            fps, key, i, j, side, *lanes = now
            if not len(key):
                continue
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
            end = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if end:
                _verified(group[:end], side[:end], fps[:end], reach, forest, *[x[:end] for x in lanes], most=bound)
            kept = [x[end:] for x in now]
        if kept is not None and len(kept[0]):
            _verified(np.zeros(len(kept[0]), dtype=np.int64), kept[4], kept[0], reach, forest, *kept[5:], most=bound)
        found = forest.links
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["hi", "lo"])

    return dealt.mapInArrow(run, "hi long, lo long").distinct()


def _components(found: DataFrame) -> DataFrame:
    return components(found.select(F.col("hi").alias("a"), F.col("lo").alias("b")))


def fingerprint_roots(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, root) for the distinct fingerprints `fp`: the smallest fingerprint of its component."""
    own = prints.select("fp").distinct()
    nodes = _components(links(own, max_bits, block))
    return own.join(nodes, own.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def lane_roots(prints: DataFrame, lanes: int, max_bits: int = MAX_BITS, block: int = BLOCK, reach: int = LANE_REACH, most: float = MOST_DIFFERENT) -> DataFrame:
    """(fp, root) for the distinct fingerprints `fp` of rows with further lanes `fp1` and so on.

    The lanes' segment variants bring fingerprints together, which link if fp differs in `reach` bits at most and all lanes' bits
    in a share of `most` at most. The first search tests fp alone and finds which fingerprints meet any other; the second takes these
    few with their lanes, and its forest is built from links which have passed both tests. Of rows with equal fp one stands for all."""
    names = [f"fp{k}" for k in range(1, lanes + 1)]
    own, _ = written(prints.groupBy("fp").agg(F.min(F.struct(*names)).alias("x")).select("fp", "x.*"), "lanes")
    met = links(own, max_bits, block, names, reach).select(F.explode(F.array("hi", "lo")).alias("fp")).distinct()
    some, _ = written(own.join(met, "fp", "left_semi"), "met")
    nodes = _components(links(some, max_bits, block, names, reach, int(most * BITS * lanes)))
    return own.join(nodes, own.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 lowercase hex digits), component_id (the smallest id that is reachable
    over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated rows. A null id is never the
    smallest unless all ids of the component are null. An empty table gives no rows. Columns besides the two named are ignored.
    """
    own, _ = written(with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", words_per_shingle).select("doc_id", "fp"), "fingerprints")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots, _ = written(classes.join(fingerprint_roots(own, max_bits, block), "fp"), "classes")
    named = roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, max_bits: int = MAX_BITS, block: int = BLOCK, lanes: int = LANES) -> DataFrame:
    """docs with one row of each near-duplicate component: that with the smallest id (nulls last; of repeated ids the first as
    written). The columns are those of docs.

    Texts link at about a similarity of 0.8 of their shingles and more, as lane_roots judges it by independent lanes of
    fingerprints. Null and empty texts are copies of each other. Texts of fewer words than a shingle are compared as a whole; very
    long ones are hashed in bounded pieces. An empty table gives none; other columns, whatever their names, come along.
    """
    keep = docs.columns
    fp, row = fresh([*keep, *[f"_fp{k}" for k in range(1, lanes + 1)]], "_fp"), fresh(keep, "_row")
    while any(f"{fp}{k}" in keep for k in range(1, lanes + 1)):
        fp = f"_{fp}"
    marked = with_fingerprints(docs, text_col, words_per_shingle, lanes + 1, fp).withColumn(row, F.monotonically_increasing_id())
    own, _ = written(marked, "fingerprinted")  # written, so that row numbers stay as they are when a task is run again
    prints = own.select(F.col(fp).alias("fp"), *[F.col(f"{fp}{k}").alias(f"fp{k}") for k in range(1, lanes + 1)])
    order = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(row).alias("row"))
    classes = own.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first"))
    roots = lane_roots(prints, lanes, max_bits, block)
    chosen, _ = written(classes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "chosen")
    # one plan for all sizes: texts are shuffled once, never held against a table sent to all tasks
    return own.join(chosen.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in keep])
