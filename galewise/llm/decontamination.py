"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. A shift table over blocks of two words says how far the search may move on when the
text has a block at a window's end; where it may not, the window there is looked up by its hash; what is found is compared with the
windows of the benchmark word by word.

Scale: documents are searched in one pass, however large the benchmark is. Workers have the shift table and the windows' hashes as two
tables of fixed size, `MOST_CELLS` bytes and `MOST_BITS` bits at most, which Spark folds from the benchmark; for a benchmark
beyond them they only spare less. What a worker finds are candidates, (row, place, window), which meet the windows in a join by
hash, where their words are compared. A passage that very many documents hold is dealt out over salts by its count. Documents without a
candidate are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise.llm.common import LOWER_WORDS, drop_path, fresh, sliced, texts_of, written

WINDOW = 10
#: Cells of the shift table and bits of the windows' hashes: eight and sixteen for each window, within these. A bit has `PROBES` places.
FEWEST, MOST_CELLS, MOST_BITS, PROBES = 1 << 16, 1 << 25, 1 << 28, 3
#: Cells of a block in which tables are folded; rows of a window in one salt; salted windows at most.
BLOCK, ROWS_PER_SALT, MOST_SALTED = 1 << 12, 1 << 16, 10_000
#: Windows of the benchmark that a worker holds at once.
HELD = 500_000
_SHIFTS, _HASHES, _LENGTHS = 0, 1, 2


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(LOWER_WORDS).split()


def window_hash(window: bytes) -> int:
    return xxhash.xxh64_intdigest(window)


def _block(words: list[bytes], at: int, length: int) -> int:
    """Hash of the block of two words (one, for windows of one) that ends at a place; lengths have blocks of their own."""
    return crc32(words[at], crc32(words[at - 1], length)) if length > 1 else crc32(words[at], length)


def _jump(length: int) -> int:
    return length - 1 if length > 1 else 1


class WuManber:
    """All places where a window may stand, by tables: cells hold how much less than the greatest jump a block lets the search move on, bits
    the hashes of windows."""

    def __init__(self, cells: bytes, bits: bytes, lengths: list[int]) -> None:
        self.cells, self.bits, self.lengths = cells, bits, lengths

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        """(first word, length, hash, window) of each candidate."""
        cells, bits, mask, most = self.cells, self.bits, len(self.cells) - 1, 8 * len(self.bits) - 1
        n = len(words)
        for length in self.lengths:
            jump, at, two = _jump(length), length - 1, length > 1
            while at < n:
                move = jump - cells[(crc32(words[at], crc32(words[at - 1], length)) if two else crc32(words[at], length)) & mask]
                if move > 0:
                    at += move
                    continue
                window = b" ".join(words[at - length + 1 : at + 1])
                h = window_hash(window)
                if all(bits[p >> 3] >> (p & 7) & 1 for p in _probes(h, most)):
                    yield at - length + 1, length, h, window
                at += 1


def _probes(h: int, mask: int) -> list[int]:
    step = h >> 32 | 1
    return [(h + k * step) & mask for k in range(PROBES)]


def _windows(window: int):
    """A mapInArrow function from (item, text) to (hash, window, item)."""

    def run(batches):
        for batch in sliced(batches):
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                for first in range(0, len(words) - size + 1 if size else 0, 10_000):
                    own = [b" ".join(words[k : k + size]) for k in range(first, min(first + 10_000, len(words) - size + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([_signed(window_hash(w)) for w in own], pa.int64()), pa.array(own, pa.binary()).cast(pa.string()), pa.array([item] * len(own), pa.string())], names=["hash", "window", "item"])

    return run


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _cells(window: int, n_cells: int, n_bits: int):
    """A mapInArrow function from (item, text) to parts of the tables: (table, block, places, values)."""

    def parts(cells: list, values: list, hashes: list):
        at, value = np.array(cells, dtype=np.int64), np.array(values, dtype=np.uint8)
        order = np.lexsort((value, at))
        at, value = at[order], value[order]
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else []  # the greatest value of each cell
        yield from _parts(_SHIFTS, at[last], value[last])
        h = np.array(hashes, dtype=np.uint64)
        step = h >> np.uint64(32) | np.uint64(1)
        at = np.unique(np.concatenate([(h + np.uint64(k) * step) & np.uint64(n_bits - 1) for k in range(PROBES)])).astype(np.int64)
        yield from _parts(_HASHES, at, np.ones(len(at), dtype=np.uint8))

    def run(batches):
        cells, values, hashes, lengths = [], [], [], set()
        for batch in sliced(batches):
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                lengths.add(size)
                for at in range(min(2, size) - 1, len(words)):
                    cells.append(_block(words, at, size) & (n_cells - 1))
                    values.append(_jump(size) - max(0, size - 1 - at))
                    if at >= size - 1:
                        hashes.append(window_hash(b" ".join(words[at - size + 1 : at + 1])))
                    if len(cells) >= HELD:
                        yield from parts(cells, values, hashes)
                        cells, values, hashes = [], [], []
        yield from parts(cells, values, hashes)
        yield from _parts(_LENGTHS, np.array(sorted(lengths), dtype=np.int64), np.ones(len(lengths), dtype=np.uint8))

    return run


_PART = "table int, block long, places binary, values binary"


def _parts(table: int, at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted places and their values, by blocks."""
    blocks, first = np.unique(at // BLOCK, return_index=True)
    edges = [*first.tolist(), len(at)]
    for k in range(0, len(blocks), 1_000):
        own = range(k, min(k + 1_000, len(blocks)))
        columns = [pa.array([table] * len(own), pa.int32()), pa.array(blocks[own.start : own.stop], pa.int64()), *(pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary()) for x in ((at % BLOCK).astype(np.uint16), values))]
        yield pa.RecordBatch.from_arrays(columns, names=["table", "block", "places", "values"])


def _folded(batches):
    """Blocks of a partition, whole: the greatest value of each cell; bits for the hashes."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in sliced(batches):
        for table, block, places, values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = held.setdefault((table, block), np.zeros(BLOCK, dtype=np.uint8))
            at = np.frombuffer(places, dtype=np.uint16)
            own[at] = np.maximum(own[at], np.frombuffer(values, dtype=np.uint8))
    for (table, block), own in held.items():
        whole = np.packbits(own, bitorder="little") if table == _HASHES else own
        yield pa.RecordBatch.from_arrays([pa.array([table], pa.int32()), pa.array([block], pa.int64()), pa.array([b""], pa.binary()), pa.array([whole.tobytes()], pa.binary())], names=["table", "block", "places", "values"])


def matcher(items: DataFrame, window: int = WINDOW) -> WuManber:
    """The tables of a benchmark (item, text). They come to the driver; their size is bounded by MOST_CELLS and MOST_BITS."""
    n = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4  # windows, about
    size = lambda each, most: int(min(most, max(FEWEST, 1 << (each * n).bit_length())))
    n_cells, n_bits = size(8, MOST_CELLS), size(16, MOST_BITS)
    cells, bits, lengths = np.zeros(n_cells, dtype=np.uint8), np.zeros(n_bits // 8, dtype=np.uint8), []
    for row in items.mapInArrow(_cells(window, n_cells, n_bits), _PART).repartition("table", "block").mapInArrow(_folded, _PART).collect():
        own = np.frombuffer(row["values"], dtype=np.uint8)
        if row["table"] == _LENGTHS:
            lengths = np.flatnonzero(own).tolist()
        else:
            table = cells if row["table"] == _SHIFTS else bits
            table[row["block"] * len(own) : (row["block"] + 1) * len(own)] = own
    return WuManber(cells.tobytes(), bits.tobytes(), lengths)


_HITS = "array<struct<at:int,length:int,hash:bigint,window:string>>"


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, window: int, keep: list[str]) -> tuple[DataFrame, list[str], DataFrame]:
    """The columns `keep` of docs, written, with a row number, the number of words and candidates; the names that these have; and the windows of
    the benchmark (hash, window, item)."""
    names: list[str] = []
    for name in ("_row", "_n_words", "_found"):
        names.append(fresh([*docs.columns, *names], name))
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(matcher(items, window))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text"))
    n = len(keep)
    structs = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()), ("window", pa.string())]))

    def run(batches):
        own = sent.value
        for batch in sliced(batches):
            sizes, found = [], []
            for text in texts_of(batch.column(n)):
                words = words_of(text)
                sizes.append(len(words))
                found.append([{"at": a, "length": k, "hash": _signed(h), "window": w.decode()} for a, k, h, w in own.search(words)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes, pa.int64()), pa.array(found, structs)], names=[*batch.schema.names[:n], "_n_words", "_found"])

    schema = T.StructType([*plain.schema.fields[:n], *T.StructType.fromDDL(f"_n_words long, _found {_HITS}").fields])
    out, _ = written(plain.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "searched")
    sent.unpersist()
    return out.toDF(*keep, names[1], names[2], names[0]), names, items.mapInArrow(_windows(window), "hash long, window string, item string").distinct()


def confirmed(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, at, length, item) of candidates (row, at, length, hash, window) whose words are those of a window. found is a written table."""
    counts, path = written(found.groupBy("hash", "window").agg(F.count("*").alias("n")), "candidates")
    held, _ = written(counts.join(windows, ["hash", "window"]), "confirmed")  # equal hashes, then equal words
    drop_path(found.sparkSession, path)
    total = held.agg(F.sum("n")).first()[0] or 0
    salts = (F.floor(F.col("n") / max(ROWS_PER_SALT, total // MOST_SALTED)) + 1).cast("int")
    hot = held.withColumn("salts", salts).filter("salts > 1").groupBy("hash").agg(F.max("salts").alias("salts"))  # MOST_SALTED rows at most: shares of the total
    dealt = found.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = held.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return dealt.join(spread.select("hash", "window", "item", "salt"), ["hash", "window", "salt"]).select("row", "at", "length", "item")


def _candidates(found: DataFrame, names: list[str]) -> DataFrame:
    row, _, hits = names
    return found.filter(F.size(hits) > 0).select(F.col(row).alias("row"), F.explode(hits).alias("x")).select("row", "x.*")


def _ranges(batches):
    """(row, hits) to (row, n_hit, ranges): disjoint ranges of hit words."""
    for batch in sliced(batches):
        n_hit, ranges = [], []
        for hits in batch.column(1):
            own = hits.values
            a = own.field("at").to_numpy().astype(np.int64)
            b = a + own.field("length").to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            last = np.append(first[1:], len(a)) - 1
            n_hit.append(int((b[last] - a[first]).sum()))
            ranges.append([{"start": x, "end": y} for x, y in zip(a[first].tolist(), b[last].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "n_hit", "hit_ranges"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: id, n_words, hit_ranges (word ranges inside occurrences of benchmark windows, end exclusive),
    items (ids as strings, sorted), n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. An empty benchmark or one of null texts hits nothing; short items are a window
    of their own length. Items with equal texts are all reported. Texts of any length are searched whole. A null item id counts as the empty string. Repeated documents
    give repeated rows; columns besides those named are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, names, windows = searched(given, benchmark, "text", item_id_col, item_text_col, window, ["id"])
    row, n_words, hits = names
    met, _ = written(confirmed(_candidates(found, names), windows), "met")
    places = met.groupBy("row").agg(F.collect_list(F.struct("at", "length")).alias("hits")).mapInArrow(_ranges, "row long, n_hit long, hit_ranges array<struct<start:long,end:long>>")
    items = met.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    own = found.select(F.col(row).alias("row"), "id", F.col(n_words).alias("n_words"), (F.size(hits) > 0).alias("some"))
    clean = own.filter("not some").select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<start:long,end:long>>").alias("hit_ranges"), F.array().cast("array<string>").alias("items"))
    rest = own.filter("some").join(places, "row", "left").join(items, "row", "left")
    rest = rest.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hit_ranges", F.array().cast("array<struct<start:long,end:long>>")).alias("hit_ranges"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    joined = F.array_join("items", ",")
    out = clean.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hit_ranges", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, with the same columns, whatever their names.

    Null and empty texts have no words and stay; an empty benchmark takes nothing. Of repeated rows all stay or all go. A very long text
    goes with one hit, as a short one does. An empty table gives none.
    """
    found, names, windows = searched(docs, benchmark, text_col, item_id_col, item_text_col, window, docs.columns)
    row, _, hits = names
    gone = confirmed(_candidates(found, names), windows).select(F.col("row").alias(row)).distinct()
    kept = found.filter(F.size(hits) == 0).unionByName(found.filter(F.size(hits) > 0).join(gone, row, "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same in SQL: all windows of documents joined with those of items.
ORACLE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
items as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select *, least({WINDOW}, len(w)) as n from b where len(w) > 0) x, lateral (select unnest(range(1, len(w) - n + 2)) as i)),
sizes as (select distinct n from items),
places as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from d, sizes, lateral (select unnest(range(1, len(w) - n + 2)) as i) where len(w) >= n),
met as (select p.doc_id, p.i, p.n, x.item_id from places p join items x on p.n = x.n and p.win = x.win),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from met) group by 1),
own as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from met) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join own using (doc_id)
"""
