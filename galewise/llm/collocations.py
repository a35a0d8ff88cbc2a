"""Phrase collocations by hashed pass pruning (PCY, DHP).

Phrases are counted length by length, one pass over the texts each. A pass of length k counts exactly only those phrases of k words whose
two parts of k - 1 words are frequent (Apriori) and whose hash bucket, counted by the pass before, holds enough; while it does so it counts
the phrases of k + 1 words, both parts of which it has let pass, into hash buckets for the next one. Both what is frequent
and which buckets are full is known to the workers as bits: hashes may meet, which lets a phrase too many be counted and never one too
few, and what is counted is counted by its words.

Scale: workers add up phrases, and buckets as blocks of counters that stop at the threshold, before they send them on. Bits are sent to all tasks
and are bounded: there are as many buckets as the number of words asks for, `MOST_BITS` at most, beyond which only fewer phrases are
spared exact counting. Nothing else is broadcast or collected; parts and wholes meet in joins by language and phrase.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.llm.common import drop_path, sliced, texts_of, written

LEAST, LONGEST, TOP = 100, 5, 2_000
NO_LANG = "und"
#: Bits of a bitmap: as many as keep a bucket's mean count at a quarter of the threshold, within these; at most 8 MiB are sent.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Counters of a block, bytes of text that a worker takes at once, and different phrases that it holds before it sends them on.
BLOCK, PORTION, HELD = 1 << 12, 4 << 20, 300_000
#: A-Z to a-z; the signs and line ends that end a piece to a byte which UTF-8 has not.
_CUT = 0xFF
PIECES = bytes(b + 32 if 65 <= b <= 90 else _CUT if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def _hashed(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, seed=13)


def _longer(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with these words."""
    return _mixed(h * _ODD + words)


class Bits:
    """A bitmap over hashes; without bits everything is in it."""

    def __init__(self, bits: np.ndarray | None, size: int = 0) -> None:
        self.bits, self.size = bits, size

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), dtype=bool)
        at = h & np.uint64(self.size - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Counters:
    """Counts of buckets, which stop at `least`, sent on as blocks: (number of the block, places that are not zero, their counts), without
    the places where that is shorter."""

    def __init__(self, size: int, least: int) -> None:
        self.size, self.least = size, least
        self.kind = np.uint8 if least < 256 else np.uint32
        self.counts = np.zeros(size, dtype=self.kind)

    def add(self, h: np.ndarray) -> None:
        at, n = np.unique(h & np.uint64(self.size - 1), return_counts=True)
        at = at.astype(np.int64)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least)

    def rows(self):
        for k in np.flatnonzero(self.counts.reshape(-1, BLOCK).any(axis=1)):
            own = self.counts[k * BLOCK : (k + 1) * BLOCK]
            at = np.flatnonzero(own).astype(np.uint16)
            sparse = len(at) * (2 + own.itemsize) < BLOCK * own.itemsize
            yield int(k), at.tobytes() if sparse else b"", (own[at] if sparse else own).tobytes()


def _stretches(text: bytes):
    """The text with its pieces marked, in stretches of PORTION bytes; they end where a piece does, so that no phrase is cut."""
    text = text.translate(PIECES)
    while len(text) > PORTION:
        at = text.rfind(b"\xff", 0, PORTION)
        at = at if at >= 0 else text.find(b"\xff", PORTION)
        if at < 0:
            break
        yield text[:at]
        text = text[at + 1 :]
    yield text


def _portions(batches):
    """Stretches by language, about PORTION bytes together."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            for part in _stretches(text):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= PORTION:
                    yield held
                    held, size = {}, 0
    if held:
        yield held


def _pass(k: int, parts: Bits, full: Bits, buckets: int, least: int):
    """A mapInArrow function that counts the phrases of k words: rows (lang, phrase, n) and (block, places, counts)."""
    names = ["lang", "phrase", "n", "block", "places", "counts"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def batch(columns) -> pa.RecordBatch:
        size = len(next(c for c in columns if c is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def flushed(held: dict[str, Counter]):
        for lang, own in held.items():
            keys = list(own)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), [own[x] for x in some], None, None, None])
        held.clear()

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0
        counters = _Counters(buckets, least) if buckets else None
        for portion in _portions(batches):
            for lang, texts in portion.items():
                joined = b"\xff".join(texts).replace(b"\xff", b" \xff ")
                words = pa.array(joined.split(), pa.binary()).dictionary_encode()
                known, ids = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
                if not known:
                    continue
                hashes = np.array([_hashed(w) for w in known], dtype=np.uint64)[ids]
                cut = known.index(b"\xff") if b"\xff" in known else -1
                last = len(ids)
                ends = np.flatnonzero(np.append(ids, cut) == cut) if cut >= 0 else np.array([last])
                left = np.append(ends, last)[np.searchsorted(ends, np.arange(last))] - np.arange(last)  # words from here to the piece's end
                h = _mixed(hashes + np.uint64(_hashed(lang.encode() + b"\xff")))
                above = [h]
                for j in range(1, k + (counters is not None)):
                    above.append(_longer(above[-1][: max(0, last - j)], hashes[j:]))
                at = np.flatnonzero(left[: max(0, last - k + 1)] >= k) if last >= k else np.empty(0, dtype=np.int64)
                if k > 1:
                    at = at[parts.holds(above[k - 2][at])]
                    at = at[parts.holds(above[k - 2][at + 1])]
                    at = at[full.holds(above[k - 1][at])]
                if counters is not None and len(at) > 1:
                    on = at[:-1][(at[1:] == at[:-1] + 1)]
                    on = on[left[on] > k]
                    counters.add(above[k][on])
                if not len(at):
                    continue
                codes = ids[at]
                for j in range(1, k):  # phrases as whole numbers, renumbered with each word, so that they stay below 2^63
                    codes = np.unique(codes, return_inverse=True)[1] * np.int64(len(known)) + ids[at + j]
                _, first, n = np.unique(codes, return_index=True, return_counts=True)
                own = held.setdefault(lang, Counter())
                before = len(own)
                for i, m in zip(at[first].tolist(), n.tolist(), strict=True):
                    own[known[ids[i]] if k == 1 else b" ".join([known[x] for x in ids[i : i + k]])] += m
                size += len(own) - before
            if size > HELD:
                yield from flushed(held)
                size = 0
        yield from flushed(held)
        if counters is not None:
            rows = list(counters.rows())
            for at in range(0, len(rows), 500):
                block, places, counts = zip(*rows[at : at + 500], strict=True)
                yield batch([None, None, None, list(block), list(places), list(counts)])

    return run, "lang string, phrase string, n long, block long, places binary, counts binary"


def _summed(size: int, least: int):
    """A mapInArrow function that adds up the blocks of a partition and gives the bits of buckets that reach `least`."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, n = held.setdefault(block, np.zeros(BLOCK, dtype=np.uint32)), np.frombuffer(counts, dtype=kind)
                at = np.frombuffer(places, dtype=np.uint16).astype(np.int64) if places else slice(None)
                own[at] = np.minimum(own[at] + n, least)
        for block, own in held.items():
            if (own >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(own >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return run


def bitmap(blocks: DataFrame, size: int, least: int) -> Bits:
    """The buckets of (block, places, counts) that reach `least`; at most size / 8 bytes come to the driver."""
    bits = np.zeros(size // 8, dtype=np.uint8)
    for row in blocks.repartition("block").mapInArrow(_summed(size, least), "block long, bits binary").collect():
        bits[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(row["bits"], dtype=np.uint8)
    return Bits(bits, size)


def _marks(size: int):
    """A mapInArrow function from (lang, phrase) to the blocks of their hashes."""

    def run(batches):
        counters = _Counters(size, 1)
        for batch in sliced(batches, 20_000):
            phrases = [x.split(" ") for x in batch.column(1).to_pylist()]
            if not phrases:
                continue
            known: dict[str, int] = {}
            words = np.array([[known.setdefault(w, _hashed(w.encode())) if w not in known else known[w] for w in x] for x in phrases], dtype=np.uint64)
            h = _mixed(words[:, 0] + np.array([_hashed(x.encode() + b"\xff") for x in batch.column(0).to_pylist()], dtype=np.uint64))
            for j in range(1, words.shape[1]):
                h = _longer(h, words[:, j])
            counters.add(h)
        rows = list(counters.rows())
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 500], strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "places", "counts"])

    return run


def _bits_for(n: int) -> int:
    return int(min(MOST_BITS, max(FEWEST_BITS, 1 << max(0, int(n) - 1).bit_length())))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of up to `longest` words with at least `least` occurrences, and (lang, n) of all words; both
    written tables."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _bits_for(n_bytes // 5 * 4 // least)  # a word has five bytes or more with its space
    parts = full = Bits(None)
    levels, words = [], None
    for k in range(1, longest + 1):
        sent = spark.sparkContext.broadcast((parts, full))  # two bitmaps of MOST_BITS at most

        def run(batches, k=k, sent=sent, buckets=buckets if k < longest else 0):
            yield from _pass(k, *sent.value, buckets, least)[0](batches)

        rows, path = written(texts.mapInArrow(run, _pass(k, parts, full, 0, least)[1]), f"pass-{k}")
        counts = rows.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            words, _ = written(rows.filter("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        level, _ = written(counts.filter(F.col("n") >= least).withColumn("k", F.lit(k)), f"frequent-{k}")
        levels.append(level)
        found = level.count()
        if k < longest and found:
            full = bitmap(rows.filter("block is not null").select("block", "places", "counts"), buckets, least)
            size = _bits_for(16 * found)
            parts = bitmap(level.select("lang", "phrase").mapInArrow(_marks(size), "block long, places binary, counts binary"), size, 1)
        sent.unpersist()
        drop_path(spark, path)
        if not found:
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "phrase", "k", "n"), words


def _cut(at: Column, to: Column | None = None) -> Column:
    words = F.col("words")
    return F.array_join(F.slice(words, at, F.size(words) - at + 1 if to is None else to), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score), the first `top` of each language by score, then by a, both descending, then by phrase in
    UTF-8 order. a, l and r are the occurrences of the phrase and of its parts at the cut with the lowest score, n all words of the language.

    The score is floor(1000 * a * n / (l * r)), computed exactly. A phrase inside a longer one that stands as often is left out. Null texts
    count as empty, a null language as `und`. Repeated rows count each; very long texts count whole, in portions; pieces of no word give
    nothing, and an empty table no rows. Other columns are ignored.
    """
    if least < 1 or longest < 2:
        raise ValueError("phrases have two words or more, and stand once or more")
    phrases, words = frequent_phrases(docs, least, longest, text_col, lang_col)
    named = phrases.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    inside = F.explode(F.array_distinct(F.array(_cut(F.lit(1), F.col("k") - 1), _cut(F.lit(2)))))
    over = named.filter("k > 2").select("lang", inside.alias("phrase"), "a")
    kept = named.join(over, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _cut(F.lit(1), F.col("cut")).alias("head"), _cut(F.col("cut") + 1).alias("rest"))
    count = lambda name, key: phrases.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    met = cuts.join(count("l", "head"), ["lang", "head"]).join(count("r", "rest"), ["lang", "rest"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), (wide("l") * wide("r")).cast("decimal(38,0)"))
    best = met.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "cut", "l", "r").alias("s")).groupBy("lang", "phrase", "a", "n").agg(F.min("s").alias("s"))
    rows = best.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # each partition gives its first `top` only
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in SQL: all phrases of all texts.
ORACLE = f"""
with d as (select row_number() over () as k, coalesce(lang, '{NO_LANG}') as lang, translate(coalesce(text, ''), '{_AZ}', '{_LOW}') as text from documents),
p as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w from d),
f as (select lang, m, w[i:i + m - 1] as ws, count(*)::hugeint as a
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p, range(1, {LONGEST + 1}) t(m) where len(w) >= m) group by all having count(*) >= {LEAST}),
words as (select lang, sum(len(w))::hugeint as n from p group by all),
longer as (select distinct lang, ws[s:s + m - 2] as ws, a from f, (values (1), (2)) v(s) where m > 2),
c as (select f.* from f anti join longer using (lang, ws, a) where m > 1),
cuts as (select c.lang, c.ws, c.a, k, x.a as l, y.a as r, words.n, (1000 * c.a * words.n) // (x.a * y.a) as score
  from (select *, unnest(range(1, m)) as k from c) c join f x on x.lang = c.lang and x.ws = c.ws[:k] join f y on y.lang = c.lang and y.ws = c.ws[k + 1:] join words on words.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, ws order by score, k) = 1),
ranked as (select *, array_to_string(ws, ' ') as phrase from best)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked qualify rank <= {TOP}
"""
