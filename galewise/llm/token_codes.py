"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level k holds the k-th chunk of each id that reaches so far, a bitmap
that says which of them go on in level k + 1, and a rank directory over the bitmap (set bits before every
512th), so that any id is found by one rank a level, without decoding what stands around it.

A file is a table of segments, each of whole documents in ascending id order: the range partition it is in,
its first id's place there, the documents' ids and lengths, and the payload:

    b"GDAC" | u32 ids | u32 levels | for each level: u32 codes | codes | and, but for the last level, bitmap | u32 ranks

All numbers are little-endian. Segments are written by Spark's own writer, so that a task which is run again
replaces what it wrote, on any file system. Bounded memory: a segment closes at `SEGMENT_IDS` ids.

Texts are split at white space, which the tokenizer drops and never joins over, so that a word's ids are the
same wherever it stands; each worker keeps the ids of the words it has seen, up to a bound.
A-Z are lower-cased before, as the tokenizer does, but for words with a "<|", where its special tokens may stand, which it
finds in the text as it is. Tokenizers of another make get whole texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from galewise.llm.common import LOWER, new_path, sliced

END_ID = 2
MAGIC = b"GDAC"
RANK_BITS = 512
SEGMENT_IDS = 1 << 20
BATCH_BYTES = 8 << 20
#: Words whose ids a worker keeps; a cache only, results do not depend on it.
CACHED_WORDS = 300_000
SCHEMA = "part int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def encode_ids(ids: np.ndarray) -> bytes:
    """The payload of a segment."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        codes, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        if not more.any():
            levels.append(struct.pack("<I", len(codes)) + codes.tobytes())
            break
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS // 8, dtype=np.uint8)
        padded[: len(bitmap)] = bitmap
        counts = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        levels.append(struct.pack("<I", len(codes)) + codes.tobytes() + padded.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)


class Codes:
    """Reads a payload. Levels are views of it; nothing is decoded before it is asked for."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n, n_levels = struct.unpack_from("<II", payload, 4)
        at, self.levels = 12, []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<I", payload, at)
            codes = np.frombuffer(payload, np.uint8, n, at + 4)
            at += 4 + n
            if k == n_levels - 1:
                self.levels.append((codes, None, None))
                break
            blocks = -(-n // RANK_BITS)
            bitmap = np.frombuffer(payload, np.uint8, blocks * RANK_BITS // 8, at)
            at += len(bitmap)
            self.levels.append((codes, bitmap, np.frombuffer(payload, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for codes, bitmap, ranks in self.levels:
            value |= int(codes[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            before = bitmap[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at places within the segment, each by one rank a level."""
        out = np.zeros(len(places), dtype=np.uint32)
        own, at = np.arange(len(places)), np.asarray(places, dtype=np.int64)
        for k, (codes, bitmap, ranks) in enumerate(self.levels):
            out[own] |= codes[at].astype(np.uint32) << np.uint32(8 * k)
            if bitmap is None or not len(own):
                break
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            own, at = own[more], at[more]
            # bits before each place in its block of the directory
            block = at // RANK_BITS
            bits = np.unpackbits(bitmap.reshape(-1, RANK_BITS // 8)[block], axis=1, bitorder="little")
            at = ranks[block].astype(np.int64) + (bits * (np.arange(RANK_BITS) < (at % RANK_BITS)[:, None])).sum(axis=1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values = None
        for codes, bitmap, _ in reversed(self.levels):
            out = codes.astype(np.uint32)
            if bitmap is not None:
                out[np.unpackbits(bitmap, count=len(codes), bitorder="little").astype(bool)] |= values << np.uint32(8)
            values = out
        return values


#: The normalizer and pre-tokenizer whose ids can be found word by word.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _splits_words(made: dict) -> bool:
    """Whether a tokenizer is of the make that WordIds knows: it drops white space, lower-cases, and its added tokens begin with "<|"."""
    added = all(t["content"].startswith("<|") and not any(t[k] for k in ("lstrip", "rstrip", "normalized", "single_word")) and not re.search(r"\s", t["content"]) for t in made["added_tokens"])
    return added and made["normalizer"] == _NORMALIZER and made["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]} and made["model"].get("end_of_word_suffix") == "</w>"


class WordIds:
    """Ids of texts through a tokenizer that drops white space, with the ids of the words seen so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = _splits_words(json.load(f))
        # the same model for words of letters, which need no normalizer and are cut at spaces alone
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)
        self.uses = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _forget_rare(self) -> None:
        """Keep the words that were used most, half of the bound at most."""
        names, n = list(self.places), len(self.places)
        kept = np.sort(np.argsort(-self.uses[:n], kind="stable")[: CACHED_WORDS // 2])
        kept = kept[self.uses[kept] > 1]
        ids, lengths, uses = self._gathered(kept), self.lengths[kept], self.uses[kept] // 2
        self._forget()
        self._keep([names[i] for i in kept.tolist()], ids, lengths)
        self.uses[: len(kept)] = uses

    def _gathered(self, places: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[places] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(ids), len(self.places)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while first + len(words) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        self.flat[self.used : self.used + n] = ids
        self.lengths[first : first + len(words)] = lengths
        self.starts[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += n
        self.places.update(zip(words, range(first, first + len(words)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Words in lower case that are not known. A letter a-z and the point or comma at the end are two pre-tokens, so that such a
        word's ids are those of what stands before and of the sign."""
        ended, whole = [], set()
        for word in words:
            if word[-1] in b".," and len(word) > 1 and 97 <= word[-2] <= 122:
                ended.append(word)
                whole.add(word[:-1])
                whole.add(word[-1:])
            else:
                whole.add(word)
        self._learn_whole(whole.difference(self.places))
        if ended:
            sign = np.array([self.places[w[-1:]] for w in ended], dtype=np.int64)
            own = np.array([self.places[w[:-1]] for w in ended], dtype=np.int64)
            both = np.stack([own, sign], axis=1).ravel()
            self._keep(ended, self._gathered(both), self.lengths[own] + self.lengths[sign])

    def _learn_whole(self, words: set[bytes]) -> None:
        plain, odd = [], []
        for word in words:
            if word.isalpha():  # letters a-z alone
                plain.append((word, word.decode()))
                continue
            if b"<|" in word:
                odd.append((word, ""))
                continue
            # as the tokenizer's normalizer does: composed, and each character in lower case by itself (a sigma's depends on its place)
            text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
            (plain if text.isalpha() else odd).append((word, text))
        # a word of letters alone is one pre-token, whose last id closes a word: many are told apart in one encoding
        for at in range(0, len(plain), 2_000):
            part = plain[at : at + 2_000]
            ids = np.array(self.letters.encode_batch_fast([" ".join(x[1] for x in part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                self._keep([x[0] for x in part], ids, np.diff(np.concatenate([[0], ends])))
            else:
                odd += part
        if odd:
            each = [x.ids for x in self.tokenizer.encode_batch_fast([x[0].decode("utf-8", "replace") for x in odd], add_special_tokens=False)]
            self._keep([x[0] for x in odd], np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(ids) for ids in each], dtype=np.int64))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts, each text's closed by END_ID, and how many each text has."""
        if not self.by_word:
            each = [[*self.tokenizer.encode(x or "", add_special_tokens=False).ids, END_ID] for x in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(ids) for ids in each], dtype=np.int64)
        if len(self.places) > CACHED_WORDS:
            self._forget_rare()
        words, n_words = split_words(texts)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.places.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        if (new := np.flatnonzero(known < 0)).size:
            self._learn([names[i] for i in new.tolist()])
            known[new] = [self.places[names[i]] for i in new.tolist()]
        places = known[np.asarray(coded.indices)] if len(names) else np.zeros(0, dtype=np.int64)
        self.uses[: len(self.places)] += np.bincount(places, minlength=len(self.places))
        sums = np.concatenate([[0], np.cumsum(self.lengths[places])])
        text_ends = sums[np.cumsum(n_words)]
        counts = np.diff(np.concatenate([[0], text_ends]))
        return np.insert(self._gathered(places), text_ends, END_ID), counts + 1


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words [^\\x20\\x09-\\x0D]+ of all texts as one binary array, and how many each text has. A-Z are lower-cased, but not in words
    with a "<|". No Python object is made for a word."""
    column = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    given = memoryview(data)[offsets[0] : offsets[-1]].tobytes() if data else b""
    raw = given.translate(LOWER)
    offsets = offsets - offsets[0]
    signs = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[signs], [False]])
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(signs))]  # a text's end also ends a word
    cut = edges[inside[edges + 1] & inside[edges]]
    begins[cut] = ends[cut] = True
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) - starts
    places = np.concatenate([[0], np.cumsum(sizes)])
    marked = [m.start() for m in re.finditer(rb"<\|", given)]
    if marked:
        at = np.unique(np.searchsorted(starts, marked, "right") - 1)
        signs = signs.copy()
        for a, size in zip(starts[at].tolist(), sizes[at].tolist(), strict=True):
            signs[a : a + size] = np.frombuffer(given, np.uint8, size, a)
    kept = signs[inside[1:-1]]
    array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(kept)])
    return array, np.diff(np.searchsorted(starts, offsets))


_tokenizers: dict[str, WordIds] = {}


def tokenizer_at(path: str) -> WordIds:
    """This worker's tokenizer, loaded once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Names and texts of batches put together up to BATCH_BYTES: the more texts, the fewer words are looked up twice."""
    names, texts, size = [], [], 0
    for batch in sliced(batches):
        names += batch.column(0).to_pylist()
        texts.append(batch.column(1))
        size += batch.column(1).nbytes
        if size >= BATCH_BYTES:
            yield names, pa.concat_arrays(texts)
            names, texts, size = [], [], 0
    if names:
        yield names, pa.concat_arrays(texts)


def write_codes(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize docs and write the file at `path`, in ascending id order.

    Null ids come first; rows of one id stand in the order of a hash of their texts. A null text is empty: its ids are the end id
    alone. An empty table writes a file without segments. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = tokenizer_at(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            columns = [[part], [done], [len(ids)], [[d for x in held for d in x[0]]], [np.concatenate([x[2] for x in held]).tolist()], [encode_ids(ids)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "part_start", "n_ids", "doc_ids", "lengths", "payload"])

        for names, texts in _joined(batches):
            ids, counts = encode(texts)
            held.append((names, ids, counts))
            size += len(ids)
            if size >= SEGMENT_IDS:
                yield segment()
                done, size, held = done + size, 0, []
        if held:
            yield segment()

    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a file, with `start`: the number of ids before the segment in the whole file."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("size"))  # a row for each partition that was written
    starts = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    return segments.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def documents_of(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from segments of read_codes. Each document's first id and end id are also read by
    rank, and a segment where they differ from the decoded ones is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):  # a segment at a time
            for start, names, lengths, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                codes, ends = Codes(payload), np.cumsum(lengths)
                every, edges = codes.all(), np.concatenate([ends - lengths, ends - 1])
                for k in range(0, len(edges), 4096):
                    if not np.array_equal(codes.take(edges[k : k + 4096]), every[edges[k : k + 4096]]):
                        raise ValueError("the rank directories of a segment lead to other ids than its levels")
                raw = memoryview(every.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("start", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for a table of places in the whole file: each is looked up in its segment by rank, nothing else is decoded.
    Places outside the file are not returned. Positions are dealt to segments by a range of ids that both sides share."""
    span = SEGMENT_IDS
    cover = segments.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_ids") - 1) / span))))
    wanted = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / span))
    met = wanted.join(cover, "cell").filter("position >= start and position < start + n_ids").groupBy("start").agg(F.collect_list("position").alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for start, places, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes = Codes(payload)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(codes.take(np.array(places, dtype=np.int64) - start), pa.int64())], names=["position", "token"])

    return met.join(segments.select("start", "payload"), "start").select("start", "positions", "payload").mapInArrow(run, "position long, token long")


def coded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a file in the shared folder and return its documents as read back: (doc_id, start, n_tokens, ids_crc32).

    A null or empty text has the end id alone, a null id comes first, repeated rows stand one after the other, an empty table gives no
    rows. A text of any length stays in one segment. Other columns are ignored. The file goes with the application's other tables.
    """
    spark = docs.sparkSession
    path = new_path(spark, "codes")
    write_codes(docs, path, tokenizer_path, id_col, text_col)
    return documents_of(read_codes(spark, path))
