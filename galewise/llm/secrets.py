"""Secret scans through nested encodings.

A worklist of layers starts with the text itself. Each layer is scanned; then what is encoded in it is unwrapped
into further layers, by every unwrapper on every layer: escapes (of URLs, also `%u003D`; of strings, `\\u`, `\\x`, octal, escaped quotes and
backslashes; all character references), base64 runs (both alphabets, also in lines of any width, quoted or commented ones, and with
something glued to them), UTF-16 and gzip, zlib, bzip2 and xz streams, and deflate without a header where base64 or URL escapes hold
it. A layer that was seen before, by its text and place, is not scanned again, so the worklist ends at a fixpoint.
Escapes of escapes are unwrapped level by level, each a layer, while the levels together are at most `LEVELS` times as long as the
layer that they are in; what is nested deeper is unwrapped to its end in one pass with a stack, so that the time is linear.
What is decoded are bytes, and a layer holds each byte as the character of that code (Latin-1), as all that is looked for is
ASCII: a broken character or a control character hides nothing. Every character of a layer knows the range of the
original text it came from, and findings are reported as ranges of the original.

Scale: one pass without a shuffle. A compressed stream is read whole, all its members one after the other, in pieces of about
`CHUNK` bytes, each a layer of its own, so that a small stream which unfolds to very much isn't held at once. A piece
ends only where no finding and no encoded run can go on (`_BREAK`), and before a stream within the stream, which is opened as it
is read; a stretch without such a place is held until it ends.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewise.llm.common import per_batch, strings_of

KINDS = ("assign", "access", "hex")
#: Characters of a piece of a decompressed stream, and bytes that are fed to a stream at once.
CHUNK, FEED = 1 << 20, 1 << 10
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Levels of escapes, as a multiple of their layer's length, that are layers each.
LEVELS = 4
_ESCAPE = re.compile(r"%(?:([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4}))|\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})|u\{([0-9A-Fa-f]{1,6})\}|([0-3][0-7]{2})|([\"'/\\=:]))|&(?:#[xX]([0-9A-Fa-f]{1,8})|#([0-9]{1,9})|([A-Za-z][A-Za-z0-9]{1,31}));")
#: How escapes begin, how they end, and their greatest length.
_LEADS, _CLOSES, _MOST = frozenset("%\\&"), frozenset("0123456789abcdefABCDEF;}\"'/\\=:"), 34
_LEAD = re.compile(r"[%\\&]")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}){16,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Ends of lines, which may be escaped, with what quotes, comments and string literals put around them.
_EDGE = r"""["',\\]?(?:[\x20\t]+\+)?[\x20\t]*(?:\r?\n|(?:\\r)?\\n)(?:[\x20\t]*(?:[>#*|;"']|(?://|--|[+-])(?=[\x20\t])))*[\x20\t]*"""
_LINE_END = re.compile(_EDGE)
#: Lines of base64, the first of which may begin within a line.
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{4,}}+(?:{_EDGE}[A-Za-z0-9+/_-]++)+={{0,2}}")
#: How gzip, bzip2, xz and zlib streams begin.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: The same within a stream; zlib's two bytes say too little there.
_INNER = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
#: Characters below 256, as bytes are held.
_BYTES = re.compile(r"[\x00-\xff]+")
#: ASCII in UTF-16 of either order, as many as the shortest finding has.
_UTF16 = re.compile(r"(?:[\x09-\x7e]\x00){16,}|(?:\x00[\x09-\x7e]){16,}")
#: Ends where a stream may be cut: after a sign that no finding or encoding has, or after spaces between letters that end no escape.
_BREAK = re.compile(r"[^A-Za-z0-9+/_=:.\-%\\&;#{}\"'\s\0]|(?<=[g-zG-Z])\x20+(?=[A-Za-z0-9])")
_WORDS = ("passw", "secret", "token", "api")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings in one layer: leftmost and non-overlapping per kind."""
    found = []
    folded = text.lower()
    if any(w in folded for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]  # runs are whole: one shorter than 16 holds no longer one
    return sorted(found)


class Layer:
    """A text and, for each of its characters, the range of the original text behind it, neither end of which falls from one to the next; and
    where signs end that fill up its encoding."""

    __slots__ = ("text", "starts", "ends", "filled", "level")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, filled: int = 0) -> None:
        self.text, self.starts, self.ends, self.filled = text, starts, ends, filled
        self.level = False  # whether it is a level of escapes, the next of which comes with it

    def range(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])  # neither falls

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.starts, self.ends


def _unescaped(m: re.Match) -> str | None:
    """What an escape stands for; None if it is no known reference."""
    kind = m.lastindex
    own = m.group(kind)
    if kind == 11:
        return html5.get(own + ";")
    if kind == 8:
        return own
    code = int(own, {7: 8, 10: 10}.get(kind, 16))
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _one_level(layer: Layer) -> Layer | None:
    """The layer with all escapes replaced once; None if there are none."""
    if not _LEAD.search(layer.text):
        return None
    at: list[tuple[int, int, int]] = []

    def put(m: re.Match) -> str:
        new = _unescaped(m)
        if new is None:
            return m.group()
        at.append((m.start(), m.end(), len(new)))
        return new

    text = _ESCAPE.sub(put, layer.text)
    if not at:
        return None
    a, b, size = np.array(at, dtype=np.int64).T
    starts, ends = layer.ranges()
    n = len(starts)
    inner = np.zeros(n + 1, dtype=np.int64)
    inner[a] += 1
    np.subtract.at(inner, b, 1)
    times = 1 - np.cumsum(inner[:-1])
    times[a] = size
    first, last = np.arange(n), np.arange(n)
    last[a] = b - 1
    return Layer(text, starts[np.repeat(first, times)], ends[np.repeat(last, times)])


def _to_the_end(layer: Layer) -> Layer:
    """The layer with all escapes replaced until none is left, those that replaced ones make up included. What has been read is a stack: a
    sign that closes an escape takes it off and puts what it stands for, which may close the one around it."""
    text, out, first, last, leads, at = layer.text, [], [], [], [], 0
    while at < len(text):
        if leads and len(out) - leads[-1] > _MOST:
            leads.clear()
        if not leads:  # nothing is open: on to where the next escape may begin
            m = _LEAD.search(text, at)
            to = m.start() if m else len(text)
            out += text[at:to]
            first += range(at, to)
            last += range(at, to)
            if m is None:
                break
            at = to
        c, a, b = text[at], at, at
        at += 1
        while c is not None:
            out.append(c)
            first.append(a)
            last.append(b)
            m = _ESCAPE.fullmatch("".join(out[leads[-1] :])) if leads and c in _CLOSES and len(out) - leads[-1] <= _MOST else None
            new = _unescaped(m) if m else None
            if new is None:
                if c in _LEADS:
                    leads.append(len(out) - 1)
                break
            open_at = leads.pop()
            a, b = first[open_at], last[-1]
            del out[open_at:], first[open_at:], last[open_at:]
            for x in new[:-1]:  # a few references stand for two signs
                out.append(x)
                first.append(a)
                last.append(b)
            c = new[-1]
    starts, ends = layer.ranges()
    return Layer("".join(out), starts[np.array(first, dtype=np.int64)], ends[np.array(last, dtype=np.int64)])


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The levels of escapes in a layer, one by one; those beyond LEVELS all at once."""
    if layer.level:
        return
    own, spent = _one_level(layer), 0
    while own is not None:
        own.level = True
        spent += len(own.text)
        yield own
        if spent > LEVELS * len(layer.text):
            own = _to_the_end(own)
            own.level = True
            yield own
            return
        own = _one_level(own)


def _utf16(layer: Layer) -> Iterator[Layer]:
    if "\0" not in layer.text:
        return
    starts, ends = layer.ranges()
    for m in _UTF16.finditer(layer.text):
        a, low = m.start(), layer.text[m.start()] == "\0"
        yield Layer(m.group()[low::2], starts[a : m.end() : 2], ends[a + 1 : m.end() : 2])


def _decoder(head: bytes):
    """What opens a stream of this beginning."""
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


class _Source:
    """Bytes that come part by part, and may be given back."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.held, self.broken = parts, b"", False

    def read(self) -> bytes:
        """The next part; none at the end."""
        if self.held:
            own, self.held = self.held, b""
            return own
        return next(self.parts, b"")

    def head(self, n: int) -> bytes:
        while len(self.held) < n and (part := next(self.parts, b"")):
            self.held += part
        return self.held[:n]

    def back(self, raw: bytes) -> None:
        self.held = raw + self.held


def _fed(raw: bytes, at: int = 0) -> Iterator[bytes]:
    for k in range(at, len(raw), FEED):
        yield raw[k : k + FEED]


def _opened(source: _Source) -> Iterator[bytes]:
    """The content of all members of the compressed stream at which the source stands, part by part. A broken stream gives what comes
    before the break; one that gives nothing is given back."""
    while (own := _decoder(source.head(6))) is not None:
        eaten: list[bytes] | None = []
        while not own.eof and (fed := source.read()):
            if eaten is not None:
                eaten.append(fed)
            while not own.eof:
                try:
                    out = own.decompress(fed, CHUNK)
                except (zlib.error, OSError, EOFError, lzma.LZMAError):
                    source.broken = True
                    source.back(b"".join(eaten or ()))
                    return
                if out:
                    eaten = None
                    yield out
                fed = getattr(own, "unconsumed_tail", b"")
                if len(out) < CHUNK and not fed:
                    break
        if not own.eof:
            source.broken = True
            source.back(b"".join(eaten or ()))
            return
        source.back(own.unused_data)
        while source.head(1) == b"\0":  # padding between members
            source.held = source.held.lstrip(b"\0")


def _nested(source: _Source, above: frozenset[bytes]) -> Iterator[str] | None:
    """The pieces of the stream at which the source stands; None if there is none. A stream that begins like one around it may hold
    itself: it is given as it is, as a layer of its own, for the worklist knows what it has seen."""
    head = source.head(4096)
    if head in above or len(above) >= 50:
        return iter([b"".join(iter(source.read, b"")).decode("latin-1")])
    content = _Source(_opened(source))
    return _pieces(content, above | {head}) if content.head(1) else None


def _pieces(source: _Source, above: frozenset[bytes] = frozenset()) -> Iterator[str]:
    """What the source holds, cut at breaks; streams in it are opened in their turn."""
    if _decoder(source.head(6)) is not None and (own := _nested(source, above)) is not None:
        yield from own
    held, size, tail = [], 0, b""
    while part := source.read():
        whole = tail + part
        found = _INNER.search(whole)
        if found and found.end() > len(tail):
            source.back(whole[found.start() :])
            before = b"".join([*held, part])[: size - len(tail) + found.start()]
            own = _nested(source, above)
            if own is not None:
                if before:
                    yield before.decode("latin-1")
                yield from own
                held, size, tail = [], 0, b""
            else:  # no stream after all: its first byte is one like others
                first = source.read()
                source.back(first[1:])
                held, size, tail = [before, first[:1]], len(before) + 1, b""
            continue
        held.append(part)
        size += len(part)
        tail = whole[-9:]  # a stream's beginning may stand over two parts
        if size < CHUNK:
            continue
        text, at = part[:-9].decode("latin-1"), 0
        for begin in (max(0, len(text) - 1000), 0):
            for m in _BREAK.finditer(text, begin):
                at = m.end()
            if at:
                break
        if at:
            yield b"".join([*held[:-1], part[:at]]).decode("latin-1")
            held, size = [part[at:]], len(part) - at
    if size:
        yield b"".join(held).decode("latin-1")


def _stream_end(raw: bytes, at: int) -> tuple[int, bool]:
    """Where the compressed stream at a place ends, by reading through it, and whether it holds anything; a broken one goes on to the
    end of the bytes."""
    source, size = _Source(_fed(raw, at)), 0
    for part in _opened(source):
        size += len(part)
    return len(raw) if source.broken else len(raw) - len(source.held) - sum(map(len, source.parts)), size > 0


def _streams(layer: Layer) -> Iterator[Layer]:
    """The content of compressed streams, wherever they begin. All of it comes from the whole range of the stream."""
    for run in _BYTES.finditer(layer.text) if not layer.text.isascii() or "BZh" in layer.text else ():
        raw, at = run.group().encode("latin-1"), 0
        while m := _MAGIC.search(raw, at):
            end, holds = _stream_end(raw, m.start())
            at = m.start() + 1
            if not holds:
                continue
            source = _Source(_fed(raw, m.start()))
            place = layer.range(run.start() + m.start(), run.start() + end)
            place = place[0], max(place[1], layer.filled if run.start() + end == len(layer.text) else 0)
            for piece in _nested(source, frozenset()) or ():
                yield Layer(piece, *(np.broadcast_to(np.int64(x), len(piece)) for x in place))
            at = at if source.broken else end


def _deflated(raw: bytes) -> Iterator[str] | None:
    """The pieces of deflated bytes without a header; None if they are none: as nothing marks them, they must come to their end or begin as
    text."""
    own, parts = zlib.decompressobj(-15), []

    def read() -> Iterator[bytes]:
        for fed in _fed(raw):
            while fed and not own.eof:
                try:
                    out = own.decompress(fed, CHUNK)
                except zlib.error:
                    return
                if out:
                    yield out
                fed = own.unconsumed_tail

    content = read()
    for part in content:
        parts.append(part)
        if sum(map(len, parts)) >= 64:
            break
    head = b"".join(parts)
    if len(head) < 16 or not (own.eof or head.isascii() and not _CONTROL.search(head)):
        return None
    return _pieces(_Source(chain([head], content)))


def _bare(layer: Layer) -> Iterator[Layer]:
    """Deflate without a header in URL escapes."""
    for m in _URL_BYTES.finditer(layer.text) if "%" in layer.text else ():
        raw = bytes.fromhex(m.group().replace("%", ""))
        yield from _constant(layer, m.start(), m.end(), None if _readable(raw) else _deflated(raw))


def _constant(layer: Layer, a: int, b: int, pieces: Iterator[str] | None) -> Iterator[Layer]:
    """Layers of pieces, all of which come from one part of the layer."""
    place = layer.range(a, b)
    for piece in pieces or ():
        yield Layer(piece, *(np.broadcast_to(np.int64(x), len(piece)) for x in place))


def _readable(raw: bytes) -> bool:
    """Whether raw is text, so that a run of letters was base64 for sure."""
    if not raw or _CONTROL.search(raw):
        return False
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_CONTROL = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs and the places of their characters: each run by itself; lines of one width put together with the shorter line
    after them and the line before, which may begin within a line; and all lines that follow each other, whatever their widths."""
    for m in _BASE64.finditer(text):
        run = m.group().rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run))
    for m in _WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        if m.end() - m.start() < 17:
            continue
        ends = [x.span() for x in _LINE_END.finditer(text, m.start(), m.end())]
        lines = list(zip([m.start(), *(b for _, b in ends)], [*(a for a, _ in ends), m.start() + len(m.group().rstrip("="))], strict=True))
        first, given = 0, set()
        while first < len(lines):
            width, last = lines[first][1] - lines[first][0], first + 1
            while last < len(lines) and lines[last][1] - lines[last][0] == width:
                last += 1
            tail = last < len(lines) and lines[last][1] - lines[last][0] < width
            if last + tail - first > 1:
                given.add((max(0, first - 1), last + tail))
            first = last
        given.add((0, len(lines)))
        for a, b in sorted(given):
            run = "".join(text[x:y] for x, y in lines[a:b])
            if len(run) >= 16 and b - a > 1:
                yield run, np.concatenate([np.arange(x, y) for x, y in lines[a:b]])


def _bytes_of(run: str) -> bytes:
    """What a run of the plain alphabet holds; a letter too many at its end is left out."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    for run, places in _runs(layer.text):
        plain = run.replace("-", "+").replace("_", "/")
        raw = _bytes_of(plain)
        yield _mapped(layer, places, raw, 0)
        if not _readable(raw):  # something may stand before it: the other phases
            yield from _constant(layer, int(places[0]), int(places[-1]) + 1, _deflated(raw))
            for phase in range(1, 4):
                if len(plain) - phase > 4:
                    raw = _bytes_of(plain[phase:])
                    yield _mapped(layer, places, raw, phase)
                    yield from _constant(layer, int(places[phase]), int(places[-1]) + 1, None if _readable(raw) else _deflated(raw))


def _mapped(layer: Layer, places: np.ndarray, raw: bytes, phase: int) -> Layer:
    """A layer of the bytes that the letters of a run from `phase` on hold."""
    starts, ends = layer.ranges()
    at, end = np.arange(len(raw)), int(places[-1]) + 1
    signs = len(re.match("={0,2}", layer.text[end : end + 2]).group())
    return Layer(raw.decode("latin-1"), starts[places[at * 8 // 6 + phase]], ends[places[np.minimum(-(-(at + 1) * 8 // 6) + phase, len(places)) - 1]], int(ends[end + signs - 1]))


def findings(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int]:
    """Findings of the text itself, those of all layers as ranges of the text, and how many layers there are."""
    base = scan(text)
    every = set(base)
    work, seen = [iter([Layer(text)])], set()
    layers = 0
    while work:
        layer = next(work[-1], None)  # depth first, so that of a long stream one piece is there at a time
        if layer is None:
            work.pop()
            continue
        if layer.text:
            key = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *layer.range(0, len(layer.text)))
            if key in seen:
                continue
            seen.add(key)
        elif layer.starts is not None:
            continue
        layers += 1
        if layer.starts is not None:
            for a, kind, b in scan(layer.text):
                start, end = layer.range(a, b)
                every.add((start, kind, end))
        work.append(chain(_escapes(layer), _utf16(layer), _base64(layer), _bare(layer), _streams(layer)))
    return base, every, layers


def listed(found) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex (findings in the text as it stands), base_sha256 of their list,
    spans (all findings, those in unwrapped layers mapped to the original), n_layers, found (array of structs kind, start, end).

    Places are code points, ends exclusive. Null and empty texts have no findings. Repeated rows give repeated rows, an empty table
    none; other columns are ignored. Very long texts are scanned whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "found"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[] for _ in names[1:]]
        for text in strings_of(batch.column(1)):
            base, every, layers = findings(text)
            for k in range(3):
                out[k].append(sum(x[1] == k for x in base))
            out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out[4].append(listed(every))
            out[5].append(layers)
            out[6].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(every)])
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), struct]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=names)

    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, found array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(per_batch(run), schema).withColumnRenamed("id", id_col)
