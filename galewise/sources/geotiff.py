"""GeoTIFF files of one band: headers, blocks (strips or tiles) one by one, and the writer.

Read: 8, 16, 32 and 64 bit samples of either byte order, uncompressed, LZW or deflated, with or without horizontal differences. Written: tiles
in LZW with horizontal differences (floats without them).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

#: TIFF field types (struct letter), and the tags that are read and written.
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_COLS, _ROWS, _BITS, _PACKING, _PHOTO, _STRIPS, _SAMPLES, _PER_STRIP, _STRIP_SIZES, _PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
_TILE_COLS, _TILE_ROWS, _TILES, _TILE_SIZES, _FORMAT, _SCALE, _TIE, _KEYS, _NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_MODEL, _RASTER, _PROJECTED = 1024, 1025, 3072
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE = 1, 5, 8, 32946
_CLEAR, _END, _FIRST, _FULL = 256, 257, 258, 4094


@dataclass
class Header:
    """What a file says of its band; blocks are (start, size) in row order."""

    rows: int
    cols: int
    high: int
    wide: int
    packing: int
    predictor: int
    kind: np.dtype
    transform: dict
    crs: int | None
    blocks: list[tuple[int, int]]

    def place(self, k: int) -> tuple[int, int, int, int]:
        """First row and column of a block, and how many of each lie on the raster."""
        across = -(-self.cols // self.wide)
        y, x = k // across * self.high, k % across * self.wide
        return y, x, min(self.high, self.rows - y), min(self.wide, self.cols - x)


def header(read: Callable[[int, int], bytes]) -> Header:
    """The header of a file whose bytes read(start, size) gives."""
    first = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    if order is None or len(first) < 8 or struct.unpack_from(order + "H", first, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", first, 4)
    (n,) = struct.unpack(order + "H", read(at, 2))
    fields, t = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, size = struct.unpack_from(order + "HHI", fields, 12 * k)
        if kind in _TYPES:
            form = f"{order}{size}{_TYPES[kind]}"
            width = struct.calcsize(form)
            raw = fields[12 * k + 8 : 12 * k + 8 + width] if width <= 4 else read(struct.unpack_from(order + "I", fields, 12 * k + 8)[0], width)
            t[tag] = struct.unpack(form, raw)
    packing, predictor = t.get(_PACKING, (1,))[0], t.get(_PREDICTOR, (1,))[0]
    if packing not in (_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE):
        raise ValueError(f"compression {packing} is not understood")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not understood")
    if t.get(_SAMPLES, (1,))[0] != 1:
        raise ValueError("more than one band")
    rows, cols = t[_ROWS][0], t[_COLS][0]
    high, wide = (t[_TILE_ROWS][0], t[_TILE_COLS][0]) if _TILES in t else (min(rows, t.get(_PER_STRIP, (rows,))[0]), cols)
    (sx, sy), tie, keys = t.get(_SCALE, (1.0, 1.0))[:2], t.get(_TIE, (0.0,) * 6), t.get(_KEYS, ())
    crs = next((keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k] == _PROJECTED), None)
    transform = {"a": sx, "b": 0.0, "c": tie[3] - tie[0] * sx, "d": 0.0, "e": -sy, "f": tie[4] + tie[1] * sy}
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[t.get(_FORMAT, (1,))[0]] + str(t.get(_BITS, (8,))[0] // 8))
    blocks = zip(*((t[_TILES], t[_TILE_SIZES]) if _TILES in t else (t[_STRIPS], t[_STRIP_SIZES])), strict=True)
    return Header(rows, cols, high, wide, packing, predictor, kind, transform, crs, list(blocks))


def block(h: Header, k: int, raw: bytes) -> np.ndarray:
    """The pixels of block k that lie on the raster."""
    raw = raw if h.packing == _PLAIN else unpacked_lzw(raw) if h.packing == _LZW else zlib.decompress(raw)
    own = np.frombuffer(raw[: len(raw) // (h.wide * h.kind.itemsize) * h.wide * h.kind.itemsize], dtype=h.kind).reshape(-1, h.wide)
    if h.predictor == 2:
        own = np.cumsum(own, axis=1, dtype=h.kind.newbyteorder("="))  # whole numbers wrap round
    _, _, high, wide = h.place(k)
    return own[:high, :wide]


def unpacked_lzw(raw: bytes) -> bytes:
    """Codes of nine bits and more, the first bit first; a width ends one code before it is used up."""
    plain = [bytes([k]) for k in range(256)] + [b"", b""]
    out, table, before, width, held, bits = [], list(plain), None, 9, 0, 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, before, width = list(plain), None, 9
            continue
        if code > len(table) or (before is None and code == len(table)):
            raise ValueError("broken LZW data")
        if before is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
        out.append(entry)
        before = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def packed_lzw(raw: bytes) -> bytes:
    """The same, written."""
    out, held, bits, width = bytearray(), 0, 0, 9
    table, next_code, own = {bytes([k]): k for k in range(256)}, _FIRST, b""
    codes: list[tuple[int, int]] = [(_CLEAR, 9)]
    for k in range(len(raw)):
        more = own + raw[k : k + 1]
        if more in table:
            own = more
            continue
        codes.append((table[own], width))
        table[more] = next_code
        next_code, own = next_code + 1, raw[k : k + 1]
        if next_code == _FULL:
            codes.append((_CLEAR, 12))
            table, next_code, width = {bytes([k]): k for k in range(256)}, _FIRST, 9
        elif next_code == 1 << width:
            width += 1
    if own:
        codes.append((table[own], width))
        if next_code + 1 == 1 << width and width < 12:
            width += 1
    codes.append((_END, width))
    for code, size in codes:
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits))
    return bytes(out)


def encoded(band: np.ndarray, transform: dict, crs: int | None = None, tile: int = 256) -> bytes:
    """A file of tiles in LZW, with horizontal differences for whole numbers. Rasters that are turned can't be written."""
    if transform["b"] or transform["d"]:
        raise ValueError("a turned raster has no scale")
    if tile % 16:
        raise ValueError("tiles are multiples of 16")
    rows, cols = band.shape
    band = band.astype(band.dtype.newbyteorder("<"))
    whole = band.dtype.kind in "ui"
    blocks = []
    for y in range(0, rows, tile):
        for x in range(0, cols, tile):
            own = np.zeros((tile, tile), dtype=band.dtype)
            part = band[y : y + tile, x : x + tile]
            own[: part.shape[0], : part.shape[1]] = part
            if whole:
                own[:, 1:] = own[:, 1:] - own[:, :-1]
            blocks.append(packed_lzw(own.tobytes()))
    fields = [(_COLS, "I", [cols]), (_ROWS, "I", [rows]), (_BITS, "H", [8 * band.dtype.itemsize]), (_PACKING, "H", [_LZW]), (_PHOTO, "H", [1]), (_SAMPLES, "H", [1]), (_PREDICTOR, "H", [2 if whole else 1]), (_TILE_COLS, "H", [tile]), (_TILE_ROWS, "H", [tile]), (_TILES, "I", [0] * len(blocks)), (_TILE_SIZES, "I", [len(b) for b in blocks]), (_FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[band.dtype.kind]]), (_SCALE, "d", [transform["a"], -transform["e"], 0.0]), (_TIE, "d", [0.0, 0.0, 0.0, transform["c"], transform["f"], 0.0])]
    if crs is not None:
        fields.append((_KEYS, "H", [1, 1, 0, 3, _MODEL, 0, 1, 1, _RASTER, 0, 1, 1, _PROJECTED, 0, 1, crs]))
    at = 8 + 2 + 12 * len(fields) + 4
    extra = sum(len(v) * struct.calcsize(f) for _, f, v in fields if len(v) * struct.calcsize(f) > 4)
    start = at + extra
    head, beyond = struct.pack("<H", len(fields)), b""
    for tag, form, values in fields:
        if tag == _TILES:
            values = list(accumulate((len(b) for b in blocks[:-1]), initial=start))
        packed = struct.pack(f"<{len(values)}{form}", *[int(v) for v in values] if form != "d" else values)
        head += struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values))
        if len(packed) <= 4:
            head += packed.ljust(4, b"\0")
        else:
            head += struct.pack("<I", at + len(beyond))
            beyond += packed
    return b"II" + struct.pack("<HI", 42, 8) + head + b"\0" * 4 + beyond + b"".join(blocks)
