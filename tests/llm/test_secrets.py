"""Nested encodings: chains, random stacks of all of them, and what each alone hides."""

import base64
import bz2
import gzip
import json
import lzma
import random
import time
import zlib
from urllib.parse import quote

import pytest

from galewise.llm import secrets

KEY = "password=Zx9Yw8Vu7Ts6Rq5"


def found_in(text):
    """All findings, those of layers included, as (kind, start, end)."""
    return {(k, a, b) for a, k, b in secrets.findings(text)[1]}


def deflated(raw):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def in_lines(text, width, before="", after=""):
    return "\n".join(before + text[i : i + width] + after for i in range(0, len(text), width))


def b64(raw):
    return base64.b64encode(raw).decode()


#: Text to text; what is packed goes into base64 to be text again.
WRAPS = {
    "url": lambda t: quote(t, safe=""),
    "url all": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "url u": lambda t: "".join(f"%u{ord(c):04x}" if c in "=\\%&+/>" or c.isspace() else c for c in t),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" if not c.isalnum() else c for c in t),
    "hex": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "octal": lambda t: "".join(f"\\{ord(c):03o}" if not c.isalnum() else c for c in t),
    "json": lambda t: json.dumps(t),
    "decimal": lambda t: "".join(f"&#{ord(c)};" if not c.isalnum() else c for c in t),
    "reference": lambda t: "".join({"=": "&equals;", "_": "&lowbar;", "%": "&percnt;", "&": "&amp;", "\\": "&bsol;", "+": "&plus;", "/": "&sol;", ";": "&semi;", "\n": "&NewLine;"}.get(c, c) for c in t),
    "base64": lambda t: b64(t.encode()),
    "url-safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    "narrow": lambda t: in_lines(b64(t.encode()), 8),
    "quoted": lambda t: in_lines(b64(t.encode()), 12, "> "),
    "commented": lambda t: in_lines(b64(t.encode()), 20, "  # "),
    "literal": lambda t: in_lines(b64(t.encode()), 16, '  "', '" +'),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "zlib": lambda t: b64(zlib.compress(t.encode())),
    "bzip2": lambda t: b64(bz2.compress(t.encode())),
    "xz": lambda t: b64(lzma.compress(t.encode())),
    "deflate": lambda t: b64(deflated(t.encode())),
    "deflate in url": lambda t: "".join(f"%{b:02x}" for b in deflated(t.encode())),
}


@pytest.mark.parametrize("name", WRAPS)
def test_each_alone(name):
    text = f"see: {WRAPS[name](KEY)} and"
    found = [x for x in found_in(text) if x[0] == 0]
    assert found, text
    assert all(5 <= a and b <= len(text) - 4 for _, a, b in found)


@pytest.mark.parametrize("seed", range(60))
def test_random_stacks(seed):
    rng = random.Random(seed)
    text, names = KEY, []
    for _ in range(rng.randrange(2, 6)):
        names.append(rng.choice(list(WRAPS)))
        text = WRAPS[names[-1]](text)
    whole = f"Some words before.\n\n{text}\n\n, and after."
    found = [x for x in found_in(whole) if x[0] == 0]
    assert any(20 <= a and b <= len(whole) - 14 for _, a, b in found), names


@pytest.mark.parametrize("at", ["api&lowbar;key=Zx9Yw8Vu7Ts6Rq5", "password%u003DZx9Yw8Vu7Ts6Rq5", "password\\075Zx9Yw8Vu7Ts6Rq5", '{\\"password\\": \\"Zx9Yw8Vu7Ts6Rq5\\"}', "password\\=Zx9Yw8Vu7Ts6Rq5", "password&#0000061;Zx9Yw8Vu7Ts6Rq5"])
def test_single_escapes(at):
    assert any(k == 0 for k, _, _ in found_in(at))


CHAINS = {
    "percent": lambda n: "password%" + "25" * (n // 2) + "3DZx9Yw8Vu7Ts6Rq5",
    "ampersand": lambda n: "password&" + "amp;" * (n // 4) + "#61;Zx9Yw8Vu7Ts6Rq5",
    "backslash": lambda n: "password" + "\\" * n + "u003dZx9Yw8Vu7Ts6Rq5",
    "hex backslash": lambda n: "password\\x5c" + "x5c" * (n // 3) + "x3dZx9Yw8Vu7Ts6Rq5",
    "mixed": lambda n: "password%26" + "amp;" * (n // 8) + "percnt;" + "25" * (n // 4) + "3DZx9Yw8Vu7Ts6Rq5",
}


@pytest.mark.parametrize("name", CHAINS)
def test_chains_take_linear_time(name):
    took = []
    for n in (50_000, 1_000_000):
        text, began = CHAINS[name](n), time.process_time()
        assert (0, 0, len(text)) in found_in(text)
        took.append(time.process_time() - began)
    assert took[1] < 5 or took[1] < 30 * took[0]


def test_deep_chains_and_levels_agree(monkeypatch):
    """To the end at once and level by level come to the same text and places."""
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["%25", "25", "%", "&amp;", "amp;", "\\\\", "\\u0026", "u005c", "&", "ab", "41", "x3d", ";", "&lt", "&nLt;", "%u0025"]) for _ in range(12))
        layer = secrets.Layer(text)
        end = secrets._to_the_end(layer)
        steps = layer
        while (new := secrets._one_level(steps)) is not None:
            steps = new
        assert secrets._one_level(end) is None
        spots = list(zip(*(x.tolist() for x in end.ranges()), strict=True))
        assert spots == sorted(spots) and all(a < b <= len(text) for a, b in spots)
        if end.text == steps.text:
            assert spots == list(zip(*(x.tolist() for x in steps.ranges()), strict=True))


def test_places_of_references_of_two_signs():
    layer = secrets._one_level(secrets.Layer("a&nLt;b%41&unknown;c"))
    assert layer.text == "a\u226a\u20d2bA&unknown;c"
    assert layer.starts.tolist() == [0, 1, 1, 6, 7, *range(10, 20)] and layer.ends.tolist() == [1, 6, 6, 7, 10, *range(11, 21)]


def test_a_megabyte_of_plain_text_and_of_bytes():
    rng = random.Random(1)
    for text in ("words of a text, and more of them\n" * 30_000, b64(rng.randbytes(700_000)), "".join(chr(x) for x in rng.randbytes(1_000_000))):
        began = time.process_time()
        secrets.findings(text)
        assert time.process_time() - began < 20
