"""The corpus operators' contracts by brute force, without any of their code."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    lengths = {len(p) for p in patterns}
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := patterns.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [True] * n
        yield doc, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def rules(text):
    text = text or ""
    w = TOKEN.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if TOKEN.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marks = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            marks[i : i + 5] = [True] * 5
    repeated = sum(marks)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, repeated, len(w) < 10 or 100 * repeated > 20 * len(w)


PHRASES = ((["cc", "by"], "cc-by"), (["general", "public", "license"], "gpl"), (["all", "rights", "reserved"], "reserved"))


def licenses(text):
    w = words(text)
    at = [(i, label) for phrase, label in PHRASES for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == phrase]
    spots = [i for i, _ in at]
    return len(w), len(at), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in at}))


def fingerprint(text, n=4):
    w = TOKEN.findall((text or "").translate(LOW))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, bits=4):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            up[max(root(i), root(i + 1 + int(j)))] = min(root(i), root(i + 1 + int(j)))
    least = {}
    for i in range(len(ids)):
        least.setdefault(root(i), []).append(ids[i])
    return [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(ids))]


def targets(sizes, share=1.5, cap=2.0):
    """sizes: source -> words, in order."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    budget, free = share * sum(sizes.values()), set(sizes)
    while free:
        level = (budget - sum(cap * sizes[s] for s in sizes if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            break
        free -= over
    return {s: weight[s] * level if s in free else cap * sizes[s] for s in sizes}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
