"""Source divergence, URL filters and collocations against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from galewise.llm import collocations, divergence, queries, url_filters

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n string, term string, row long, value long, word string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_url_filters", "op13_collocations"])
def test_same_as_sql(spark, name):
    with duckdb.connect() as con:
        for table in ("documents", "pages"):
            con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
        want = con.sql(queries.ORACLES[name])
        got = queries.QUERIES[name](spark, SF)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert rows(got, *columns) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def table(spark, given):
    return spark.createDataFrame([(i, text, lang, source, "own", "own", 1, 2, "own") for i, (text, lang, source) in enumerate(given)], DOCS)


def crowd(seed, n=400):
    """Texts of a few words, some of which stand together often; with nulls, repeated rows, odd signs and hot sources."""
    rng = random.Random(seed)
    words = ["Alpha", "beta", "Ünder", "d'or", "x1y2", "\x1c", "gamma", "delta", "ÉTÉ", "\U0001f600", "e", "zeta"]
    out = [(None, None, None), ("", "", ""), (None, "en", "a"), ("  \t ", "fr", None), ("only words here", "alone", "one")]
    for _ in range(n):
        text = "".join(rng.choice([*words, "New York City hall", "new york", "as well as", "as well as the"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "!", "\u00a0"]) for _ in range(rng.randrange(30)))
        out += [(text, rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "c", None, "\uffff", "\U0001f600"]))] * rng.choice([1, 1, 1, 3])
    return out


def audited(given, min_docs, top):
    texts = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)), lang or "", source or "") for t, lang, source in given]
    out = []
    for lang in {x[1] for x in texts}:
        own = [x for x in texts if x[1] == lang]
        docs = Counter(w for x in own for w in set(x[0]))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for terms, _, source in own:
            counts[source].update(w for w in terms if docs[w] >= min_docs)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [("pair", o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [("term", w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, most in ((pairs, None), (terms, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k) for k, x in enumerate(part[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_its_definition(spark, monkeypatch, seed):
    given = crowd(seed)
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 5)
    monkeypatch.setattr(divergence, "BLOCK", 2)
    got = divergence.audit(table(spark, given), min_docs=10, top=3)
    assert rows(got) == audited(given, 10, 3)


def test_divergence_where_no_term_is_kept(spark):
    given = [("ab cd", "en", "a"), ("ef", "en", None), (None, "en", "b"), ("gh", "fr", "a")]
    assert rows(divergence.audit(table(spark, given))) == audited(given, 10, 10)
    assert len(audited(given, 10, 10)) == 6
    assert divergence.audit(table(spark, given).limit(0)).count() == 0


def test_bounds_stop_the_search(spark):
    """Sources of a common vocabulary and some words of their own: the first buckets hold those, and no other round is needed."""
    rng = random.Random(5)
    common = [f"common{'x' * (i % 9)}{chr(97 + i % 26)}" for i in range(150)]
    given = [(" ".join(rng.choices(common, k=60) + [f"own{s}{chr(97 + i)}" for i in range(12)] * 5), "en", s) for s in "abc" for _ in range(40)]
    _, postings = divergence.statistics(table(spark, given))
    best, rounds = divergence.marked_terms(postings)
    assert rounds == 1 and all(r["item"].startswith(f"own{r['source']}") for r in best.collect()) and best.count() == 30


def parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*)(.*)", rest).groups()[:2]
    return host.translate(LOW), path


def edged(pattern):
    """A pattern as an expression of this module's dialect."""
    head = tail = ""
    if pattern.startswith("||"):
        head, pattern = r"^[^/?#]*://(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        pattern, tail = pattern[:-1], r"\Z"
    one = {"*": "(?s:.*)", "^": r"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F]|^|\Z)"}
    return re.compile(head + "".join(one.get(c) or re.escape(c) for c in pattern.translate(LOW)) + tail)


def verdict(url, rules):
    host, path = parts(url)
    prefixes, patterns = [], []
    for rule, own in rules:
        if set(rule) & set("*^|"):
            if edged(rule).search((url or "").translate(LOW)):
                patterns.append((own == "allow", len(rule), rule, own))
            continue
        h, _, p = rule.partition("/")
        h, p = h.translate(LOW), rule[len(h) :]
        if (host == h or host.endswith("." + h)) and (path.startswith(p) if p else True):
            prefixes.append((len(rule), rule, own))
    if prefixes:
        return host, path, *max(prefixes)[1:], None
    return host, path, None, *(max(patterns)[3:1:-1] if patterns else ("allow", None))


URLS = [
    None, "", "no scheme net/", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://xnet/", "http://a.example.net/en/1?q", "http://a.example.net/en", "http://example.com/de/", "x://y.org/fr/://net/",
    "http://a.org/fr/#net/", "http://www.cheap-pills.example.com/en/", "http://cheap.pills/", "casino", "http://x/casino-royale-film", "http://mycasinos.tld/", "https://doubleclick.io/a", "https://ads.doubleclick.io", "http://a/doubleclick",
    "http://user@a.net:80/", "http://é.net/É", "http://a.net/\n/x", "http://buy.x/cheap/viagra now", "http://example.com/DE/", "HTTP://EXAMPLE.COM/de/", "http://x.com/" + "a/" * 100_000 + "casino/",
]
PAGES = "page_id long, url string, html string, host string, row string, token string, verdict string"


def pages(spark, urls):
    return spark.createDataFrame([(i // 2, u, "h", "own", "own", "own", "own") for i, u in enumerate(urls)] + [(None, "http://a.net/", None, None, None, None, None)] * 2, PAGES)


def test_url_verdicts(spark):
    given = URLS + URLS[:4]
    got = rows(url_filters.judged(pages(spark, given)))
    rules = url_filters.RULES + url_filters.PATTERNS
    assert got == sorted([(i // 2, *verdict(u, rules)) for i, u in enumerate(given)] + [(None, *verdict("http://a.net/", rules))] * 2, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_rules_of_all_kinds(spark, monkeypatch, most):
    """Random rules and urls, with the rules broadcast and with keys dealt out over salts."""
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", most)
    monkeypatch.setattr(url_filters, "ROWS_PER_SALT", 3)
    rng = random.Random(3)
    words = ["ab", "b", "Cd", "é", "x-y", "a.b", "+", "(", "0"]
    piece = lambda signs, k: "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(1, k)))
    urls = [f"{rng.choice(['http', 'h'])}://{piece(['.', '-', ''], 4)}{rng.choice(['/', ''])}{piece(['/', '?', '#', '', '.'], 5)}" for _ in range(300)]
    rules = {piece(["*", "^", "", ".", "/"], 4) for _ in range(80)} | {f"{piece(['.'], 3)[:-1]}/{piece(['/', ''], 3)}" for _ in range(60)} | {"||ab^", "|h", "cd|", "||*", "b"}
    rules = [(r, rng.choice(["allow", "block"])) for r in sorted(rules) if not re.search(r"\|.*[^|]", r.lstrip("|"))]
    got = rows(url_filters.judged(pages(spark, urls), spark.createDataFrame([*rules, (None, "block"), ("ab.b", None)], "rule string, verdict string")))
    want = sorted([(i // 2, *verdict(u, rules)) for i, u in enumerate(urls)] + [(None, *verdict("http://a.net/", rules))] * 2, key=repr)
    assert got == want and len({x[3] for x in got}) > 3 and len({x[5] for x in got}) > 3


def test_only_rules_of_the_tokens_run(spark):
    """A rule's key is the rarest of its tokens: urls with common ones alone don't fetch it."""
    urls = ["http://example.com/en/"] * 50 + ["http://example.com/casino/"] * 2
    keyed = spark.createDataFrame([(i, re.findall("[a-z0-9]+", u)) for i, u in enumerate(urls)], "row long, tokens array<string>")
    rules = spark.createDataFrame([("^com^casino^", "block"), ("example.com/de/", "block")], "rule string, verdict string")
    assert rows(url_filters.candidates(keyed, url_filters.compiled(rules)), "row", "rule") == [(50, "^com^casino^"), (51, "^com^casino^")]


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r["verdict"] for r in url_filters.judged(pages(spark, URLS), none).collect()} == {"allow"}
    assert url_filters.judged(pages(spark, URLS).limit(0)).count() == 0


def mined(given, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang, _ in given:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            f[lang].update(words[i : i + k] for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        many = {w: a for w, a in own.items() if len(w) > 1 and a >= least}
        kept = []
        for w, a in many.items():
            if any(len(x) > len(w) and b >= a and any(x[i : i + len(w)] == w for i in range(len(x))) for x, b in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[w[:k]] * own[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), own[w[:k]], own[w[k:]]))
        kept.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(kept[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 20, 30), (2, 5, 2000), (3, 100, 3)])
def test_collocations_are_their_definition(spark, monkeypatch, seed, least, top):
    given = crowd(seed)
    monkeypatch.setattr(collocations, "PORTION", 3_000)
    monkeypatch.setattr(collocations, "HELD", 50)
    got = collocations.collocations(table(spark, given), least=least, top=top)
    want = mined(given, least, 5, top)
    assert rows(got) == want and want


def test_full_buckets_prune_and_lose_nothing(spark, monkeypatch):
    """The fewest buckets there can be, where all hashes meet, and very many: the same phrases."""
    given = crowd(4)
    want = mined(given, 20, 5, 2000)
    for bits in (1 << 12, 1 << 20):
        monkeypatch.setattr(collocations, "_bits_for", lambda n, bits=bits: bits)
        assert rows(collocations.collocations(table(spark, given), least=20)) == want and want


def test_phrases_that_are_not_frequent_are_not_sent(spark):
    """What a pass sends on for exact counting are phrases of frequent parts in full buckets."""
    import pyarrow as pa

    text = "a b. " * 60 + "a c. " * 3 + "d e. " * 70
    parts = collocations.Bits(None)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    first = list(collocations._pass(1, parts, parts, 1 << 16, 50)[0](iter([batch])))
    blocks = [r for b in first for r in b.to_pylist() if r["block"] is not None]
    summed = collocations._summed(1 << 16, 50)(iter([pa.RecordBatch.from_pylist([{k: r[k] for k in ("block", "places", "counts")} for r in blocks])]))
    import numpy as np

    bits = np.zeros((1 << 16) // 8, dtype=np.uint8)
    for b in summed:
        for r in b.to_pylist():
            bits[r["block"] * 512 : (r["block"] + 1) * 512] = np.frombuffer(r["bits"], dtype=np.uint8)
    second = list(collocations._pass(2, parts, collocations.Bits(bits, 1 << 16), 0, 50)[0](iter([batch])))
    assert {r["phrase"]: r["n"] for b in second for r in b.to_pylist()} == {"a b": 60, "d e": 70}


def test_very_long_texts_and_none(spark):
    long = "one two three four five six. " * 30_000
    given = [(long, "en", "a"), ("word " * 1_100_000, None, "b"), (None, None, None)]
    got = collocations.collocations(table(spark, given))
    assert [(r["lang"], r["phrase"], r["a"]) for r in got.collect() if r["lang"] == "en"] == [("en", p, 30_000) for p in ("one two three four five", "two three four five six")]
    assert {(r["phrase"], r["a"], r["n"]) for r in got.collect() if r["lang"] == "und"} == {(" ".join(["word"] * k), 1_100_001 - k, 1_100_000) for k in range(2, 6)}
    assert collocations.collocations(table(spark, given).limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(table(spark, given), longest=1)
