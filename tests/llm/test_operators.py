"""Results against brute force, planted cases and held-out labels."""

import base64
import bz2
import gzip
import hashlib
import lzma
import zlib
from urllib.parse import quote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from galewise.llm import decontamination, learning, licenses, mixing, quality, quality_rules, queries, secrets, sharding, simhash, token_codes, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_decontamination(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(queries.op1_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(texts, items)) and any(x[-1] for x in got)


@pytest.mark.parametrize("size", [1 << 20, decontamination.BLOCK])
def test_decontamination_by_tables_of_any_size(spark, docs, texts, monkeypatch, size):
    """Long items, items with equal windows, hot passages over salts, and tables so small that every place is a candidate."""
    for name in ("FEWEST", "MOST_CELLS", "MOST_BITS"):
        monkeypatch.setattr(decontamination, name, size)
    monkeypatch.setattr(decontamination, "ROWS_PER_SALT", 4)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    long = bench.agg(F.lit(999).cast("long").alias("item_id"), F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
    short = spark.createDataFrame([(1_000, "The"), (1_001, "of the"), (1_002, "of the"), (None, "of The"), (1_003, None), (1_004, " . ")], "item_id long, text string")
    bench = bench.unionByName(long).unionByName(short)
    items = [("" if r["item_id"] is None else r["item_id"], r["text"] or "") for r in bench.collect()]
    extra = [(10**6 + k, f"some text of the {' '.join(['of the'] * 20)} {texts[5][1]}") for k in range(30)]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.contamination([*texts, *extra], items))
    assert rows(decontamination.contamination(some, bench), *columns) == want
    left = decontamination.decontaminated(some, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(x[0] for x in want if not x[-1])


def test_places_of_windows_of_all_lengths(spark):
    items = [("a", "one two three"), ("b", "X"), ("c", " ".join(f"w{i}" for i in range(15))), ("d", "one two three")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    text = "zero One, two; three x " + " ".join(f"w{i}" for i in range(2, 13))
    (got,) = decontamination.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()
    assert got["items"] == ["a", "b", "c", "d"] and [tuple(x) for x in got["hit_ranges"]] == [(1, 16)] and got["n_hit"] == 15


def test_shifts_skip_no_window():
    """The search against all places of all windows."""
    rng = np.random.default_rng(2)
    words = [b"a", b"b", b"c"]
    import pyarrow as pa

    for _ in range(20):
        texts = [b" ".join(rng.choice(words, rng.integers(1, 14)).tolist()) for _ in range(5)]
        batch = pa.RecordBatch.from_arrays([pa.array(["i"] * 5), pa.array([t.decode() for t in texts])], names=["item", "text"])
        cells, bits, lengths = np.zeros(1 << 16, np.uint8), np.zeros(1 << 13, np.uint8), []
        for part in decontamination._folded(decontamination._cells(6, 1 << 16, 1 << 16)(iter([batch]))):
            for r in part.to_pylist():
                own = np.frombuffer(r["values"], np.uint8)
                if r["table"] == 2:
                    lengths = np.flatnonzero(own).tolist()
                else:
                    (bits if r["table"] else cells)[r["block"] * len(own) : (r["block"] + 1) * len(own)] = own
        doc = rng.choice(words, 60).tolist()
        got = sorted(x[:2] for x in decontamination.WuManber(cells.tobytes(), bits.tobytes(), lengths).search(doc))
        known = {tuple(t.split()[k : k + min(6, len(t.split()))]) for t in texts for k in range(max(1, len(t.split()) - 5))}
        assert got == sorted((k, len(w)) for w in known for k in range(60) if tuple(doc[k : k + len(w)]) == w)


def test_sharding_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for limit in (sharding.LIMIT, 20_000, 3_000):
        sql = sharding.ORACLE.replace(str(sharding.LIMIT), str(limit))
        got = rows(sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"), limit=limit), "doc_id", "n_bytes", "depth", "shard_id")
        assert got == sorted(con.sql(f"select doc_id, n_bytes, depth, shard_id from ({sql})").fetchall())
    assert len({x[3] for x in got}) > 20


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), limit=50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard_id").distinct().count() > 3


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    n = 3_000
    x = rng.normal(size=n)
    y = np.searchsorted([-1.0, 0.5, 1.5], x + rng.logistic(scale=0.1, size=n))
    fitted = quality.Ordinal.fit(learning.Rows(np.zeros(n, dtype=np.int64), x, np.ones(n, dtype=np.int64), 1), y, steps=600)
    assert (np.diff(fitted.thresholds) > 0).all() and list(fitted.grades) == [0, 1, 2, 3]
    expected, tail = fitted.judged(x * fitted.weights[0], 2)
    assert np.corrcoef(expected, y)[0, 1] > 0.92 and ((tail > 0.5) == (y >= 2)).mean() > 0.95


def test_ordinal_gradients_and_grades():
    """Gradients against differences of the likelihood as it is defined, and grades and tails against their definition."""
    rng = np.random.default_rng(6)
    n, k = 60, 3
    x, y = rng.normal(size=(n, k)), rng.integers(0, 4, n)
    rows_ = learning.Rows(np.tile(np.arange(k), n), x.ravel(), np.full(n, k), k)
    f = lambda z: 1 / (1 + np.exp(-z))

    def loss(w, t):
        cut = np.concatenate([[-np.inf], quality.Ordinal.cuts(t), [np.inf]])
        return -np.log(f(cut[y + 1] - x @ w) - f(cut[y] - x @ w)).mean()

    w, t = rng.normal(size=k), np.array([-0.8, 0.1, -0.4])
    g_w, g_t = quality.Ordinal.gradients(rows_, y, w, t)
    for i in range(3):
        e = 1e-6 * np.eye(3)[i]
        assert g_w[i] == pytest.approx((loss(w + e, t) - loss(w - e, t)) / 2e-6, abs=1e-6)
        assert g_t[i] == pytest.approx((loss(w, t + e) - loss(w, t - e)) / 2e-6, abs=1e-6)
    expected, tail = quality.Ordinal(w, quality.Ordinal.cuts(t), np.arange(4)).judged(x @ w, 2)
    above = f((x @ w)[:, None] - quality.Ordinal.cuts(t)[None])
    assert tail == pytest.approx(above[:, 1]) and expected == pytest.approx(above.sum(1))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op3_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out").select("kept", "quality").collect()
    assert len(got) > 50 and sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.95


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) / len(bad) > 0.75 and sum(r["predicted"] for r in good) / len(good) < 0.01
    wins = sum((b["score"] > g["score"]) + 0.5 * (b["score"] == g["score"]) for b in bad for g in good)
    assert wins / len(bad) / len(good) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_viterbi_is_the_best_of_all_paths():
    """Against every path of short lattices, under a random model."""
    from itertools import product

    rng = np.random.default_rng(4)
    model = toxicity.CharModel(rng.integers(0, 50, 27**3))

    def cost(letters, price):
        a = b = 0
        for x in letters:
            price -= model.rows[a][b][ord(x) - 96]
            a, b = b, ord(x) - 96
        return price - model.rows[a][b][0]

    for word in ["m0r0n", "$tup1d", "b11l", "@$$", "455", "a-b*c", "xxx1", "!!!", "8#o", *("".join(rng.choice(list("ab01@$*!-#"), 6)) for _ in range(40))]:
        best = min((cost("".join(x[0] for x in path), sum(x[1] for x in path)), "".join(x[0] for x in path)) for path in product(*toxicity.lattice(word)))
        found = toxicity.restore(word, model)
        assert cost(found, min(sum(x[1] for x in path) for path in product(*toxicity.lattice(word)) if "".join(x[0] for x in path) == found)) == pytest.approx(best[0])


def test_signs_in_place_of_letters():
    features = toxicity.Features(toxicity.CharModel(np.ones(27**3)))
    for word, meant in {"@ssh0le": "asshole", "@$$": "ass", "f00l": "fool", "455": "ass", "cl0wn!!": "clown"}.items():
        assert set(toxicity.hashed(meant)) <= set(features.of_word(word.encode()))
    assert "idiot" in toxicity._spaced(b"you id i ot there".split())


def test_disguised_words(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.filter("toxic = 0 and quality = 1"), "doc_id").filter("lang = 'en' and n_chars between 400 and 900").orderBy("doc_id").limit(12).select("text").collect()
    model = toxicity.char_model(docs)
    for word, want in {"1d10t": "idiot", "m0r0n": "moron", "scuuuum": "scum", "l.o.s.e.r": "loser", "p4thet1c": "pathetic", "$tup1d": "stupid", "w0rthle$$": "worthless"}.items():
        assert toxicity.restore(word, model) == want
    planted = [(i, r["text"] + f" you {a} and {b} !") for i, (r, a, b) in enumerate(zip(clean, ["1d10t", "m0ron", "l o s e r", "s-t-u-p-i-d", "p4thetic", "scuuum"] * 2, ["cl0wn", "tr@sh", "1diot", "m0r0n", "w0rthless", "d1sgusting"] * 2))]
    planted += [(100 + i, r["text"]) for i, r in enumerate(clean)]
    scored = toxicity.toxicity(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in planted], "doc_id long, text string")), labels)
    got = {r["doc_id"] - 10**9: r["predicted"] for r in scored.filter(f"doc_id >= {10**9}").collect()}
    assert [got[i] for i in range(12)] == [1] * 12 and [got[100 + i] for i in range(12)] == [0] * 12


@pytest.mark.parametrize(("spaced", "wanted"), [
    ("a i d i o t", ["idiot"]), ("y o u i d i o t", ["idiot"]), ("i d i o t s h u t", ["idiot"]), ("y o u s t u p i d m o r o n", ["stupid", "moron"]), ("t r a s h c l 0 w n", ["trash", "clown"]),
    ("a i d і о t", ["idiot"]), ("à i d i o t", ["idiot"]), ("y d é b i l e", ["débile", "debile"]), ("l o s e r", ["loser"]), ("a s c u u u m", ["scum"]), ("a", []), ("7 - é", []),
])
def test_spaced_words(spark, spaced, wanted):
    model = toxicity.char_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    found = toxicity.Features(model).of_text(f"some words {spaced} more words".encode())
    assert all(set(toxicity.hashed(w)) <= found for w in wanted)
    assert not found & {toxicity.hashed(w)[0] for w in ("crap", "rapist", "moronic")}


def test_secrets(spark, texts):
    for r in queries.op5_secrets(spark, SF).collect():
        base = brute.secrets(dict(texts)[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        listed = secrets.listed(base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


KEY = "password = hunter2hunter2"


@pytest.mark.parametrize("wrap", [
    lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: quote(base64.b64encode(quote(s, safe="").encode()).decode(), safe=""), lambda s: base64.b64encode(base64.b64encode(gzip.compress(s.encode()))).decode(),
])
def test_nested_secrets(wrap):
    before = "çava 😀 see "
    text = before + wrap(KEY) + " end"
    base, every, _ = secrets.findings(text)
    assert not any(k == 0 for _, k, _ in base)
    (start, _, end), = [x for x in every if x[1] == 0]
    assert len(before) <= start < end <= len(text) - 4
    clean, found, _ = secrets.findings(before + wrap("nothing to see in here") + " end")
    assert not clean and not found


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_streams_are_read_whole(pack):
    """A secret beyond 16 MiB, one after a cut in a character, one in a second member, and one over each place where a piece may end."""
    fill = "é some line of a log, " * 850_000
    for stream in (pack((fill + KEY).encode()), pack(b"the first member ") + pack(KEY.encode())):
        text = "see " + base64.b64encode(stream).decode() + " end"
        found = {(a, b) for a, k, b in secrets.findings(text)[1] if k == 0}
        # xz stores short data as it is, where it is seen, too
        assert (4, len(text) - 4) in found and all(4 <= a < b <= len(text) - 4 for a, b in found)


def test_pieces_of_a_stream(monkeypatch):
    monkeypatch.setattr(secrets, "CHUNK", 64)
    wraps = (lambda s: s, lambda s: base64.b64encode(s.encode()).decode(), lambda s: quote(s, safe=""), lambda s: s.replace("=", "%3D"), lambda s: base64.b64encode(gzip.compress(s.encode())).decode())
    for wrap in wraps:
        for n in range(64):
            whole = "words " * 10 + "x" * n + ", " + wrap(KEY) + ", " + "more words " * 20
            raw = gzip.compress(whole.encode())
            pieces = list(secrets._pieces(secrets._Source(secrets._opened(secrets._Source(secrets._fed(raw))))))
            assert "".join(pieces) == whole and len(pieces) > 2
            assert any(k == 0 for _, k, _ in secrets.findings(base64.b64encode(raw).decode())[1])


def _lines(raw, width, end="\n"):
    text = base64.b64encode(raw).decode()
    return end.join(text[k : k + width] for k in range(0, len(text), width))


LONG_SECRET = "notes about nothing, " * 9 + KEY + ", and more notes of the same kind " * 5


@pytest.mark.parametrize("width", [40, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\\n"])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_wrapped_base64(width, end, pack):
    rng = np.random.default_rng(width)
    noise = " ".join("%x" % x for x in rng.integers(0, 2**32, 60))  # keeps streams long
    for before in ("see:\n", "-----BEGIN DATA-----\n", "data: "):
        for k in range(0, 12, 4):
            text = before + _lines(pack((LONG_SECRET[k:] + noise).encode()), width, end) + "\nend"
            base, every, _ = secrets.findings(text)
            whole = [(a, b) for a, kind, b in every if kind == 0]
            place = 4 * LONG_SECRET[k:].index(KEY) // 3
            inner = base64.b64encode((LONG_SECRET[k:] + noise).encode()).decode()
            if pack((b"")) == b"":
                a = len(before) + place + place // width * len(end)
                z = -(-4 * (LONG_SECRET[k:].index(KEY) + len(KEY)) // 3)
                assert (a, len(before) + z + (z - 1) // width * len(end)) in whole and inner
            else:
                assert whole and all(len(before) <= a < b <= len(text) - 4 for a, b in whole)


@pytest.mark.parametrize("glue", ["id_", "a/b/", "x-", "abc+d/", "-_+/"])
@pytest.mark.parametrize("after", ["", "_id", "/", "-x+y", "A"])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_glued_base64(glue, after, pack):
    text = "see " + glue + base64.b64encode(pack(KEY.encode() + b" and so on; ")).decode().rstrip("=") + after + " end"
    found = [(a, b) for a, k, b in secrets.findings(text)[1] if k == 0]
    assert found and all(4 <= a < b <= len(text) - 4 for a, b in found)


B64 = lambda raw: base64.b64encode(raw).decode()
NOTE = f"notes, {KEY}, more notes"


@pytest.mark.parametrize("text", [
    B64(gzip.compress(gzip.compress(NOTE.encode()))), B64(bz2.compress(b"some text, " + gzip.compress(NOTE.encode()) + b" and more")), B64(lzma.compress(zlib.compress(gzip.compress(NOTE.encode())))),
    quote(gzip.compress(NOTE.encode()), safe=""), quote(gzip.compress(NOTE.encode())), "".join(f"\\x{b:02x}" for b in zlib.compress(NOTE.encode())), quote(bz2.compress(B64(NOTE.encode()).encode())),
    B64(gzip.compress(b"first") + gzip.compress(NOTE.encode())), _lines(gzip.compress(NOTE.encode() + bytes(range(256))), 40), B64(b"\x01" + NOTE.encode()), B64(NOTE.encode() + b"\x07 end"),
    B64(("\xe9t\xe9, " + NOTE).encode("latin-1")), B64(NOTE.encode("utf-16")), B64(NOTE.encode("utf-16-be")), B64(gzip.compress(NOTE.encode("utf-16-le"))), B64(b"\x78\x9cx^2 BZh91AY&SY\x1f\x8b\x08 " + NOTE.encode()),
    B64(gzip.compress(b"x^2 + BZh91AY&SY + \x1f\x8b\x08 " + NOTE.encode())), B64(gzip.compress(NOTE.encode())[:-9]), B64(b"\x78\x9c" + gzip.compress(NOTE.encode())), B64(("\u043a " * 9 + NOTE).encode()),
])
def test_bytes_hide_nothing(text):
    text = f"\u00e9 see: {text} end"
    found = [(a, b) for a, k, b in secrets.findings(text)[1] if k == 0]
    assert found and all(7 <= a < b <= len(text) - 4 for a, b in found)


def test_deep_nests_end():
    raw = NOTE.encode()
    for _ in range(120):
        raw = gzip.compress(raw)
    text = B64(raw)
    assert any(k == 0 for _, k, _ in secrets.findings(text)[1])
    assert secrets.findings("Q" * 5_000)[2] < 200 and secrets.findings("QUFB" * 2_000)[2] < 200


def test_layers_end():
    text = "%2525252541" + base64.b64encode(b"%41" * 30).decode() + " &amp;amp;lt; \\x5cu0041"
    assert secrets.findings(text)[2] < 60
    assert secrets.findings("password=a secret:token=abcdefghijkl")[0] == brute.secrets("password=a secret:token=abcdefghijkl")


def test_quality_rules(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in queries.op6_quality_rules(spark, SF).collect()}
    assert got == {d: brute.rules(t) for d, t in texts}


def test_quality_rules_catch_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality_rules(spark, sf).join(labels, "doc_id").filter("n_words >= 80 and not base_failed").select("kept", "quality").collect()
    good, junk = [r["kept"] for r in got if r["quality"]], [r["kept"] for r in got if not r["quality"]]
    assert all(good) and sum(junk) <= 0.1 * len(junk)


def test_distances_are_those_of_the_definition(spark):
    """Jensen-Shannon distances of character classes and common words, for each text by brute force over the same references."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    measured = quality_rules.measured(docs)
    refs = quality_rules.references(measured)

    def js(p, q):
        p, q = np.asarray(p, float), np.asarray(q, float)
        m = (p + q) / 2
        part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
        return np.sqrt(max(0.0, (part(p) + part(q)) / 2))

    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    classes = {r["id"]: r["classes"] for r in measured.collect()}
    seen = 0
    for r in quality_rules.judged(docs).collect():
        words = brute.TOKEN.findall(text[r["doc_id"]])
        if r["words_distance"] is not None:
            lower = [w.lower() for w in words]
            own = {lang: [lower.count(w) / len(words) for w in quality_rules.COMMON[lang]] for lang in refs}
            assert r["words_distance"] == pytest.approx(min(js([*x, max(0.0, 1 - sum(x))], refs[lang][1]) for lang, x in own.items()), abs=1e-6)
            seen += 1
        if r["class_distance"] is not None:
            n = len(text[r["doc_id"]])
            assert sum(classes[r["doc_id"]]) == n
            assert r["class_distance"] == pytest.approx(min(js([c / n for c in classes[r["doc_id"]]], ref[0]) for ref in refs.values()), abs=1e-6)
    assert seen > 200


def test_languages_without_a_reference_are_kept(spark, docs):
    odd = spark.createDataFrame([(10**6, "zq" + " ".join(f"wxq{i}zz" for i in range(200)), "xx", "a")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judged(docs.select("doc_id", "text", "lang", "source").unionByName(odd)).collect()}
    assert got[10**6]["kept"] and got[10**6]["words_distance"] is None


def test_fuzzy_notices_against_whole_texts(spark, texts):
    """The seeds lose nothing: every notice's pattern over the whole text finds no label that the search does not."""
    own = [licenses.Notice(*x) for x in licenses.NOTICES]
    rng = np.random.default_rng(5)
    some = [t for _, t in texts if len(t) < 1_200][:60]
    for k, t in enumerate(some):
        notice = licenses.NOTICES[k % len(licenses.NOTICES)][0]
        v = list(notice)
        for _ in range(rng.integers(0, len(v) // licenses.BYTES_PER_EDIT + 2)):
            v[rng.integers(0, len(v))] = "q"
        form = licenses.compared(f"{t} {''.join(v)} {t[:200]}".encode())
        for n in own:
            whole = n.first.search(form) is not None
            assert whole == bool(n.occurrences(form)), (n.text, "".join(v))


def test_licenses(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in queries.op7_licenses(spark, SF).collect()}
    assert got == {d: brute.licenses(t) for d, t in texts}


def test_fuzzy_notices():
    own = [licenses.Notice(t, label) for t, label in licenses.NOTICES]
    text = b"x y Licensd under the Apache Lisense, Version 2.0. And al rights reserved here, CC  BY!"
    found = licenses.notices_of(text, own)
    assert {(label, first) for label, first, *_ in found["fuzzy"]} >= {("apache", 2), ("reserved", 11)}
    assert found["base"]["cc-by"] == [15] and found["base"]["reserved"] == []
    assert not licenses.notices_of(b"the rights of all were reserved for the public and the general", own)["fuzzy"]


@pytest.mark.parametrize(("text", "label"), [
    ("under the terms of the GNU Genral Public License", "gpl"), ("General Public Lisense version 3", "gpl"), ("the GNU General Public Licence.", "gpl"), ("Generall Public License", "gpl"),
    ("Creative Comons Attribution 4.0", "cc-by"), ("a Creative Commons Atribution-ShareAlike license", "cc-by"), ("CC-BYSA 4.0", "cc-by"), ("All right reserved", "reserved"), ("Al Rights Reserved", "reserved"),
])
def test_misspelled_short_notices(text, label):
    found = licenses.notices_of(f"See here: {text} and so on".encode(), [licenses.Notice(*x) for x in licenses.NOTICES])
    assert not any(found["base"].values()) and label in {x[0] for x in found["fuzzy"]}


@pytest.mark.parametrize(("notice", "label"), [x for x in licenses.NOTICES if len(x[0]) >= licenses.BYTES_PER_EDIT])
def test_notices_with_one_edit_anywhere(notice, label):
    own = [licenses.Notice(*x) for x in licenses.NOTICES]
    for at in range(1, len(notice) - 1):
        if notice[at - 1 : at + 2].strip() != notice[at] and notice[at] != " ":  # a word of one letter would go as a whole
            for text in (notice[:at] + notice[at + 1 :], notice[:at] + "q" + notice[at + 1 :], notice[:at] + "q" + notice[at:]):
                assert label in {x[0] for x in licenses.notices_of(f"words {text} words".encode(), own)["fuzzy"]}


def test_token_codes(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "Word", "ÉTÉ", "x<|endoftext|>Y", " ", "\n", "'S", "<|endOfText|>.", "Ab,"]
    odd = [(2 * 10**6 + k, "".join(rng.choice(parts, 12))) for k in range(300)]
    odd = [*odd[:0], (10**6, "İstanbul ÉTÉ été, été. don't 😀 x y \x1c z ΣΑΣ 12345 <|endoftext|>word foo!, bar. a.b,c Ünï"), (10**6 + 1, None), (10**6 + 2, ""), *odd]
    rows_ = texts + odd
    start, want = 0, []
    for d, text in rows_:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    got = token_codes.coded(spark.createDataFrame(rows_, "doc_id long, text string").repartition(5), public_tokenizers.path("word_bpe_49k.json"))
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5_000])
def test_codes_round_trip_and_random_access(n):
    ids = np.random.default_rng(n).choice([0, 2, 255, 256, 49_407, 65_535, 65_536, 2**32 - 1], n).astype(np.uint32)
    codes = token_codes.Codes(token_codes.encode_ids(ids))
    assert np.array_equal(codes.all() if n else np.zeros(0, np.uint32), ids) and len(codes) == n
    assert [codes[i] for i in range(0, n, 37)] == ids[::37].tolist() == codes.take(np.arange(0, n, 37)).tolist()
    with pytest.raises(IndexError):
        codes[n]


def test_tokens_by_position(spark, docs, tmp_path):
    import public_tokenizers

    token_codes.write_codes(docs, str(tmp_path / "c"), public_tokenizers.path("word_bpe_49k.json"))
    segments = token_codes.read_codes(spark, str(tmp_path / "c"))
    every = np.concatenate([token_codes.Codes(r["payload"]).all() for r in segments.orderBy("start").collect()])
    wanted = spark.range(0, len(every) + 50, 97).select(F.col("id").alias("position"))
    got = rows(token_codes.tokens_at(segments, wanted), "position", "token")
    assert got == [(i, int(every[i])) for i in range(0, len(every), 97)]


def test_another_tokenizer(tmp_path):
    """One that keeps case and joins over spaces gets whole texts."""
    import json

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        made = json.load(f)
    made["normalizer"] = None
    made["pre_tokenizer"] = made["pre_tokenizer"]["pretokenizers"][1]
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    own, t = token_codes.WordIds(path), Tokenizer.from_file(path)
    texts = ["Some Words and  More", None, "été\n12"]
    ids, counts = own(pa.array(texts))
    assert not own.by_word and ids.tolist() == [i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]] and len(counts) == 3


def test_word_cache_forgets_and_stays_right(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "CACHED_WORDS", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = token_codes.WordIds(path), Tokenizer.from_file(path)
    for k in range(6):
        texts = [f"alpha beta gamma{k} delta{k}, été{k} word" + "abcdefghij"[k] + f" w{i}" for i in range(12)]
        ids, counts = own(pa.array(texts))
        assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]] and counts.sum() == len(ids)


def test_simhash(spark, texts):
    prints = [brute.fingerprint(t) for _, t in texts]
    want = [(d, format(p, "016x"), c) for (d, _), p, c in zip(texts, prints, brute.components(prints, [d for d, _ in texts]))]
    assert rows(queries.op9_simhash(spark, SF), "doc_id", "fingerprint", "component_id") == want


def test_simhash_links_in_hot_variants(spark):
    """Fingerprints that crowd in a few variants, in blocks of eight: no link is lost."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 2**63, 50)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {}
    for p, c in zip(prints, brute.components(prints, prints)):
        want.setdefault(c, set()).add(p)
    for block in (8, 4096):
        got = {}
        for r in simhash.fingerprint_roots(df, block=block).collect():
            got.setdefault(r["root"], set()).add(r["fp"] % 2**64)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_lane_links_in_a_crowd(spark):
    """Three families of lanes that all meet in one variant with close fp: a seed of another family loses no link, in blocks or not."""
    rng = np.random.default_rng(11)
    flipped = lambda x, n, low=0: x ^ sum(1 << int(b) for b in rng.choice(np.arange(low, 64), n, replace=False))
    base, segment = int(rng.integers(0, 2**63)), int(rng.integers(0, 2**21))
    families = [[int(rng.integers(0, 2**43)) << 21 | segment, *(int(x) for x in rng.integers(0, 2**63, 3))] for _ in range(3)]
    prints = {}
    while len(prints) < 90:
        lanes = families[len(prints) % 3]
        prints.setdefault(flipped(base, int(rng.integers(1, 8))), [flipped(lanes[0], int(rng.integers(0, 4)), 21), *(flipped(x, int(rng.integers(0, 4))) for x in lanes[1:])])
    edges = [0, 21, 42, 64]

    def linked(a, b):
        x = [p ^ q for p, q in zip(prints[a], prints[b])]
        meet = any((v >> s & (1 << e - s) - 1).bit_count() <= 1 for v in x for s, e in zip(edges, edges[1:]))
        return meet and (a ^ b).bit_count() <= simhash.LANE_REACH and sum(v.bit_count() for v in x) <= int(simhash.MOST_DIFFERENT * 256)

    left, want = set(prints), []
    while left:
        found, queue = set(), [left.pop()]
        while queue:
            a = queue.pop()
            found.add(a)
            near = {b for b in left if linked(a, b)}
            left -= near
            queue += near
        want.append(sorted(found))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([tuple(map(signed, (p, *lanes))) for p, lanes in prints.items()], "fp long, fp1 long, fp2 long, fp3 long, fp4 long")
    assert sorted(map(len, want))[-3:] == [30, 30, 30]
    for block in (8, 4096):
        got = {}
        for r in simhash.lane_roots(df, 4, block=block).collect():
            got.setdefault(r["root"], []).append(r["fp"] % 2**64)
        assert sorted(map(sorted, got.values())) == sorted(want)


def test_strangers_change_no_link(spark):
    """Scenes of a, a near copy c and a stranger b that meets both in a segment and is close by fp alone: a and c are one group, b is
    alone, however rows are dealt and blocks are cut."""
    rng = np.random.default_rng(7)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    some = lambda n: [int(x) for x in rng.integers(0, 2**63, n)]
    rows_, want = [], []
    for _ in range(60):
        fp, a, b = some(1)[0], some(simhash.LANES), some(simhash.LANES)
        c = [flip(x, int(rng.integers(0, 6))) for x in a]
        c[0] = a[0] ^ 1
        b[0] = a[0] & ((1 << 21) - 1) | b[0] >> 21 << 21
        prints = [fp, flip(fp, 6), flip(fp, 3)]
        rows_ += [(prints[0], *a), (prints[1], *c), (prints[2], *b)]
        want += [sorted(prints[:2]), [prints[2]]]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    names = ", ".join(f"fp{k or ''} long" for k in range(simhash.LANES + 1))
    df = spark.createDataFrame([tuple(map(signed, r)) for r in rows_], names)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, block in ((1, 4096), (32, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {}
            for r in simhash.lane_roots(df, simhash.LANES, block=block).collect():
                got.setdefault(r["root"], []).append(r["fp"] % 2**64)
            assert sorted(map(sorted, got.values())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_near_copies_of_the_stage(spark, docs):
    """Pairs of each similarity from 0.8 up, by their five-word shingles, are found in nine of ten cases at least; below 0.6 none is."""
    own = [r["text"].split()[:240] for r in docs.filter("n_chars > 1800").select("text").distinct().orderBy("text").limit(40).collect()]
    rng = np.random.default_rng(3)
    rows_, bands = [], {}
    for n_changed in (1, 3, 4, 5, 16):
        for i, w in enumerate(own):
            v = list(w)
            for j in rng.choice(len(v), n_changed, replace=False):
                v[j] = f"changed{i}{j}"
            a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
            similar = len(a & b) / len(a | b)
            at = 1000 * n_changed + i
            if similar < 0.6 and len(a) < len(w) - 4:
                continue  # a passage that the text repeats counts as often as it stands in a fingerprint, but once in a set
            rows_ += [(2 * at, f"start{at} " + " ".join(w)), (2 * at + 1, f"start{at} " + " ".join(v))]
            bands.setdefault("far" if similar < 0.6 else "near" if similar >= 0.9 else "0.8" if similar >= 0.8 else "between", []).append(at)
    # each pair by itself, as texts of one origin would link over others
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    prints = simhash.with_fingerprints(df, "text", 5, simhash.LANES + 1)
    paired = {}
    for r in prints.collect():
        paired.setdefault(r["doc_id"] // 2, []).append(tuple(r[f"fp{k or ''}"] for k in range(simhash.LANES + 1)))
    found = {}
    for name, ats in bands.items():
        rows_ = [p for at in ats for p in paired[at]]
        both = spark.createDataFrame(list(dict.fromkeys(rows_)), ", ".join(f"fp{k or ''} long" for k in range(simhash.LANES + 1)))
        root = {r["fp"]: r["root"] for r in simhash.lane_roots(both, simhash.LANES).collect()}
        found[name] = np.mean([root[paired[at][0][0]] == root[paired[at][1][0]] for at in ats])
    assert len(bands["0.8"]) > 30 and len(bands["far"]) > 20 and found["0.8"] >= 0.9 and found["near"] >= 0.98 and found["far"] <= 0.1, found


def test_mixing(spark):
    SF = "/root/testdata/sf0.01"
    docs, got = spark.read.parquet(f"{SF}/documents.parquet"), queries.op10_mixing(spark, SF)
    source = {r["doc_id"]: (r["source"], len(brute.TOKEN.findall(r["text"] or ""))) for r in docs.collect()}
    sizes = {}
    for s in sorted({s for s, _ in source.values()}):
        sizes[s] = sum(n for t, n in source.values() if t == s)
    aims, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    again = {(r["doc_id"], r["taken"]) for r in queries.op10_mixing(spark, SF).collect()}
    for r in got.collect():
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[s] and r["target"] == pytest.approx(aims[s]) and r["taken"] <= 2 * n and (r["doc_id"], r["taken"]) in again
        taken[s] += r["taken"]
    assert all(abs(taken[s] - aims[s]) <= max(30, 0.02 * aims[s]) for s in sizes), {s: (taken[s], aims[s]) for s in sizes if abs(taken[s] - aims[s]) > 0.02 * aims[s]}


def test_mixing_ranks_in_blocks(spark, docs):
    """A hot cell in many blocks gives the same numbers of copies as in one."""
    rows_ = docs.select("doc_id", "text", "source").unionByName(spark.range(5_000, 8_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("src1").alias("source")))
    counts = lambda b: sorted((r["size"], r["copies"], r["n"]) for r in mixing.mixture(rows_, block_rows=b).groupBy("size", "copies").agg(F.count("*").alias("n")).collect())
    assert counts(50) == counts(100_000)


def test_entropy_balance_tilts(spark, docs):
    """Within a source that is not full, larger documents have larger rates where more is wanted, and smaller ones where less is."""
    got = mixing.mixture(docs).filter("size > 0").groupBy("source_size", "target").agg(F.covar_pop("size", "rate").alias("c"), F.count_distinct("rate").alias("k")).filter("k > 1").collect()
    assert got and all((r["c"] > 0) == (r["target"] > r["source_size"]) for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = corpus_pipeline.read_table(spark, sf, "documents")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas())
        made[name] = docs.toPandas()
        assert docs.columns == columns + (["shard_id"] if name == "sharding" else [])
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = made["quality_classifier"]
    judged = kept[kept.doc_id.isin(labels.index)]
    assert (labels[judged.doc_id] == 1).mean() > 0.99 and len(kept) > 800
    assert made["simhash_near_dedup"].doc_id.is_unique and set(made["simhash_near_dedup"].doc_id) <= set(kept.doc_id)
    assert len(set(made["simhash_near_dedup"].text)) == len(made["simhash_near_dedup"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, *_, x in brute.contamination(made["simhash_near_dedup"][["doc_id", "text"]].itertuples(index=False), items) if x}
    assert hit and set(made["benchmark_decontamination"].doc_id) == set(made["simhash_near_dedup"].doc_id) - hit
    assert made["mixing"].doc_id.value_counts().max() == 2 and len(made["sharding"]) == len(made["mixing"])
    whole = corpus_pipeline.run(spark, sf).toPandas()
    order = ["doc_id", "shard_id"]
    assert whole.sort_values(order)[order].reset_index(drop=True).equals(made["sharding"].sort_values(order)[order].reset_index(drop=True))
