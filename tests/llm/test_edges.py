"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and columns of clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

from galewise.llm import decontamination, learning, licenses, mixing, quality, quality_rules, secrets, sharding, simhash, token_codes, toxicity

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "xx", None, 4), (None, "some text of no document", "en", "a", 10), (None, None, None, None, None),
    (4, "the same row", "en", "b", 12), (4, "the same row", "en", "b", 12), (4, "another row of this id", "de", "b", 12), (5, LONG, "en", "a", len(LONG)),
    (6, "İstanbul été \U0001f600   x y \x1c z", "fr", "\U0001f600", 9), (7, "%41%zz \\u0041 \\ud800 " + "Zm9v" * 9, "es", "￿", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = ("fp", "_fp", "_row", "score", "kept", "size", "key", "n", "h", "row", "id", "_doc", "_hit", "_items", "_n_words", "copies", "depth", "shard", "bytes", "features", "label", "_tail", "_expected", "rate", "block", "part", "a.b", "doc_id.x", "_key", "_size", "first")
BENCH = [(1, "some text of no document"), (2, None), (None, "the same row"), (3, "")]


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(2, 7)] + [(None, 1, 1), (4, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1))


OPERATORS = {
    "contamination": lambda d, b, la: decontamination.contamination(d, b),
    "shards": lambda d, b, la: sharding.shards(d, limit=1_000),
    "graded": lambda d, b, la: quality.graded(d, la),
    "toxicity": lambda d, b, la: toxicity.toxicity(d, la),
    "secrets": lambda d, b, la: secrets.secrets(d),
    "judged": lambda d, b, la: quality_rules.judged(d),
    "licenses": lambda d, b, la: licenses.licenses(d),
    "coded": lambda d, b, la: token_codes.coded(d, tokenizer()),
    "near_duplicates": lambda d, b, la: simhash.near_duplicates(d),
    "mixture": lambda d, b, la: mixing.mixture(d),
}
STAGES = {
    "selected": lambda d, b, la: quality.selected(d, la, keep_from=0.0),
    "deduplicated": lambda d, b, la: simhash.deduplicated(d),
    "decontaminated": lambda d, b, la: decontamination.decontaminated(d, b),
    "mixed": lambda d, b, la: mixing.mixed(d),
    "with_shards": lambda d, b, la: sharding.with_shards(d, limit=1_000),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, bench, labels):
    out = OPERATORS[name](docs, bench, labels)
    assert "doc_id" in out.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, spark, docs, bench, labels):
    assert OPERATORS[name](docs.limit(0), bench, labels).count() == 0
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), bench.limit(0), labels.limit(0)).count() == 0
    assert OPERATORS[name](docs.filter("doc_id < 4"), bench.limit(0), labels.limit(0)).count() == 3


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(name, docs, bench, labels):
    out = STAGES[name](docs, bench, labels)
    assert out.columns == docs.columns + (["shard_id"] if name == "with_shards" else [])
    rows = out.collect()
    assert rows and all(r["fp"] == "own fp" and r["size"] == "own size" for r in rows)
    assert STAGES[name](docs.limit(0), bench, labels).count() == 0


def test_what_is_contaminated(docs, bench):
    out = {(r["doc_id"], r["n_words"]): r for r in decontamination.contamination(docs, bench).collect()}
    assert out[None, 5]["contaminated"] and out[None, 5]["items"] == ["1"]
    assert out[4, 3]["items"] == [""] and out[4, 5]["n_hit"] == 0
    assert decontamination.decontaminated(docs, bench).filter("doc_id = 4").count() == 1


def test_null_and_empty_texts_are_copies(docs):
    out = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert out[1, "0" * 16] == out[2, "0" * 16] == out[3, "0" * 16] == out[None, "0" * 16] == 1
    left = simhash.deduplicated(docs).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "4", "4", "5", "6", "7", "None"]


def test_no_shard_is_over_its_limit(docs):
    out = sharding.shards(docs, limit=1_000).collect()
    per = {}
    for r in out:
        per.setdefault(r["shard_id"], []).append(r["n_bytes"])
    assert all(sum(x) <= 1_000 or len(x) == 1 for x in per.values())
    assert any(sum(x) > 1_000 for x in per.values())


def test_equal_hashes_overflow_to_pages(spark):
    rows = spark.createDataFrame([(1, "x" * 100)] * 25 + [(i, "y" * 100) for i in range(2, 40)], "doc_id long, text string").repartition(3)
    per = {}
    for r in sharding.shards(rows, limit=1_000).collect():
        per.setdefault(r["shard_id"], []).append((r["doc_id"], r["n_bytes"]))
    assert all(sum(b for _, b in x) <= 1_000 for x in per.values())
    assert sorted(len(x) for k, x in per.items() if "." in k) == [5, 10, 10]


def test_mixing_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "x y z", "b")], "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in mixing.mixture(rows).collect()}
    assert out[1]["taken"] == 0 and out[1]["target"] == 0 and out[3]["taken"] in (3, 6) and out[3]["target"] == 4.5
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mixture(none).first()["taken"] == 0


def test_equal_rows_are_dealt_out(spark):
    """Nine thousand equal rows beside others: as many copies as in one block, and no task ranks them all."""
    rows = spark.createDataFrame([(1, "one two three", "a")] * 9_000 + [(i, "four five six", "a") for i in range(2, 3_000)] + [(9, "x " * 40, "b")], "doc_id long, text string, source string")
    counts = lambda b: sorted(tuple(r) for r in mixing.mixture(rows, block_rows=b).groupBy("size", "copies").count().collect())
    assert counts(500) == counts(100_000)
    assert sorted(r["n"] for r in mixing.mixture(rows, block_rows=500).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()) == sorted(r["n"] for r in mixing.mixture(rows.repartition(7), block_rows=500).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect())


def test_an_unsolved_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    rows = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="dual"):
        mixing.mixture(rows)


def test_one_row_an_id_is_learned_from(spark):
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = spark.createDataFrame([(a, f"text {i % 5}") for i in range(50)] + [(b, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, 0), (a, 1), (b, 1)], "doc_id long, toxic int")
    got = [tuple(r) for r in learning.labelled_sample(rows, labels, "toxic", 10).collect()]
    assert len(got) == 2 and all(label == 1 for _, label in got)


def test_one_grade_alone(spark, docs):
    same = spark.createDataFrame([(i, 1) for i in range(1, 8)], "doc_id long, quality int")
    assert {r["expected_grade"] for r in quality.graded(docs, same).collect()} == {1.0}
