"""A training corpus out of `documents`: quality, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of docs. Stages work on whatever their predecessor kept. As docs are always a
table that has been written, a stage first removes the scratch tables of those before it.

In every stage a null text counts as empty, texts of any length count whole, ties go by id and then by a hash or the order of rows,
an empty table gives an empty table, and other columns come along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galewise.llm import decontamination, mixing, quality, sharding, simhash
from galewise.llm.common import drop_scratch, read_table, scratch, written

#: Near-duplicates of the pipeline: shingles of five words, similar by about 0.8 or more.
SHINGLE = 5
#: Scratch tables that the last stage left for its plan.
_left: list[str] = []


def _staged(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What build plans, after the scratch tables of the stage before are gone; those of other queries stay."""
    drop_scratch(spark, _left)
    before = set(scratch())
    out = build()
    _left[:] = [path for path in scratch() if path not in before]
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier's rejects go. Null and empty texts are judged by having no words; of repeated rows all stay or all go."""
    return _staged(spark, lambda: quality.selected(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id, nulls last. Null and empty texts are copies of each other, repeated
    rows too."""
    return _staged(spark, lambda: simhash.deduplicated(docs, words_per_shingle=SHINGLE))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go. Null and empty texts stay; an empty benchmark takes nothing."""
    return _staged(spark, lambda: decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out, so that sources meet their target weights. Null and empty texts stay once; a null source is one of its
    own; repeated rows are documents of their own."""
    return _staged(spark, lambda: mixing.mixed(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets its shard, as the column shard_id. Repeated rows share one, or its pages beyond the limit."""
    return _staged(spark, lambda: sharding.with_shards(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: SQL has no classifier, no XXH64 and no Newton iterations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    _left.clear()  # what an earlier run has returned may not have been read yet
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs, _ = written(docs, name, keep=True)
    return docs
