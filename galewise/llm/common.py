"""What the corpus operators share: byte tables, Arrow helpers and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galewise.sources import shared
from galewise.sources.shared import drop_path, new_path

__all__ = ["BATCH_ROWS", "LOWER", "LOWER_WORDS", "SPACES", "SPACE_CLASS", "drop_path", "drop_scratch", "fresh", "mapped_with", "native_word_count", "new_path", "per_batch", "read_table", "scratch", "sliced", "strings_of", "texts_of", "written"]

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; bytes outside [0-9a-z\x80-\xFF] to a space, so that split() gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
LOWER_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: White space as the contracts know it; bytes.split() cuts at the same six bytes.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: Rows that a worker takes at once.
BATCH_ROWS = 512

_scratch: list[str] = []


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. A lost executor costs no recomputation. Unless it is
    to be kept, drop_scratch removes it."""
    out, path = shared.written(df, name)
    if not keep:
        _scratch.append(path)
    return out, path


def scratch() -> list[str]:
    """Tables of written() that are there to be read by plans not run yet."""
    return list(_scratch)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Remove such tables: for callers that know that whatever was planned on them has been written."""
    for path in paths:
        if path in _scratch:
            _scratch.remove(path)
            drop_path(spark, path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, at most `rows` at once: what a worker makes of long texts is far larger than they are. The session's own bounds
    on batches, of rows and of bytes, stay as they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function out of one for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = f(batch)
            if out is not None:
                yield out

    return run


def mapped_with(docs: DataFrame, run, added: list[T.StructField]) -> DataFrame:
    """docs and further columns that the mapInArrow function `run` adds. Columns go by plain names meanwhile: mapInArrow knows none with a
    point in it."""
    plain = [f"_c{k}" for k in range(len(docs.columns))]
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)], *added])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, *[f.name for f in added])


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def native_word_count(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text column, null counting 0, without Python."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_CLASS + "+"))).cast("long")
