"""Radar rasters: GeoTIFF files of one band as tables of their blocks, read and written.

`tiles` is a Spark data source. Its partitions are ranges of bytes of the files, and a partition reads the blocks that begin in its range, as
they are needed: those outside the window that is asked for are skipped, and without the pixels no block is read at all. A file or a block that
can't be read gives a row with its error and nulls, so that no download fails a job. Files are opened by Arrow's file systems, which know
local paths and the addresses of stores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from galewise.sources import geotiff
from galewise.sources.shared import new_path

_TRANSFORM = "transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, crs int"
#: A block of a raster: its number, its first row and column, its size, and its pixels row by row (none where they are not asked for).
SCHEMA = f"path string, block int, row int, col int, high int, wide int, band array<double>, rows int, cols int, {_TRANSFORM}, error string"
_ARROW = pa.schema([
    ("path", pa.string()), ("block", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("high", pa.int32()), ("wide", pa.int32()), ("band", pa.list_(pa.float64())), ("rows", pa.int32()), ("cols", pa.int32()),
    ("transform", pa.struct([(c, pa.float64()) for c in "abcdef"])), ("crs", pa.int32()), ("error", pa.string()),
])
#: Bytes of a file that one task reads.
SPLIT = 32 << 20


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{f.name: values.get(f.name) for f in _ARROW}], schema=_ARROW)


def _pixels(band: np.ndarray) -> pa.Array:
    """One list of all pixels, out of their buffer."""
    return pa.ListArray.from_arrays(pa.array([0, band.size], pa.int32()), pa.array(band.astype(np.float64).ravel()))


class _Files(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int]]) -> None:
        self.parts = parts


class _TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.window = [int(x) for x in options["window"].split(",")] if options.get("window") else None
        self.pixels = options.get("pixels", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(root)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if found.type == fs.FileType.Directory else [found]
        parts, own, size = [], [], 0
        for info in sorted((x for x in infos if x.type == fs.FileType.File and x.path.lower().endswith((".tif", ".tiff"))), key=lambda x: x.path):
            for at in range(0, max(1, info.size), self.split):
                part = min(self.split, info.size - at)
                if own and size + part > self.split:  # small files share a task
                    parts.append(_Files(own))
                    own, size = [], 0
                own.append((info.path, at, at + part))
                size += part + 4096
        return [*parts, _Files(own)] if own else parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for path, first, last in partition.parts if partition else ():
            try:
                with store.open_input_file(path) as f:
                    yield from self._blocks(path, lambda at, n, f=f: f.read_at(n, at), first, last)
            except Exception as e:  # whatever is wrong with a file, the others are read
                if first == 0:
                    yield _row(path=path, error=f"{type(e).__name__}: {e}")

    def _blocks(self, path: str, read, first: int, last: int) -> Iterator[pa.RecordBatch]:
        h = geotiff.header(read)
        for k, (start, size) in enumerate(h.blocks):
            if not first <= start < last:
                continue
            y, x, high, wide = h.place(k)
            if self.window and not (y < self.window[1] and y + high > self.window[0] and x < self.window[3] and x + wide > self.window[2]):
                continue
            own = {"path": path, "block": k, "row": y, "col": x, "high": high, "wide": wide, "rows": h.rows, "cols": h.cols, "transform": h.transform, "crs": h.crs}
            if not self.pixels:
                yield _row(**own)
                continue
            try:
                band = geotiff.block(h, k, read(start, size))
            except Exception as e:
                yield _row(**own, error=f"{type(e).__name__}: {e}")
                continue
            batch = _row(**own)
            yield batch.set_column(6, _ARROW.field("band"), _pixels(band))


class TileSource(DataSource):
    """spark.read.format("tiles"): options path, window (first row, row after the last, first column, column after the last), pixels (false:
    headers only) and split (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TileReader(self.options)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, pixels: bool = True, split: int = SPLIT) -> DataFrame:
    """A row for each block of each .tif file below a path; see the module."""
    spark.dataSource.register(TileSource)
    reader = spark.read.format("tiles").option("path", path).option("pixels", str(pixels).lower()).option("split", split)
    return (reader.option("window", ",".join(map(str, window))) if window else reader).load()


def read_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rows, cols, transform, crs, error): what the files say, a row each, and no pixels."""
    tiles = read_tiles(spark, folder, pixels=False)
    return tiles.groupBy("path").agg(*[F.first(c).alias(c) for c in ("rows", "cols", "transform", "crs", "error")])


def resolution(transform: Column) -> Column:
    """Ground size of a pixel."""
    return transform["a"]


def pixels_of(tiles: DataFrame) -> DataFrame:
    """(path, row, col, value) of the blocks that could be read."""
    own = tiles.filter("error is null").select("path", "row", "col", "wide", F.posexplode("band").alias("at", "value"))
    return own.select("path", (F.col("row") + F.floor(F.col("at") / F.col("wide"))).cast("int").alias("row"), (F.col("col") + F.col("at") % F.col("wide")).cast("int").alias("col"), "value")


def write_rasters(rasters: DataFrame, folder: str, kind: str = "int16", tile: int = 256) -> DataFrame:
    """Write rasters (name, rows, cols, band, transform, crs) as GeoTIFF files of LZW tiles with horizontal differences, name.tif each, and give
    (name, bytes, error), after they have been written. Each file is written aside and moved, so that a task that runs again does no harm."""

    def run(batches):
        for batch in batches:
            sizes, errors = [], []
            bands = batch.column(3)
            for k, (name, rows, cols) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                try:
                    band = bands[k].values.to_numpy(zero_copy_only=False).reshape(rows, cols)
                    band = np.rint(band).astype(kind) if np.dtype(kind).kind in "ui" else band.astype(kind)
                    raw = geotiff.encoded(band, batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), tile)
                    _put(folder, f"{name}.tif", raw)
                    sizes.append(len(raw))
                    errors.append(None)
                except Exception as e:  # a raster that can't be written is a row with its error
                    sizes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["name", "bytes", "error"])

    given = rasters.select(F.col("name").cast("string").alias("name"), "rows", "cols", "band", "transform", F.col("crs").cast("int").alias("crs"))
    return _done(given.mapInArrow(run, "name string, bytes long, error string"))


def recompressed(spark: SparkSession, source: str, folder: str, tile: int = 256) -> DataFrame:
    """Copy every raster of a path re-compressed, as write_rasters does, with the same pixels, kinds and transforms: (path, before, bytes,
    error) after they have been written. A task takes whole files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").option("recursiveFileLookup", True).load(source).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = {"path": path, "before": len(content), "bytes": None, "error": None}
                try:
                    h = geotiff.header(lambda at, n, c=content: c[at : at + n])
                    band = np.zeros((h.rows, h.cols), dtype=h.kind)
                    for k, (start, size) in enumerate(h.blocks):
                        y, x, high, wide = h.place(k)
                        part = geotiff.block(h, k, content[start : start + size])
                        band[y : y + len(part), x : x + wide] = part
                    new = geotiff.encoded(band, h.transform, h.crs, tile)
                    _put(folder, path.rsplit("/", 1)[-1], new)
                    row["bytes"] = len(new)
                except Exception as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("before", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())]))

    return _done(raw.mapInArrow(run, "path string, before long, bytes long, error string"))


def _put(folder: str, name: str, raw: bytes) -> None:
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    aside = f"{root}/.{name}.{np.random.default_rng().integers(1 << 62)}"
    with store.open_output_stream(aside) as f:
        f.write(raw)
    store.move(aside, f"{root}/{name}")


def _done(report: DataFrame) -> DataFrame:
    """The report, written, so that its files are there and are not written again when it is read."""
    path = new_path(report.sparkSession, "written-rasters")
    report.write.parquet(path)
    return report.sparkSession.read.schema(report.schema).parquet(path)
