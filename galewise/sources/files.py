"""Obstacle, result and frame files. A scene is a folder of one file for each time key; tables are partitioned by scene."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galewise.functions import wkt

SHAPES = ("geometry", "buffer", "convex", "concave")


def _key_of(path: Column) -> Column:
    """The time key of a file: of its folder where Spark has written it (time_key=...), else the file's name up to its first point."""
    folder = F.regexp_extract(path, "/time_key=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "^([^.]*)", 1))


def read_obstacles(spark: SparkSession, folder: str, time_keys: list[str] | None = None) -> DataFrame:
    """(time_key, obstacle_id, geometry, buffer, convex, concave) of CSV files whose names, or whose folders' names, are time keys, in one
    scan; every shape column is well-known text. A missing shape is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("recursiveFileLookup", True).csv(folder, schema=", ".join(f"{c} string" for c in SHAPES), enforceSchema=False, pathGlobFilter="*.csv")
    rows = rows.withColumn("time_key", _key_of(F.col("_metadata.file_path")))
    if time_keys is not None:
        rows = rows.filter(F.col("time_key").isin(time_keys))
    return rows.select("time_key", F.monotonically_increasing_id().alias("obstacle_id"), *[wkt.polygons(F.col(c)).alias(c) for c in SHAPES])


def write_obstacles(obstacles: DataFrame, folder: str) -> None:
    """The shapes as well-known text, a folder for each time key; what a time key has is replaced, others stay."""
    text = obstacles.select("time_key", *[wkt.multipolygon_text(F.col(c)).alias(c) for c in SHAPES])
    text.repartition("time_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("time_key").option("header", True).csv(folder)


def time_keys(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """Time keys of a folder's files, in order; no file is read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder).select(_key_of(F.col("path")).alias("time_key"))
    return names.distinct().orderBy("time_key")


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """(file, index, frames) of the five-dimensional .npy files of a folder: each item a list of flat frames. Objects are never unpickled."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = np.load(io.BytesIO(content), allow_pickle=False)
                if items.ndim != 5:
                    continue
                for i in range(len(items)):
                    frames = items[i].reshape(items.shape[1], -1).astype(np.int16).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([frames], pa.list_(pa.list_(pa.int16())))], names=["file", "index", "frames"])

    return raw.mapInArrow(run, "file string, index long, frames array<array<smallint>>")


def read_results(spark: SparkSession, sources: dict[str, str]) -> DataFrame | None:
    """The result tables that are there, each with its algorithm's name; missing ones are left out."""
    out = None
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, path in sources.items():
        at = fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            continue
        rows = spark.read.parquet(path).withColumn("algorithm", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def append_results(results: DataFrame, path: str) -> None:
    """Results by timestamp; what a timestamp has is replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timestamp").parquet(path)


def write_months(rows: DataFrame, path: str, ts: str = "hour") -> None:
    """Rows by month; what a month has is replaced, so that a rerun of a month doesn't double it, and others stay."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_static_results(results: DataFrame, path: str) -> None:
    """Static routes as CSV by timestamp, paths as well-known text; what a timestamp has is replaced."""
    results.withColumn("paths", wkt.line_text(F.col("paths"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timestamp").option("header", True).csv(path)


def read_static_results(spark: SparkSession, path: str) -> DataFrame:
    """All timestamps of write_static_results together."""
    rows = spark.read.option("header", True).csv(path, schema="strategy string, paths string, length double, timestamp string")
    return rows.select("timestamp", "strategy", wkt.line(F.col("paths")).alias("paths"), "length")


def save_progress(days: DataFrame, path: str, day: str = "day") -> None:
    """Append the last day that is done, as its last five-minute slot; each call adds one row."""
    last = days.agg(F.max(F.to_date(day)).alias("day")).filter("day is not null")
    last.select((F.col("day").cast("timestamp_ntz") + F.expr("interval 23 hours 55 minutes")).alias("done")).coalesce(1).write.mode("append").parquet(path)


def load_progress(spark: SparkSession, path: str, first) -> DataFrame:
    """One row with `done`: the latest progress, or `first` where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema("done timestamp_ntz").parquet(path) if there else spark.createDataFrame([], "done timestamp_ntz")
    return rows.agg(F.coalesce(F.max("done"), F.lit(first).cast("timestamp_ntz")).alias("done"))
