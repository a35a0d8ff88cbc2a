"""Tables in the folder that driver and executors share: they cut the lineage, and a lost executor costs no recomputation.

All tables of an application stand in one folder of its own, which is removed when the driver's Python ends; what no later
plan reads can be removed before by drop_path.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. On one machine, where it is unset, a folder of our own; on a cluster that is an error, as each executor
    would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="galewise-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _delete_at_exit(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        _delete(jvm, conf, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in this application's folder."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark)}/galewise/{sc.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete_at_exit, sc._jvm, sc._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table of written() that no later plan reads."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
