"""Tables written once in the folder that driver and executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000

#: Whether Spark deletes a query's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where that may be unset,
    a temporary folder; on a cluster without the setting this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc = spark.sparkContext
    if sc not in _local_dirs:
        _local_dirs[sc] = "file://" + tempfile.mkdtemp(prefix="recollex-")
    return _local_dirs[sc]


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later stages survive lost executors and scan
    only the columns they need. The files go when the driver's JVM ends, or when `discard` is called; the shuffle files
    of the writing go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollex-{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `staged` returned and that nothing will read again."""
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            where, fs = _path(t.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
