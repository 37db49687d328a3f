"""Sinks: snapshots that replace a table at once, appends, bounded logs, references, exports."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.operators import security
from recollex.sources import commits


def _path(spark: SparkSession, p: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Locked(RuntimeError):
    """The table was written too often."""


def check_rate(spark: SparkSession, table: str, now: float | None = None, limit: int = K.BURST_LIMIT, seconds: int = K.BURST_SECONDS) -> None:
    """Counts a write of a table; more than limit of them within seconds raise. The log of times is one small file."""
    log, fs = _path(spark, f"{table}/WRITES")
    now = time.time() if now is None else now
    times = [float(x) for x in spark.read.text(f"{table}/WRITES").head(limit + 1)[0][0].split()] if fs.exists(log) else []
    times = [t for t in times if t > now - seconds] + [now]
    _put(spark, f"{table}/WRITES", " ".join(map(str, times[-limit - 1 :])))
    if len(times) > limit:
        raise Locked(f"{table}: {len(times)} writes in {seconds} s")


def _put(spark: SparkSession, file: str, content: str) -> None:
    """A small file replaced at once: readers find the old content or the new one, never none."""
    jvm = spark.sparkContext._jvm
    new, fs = _path(spark, f"{file}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(content.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(rename, 1)
    overwrite[0] = rename.OVERWRITE
    target, _ = _path(spark, file)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, target, overwrite)


def write_snapshot(df: DataFrame, table: str, guard: bool = True) -> int:
    """Replaces the table's rows by df's in one commit: readers see the old rows or the new ones, and a table may be
    rewritten from itself. Guarded by the rate of writes. Returns the version."""
    if guard:
        check_rate(df.sparkSession, table)
    return commits.write(df, table, "overwrite")


def read_snapshot(spark: SparkSession, table: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The table's rows, at a version if one is given; with a schema, a table that isn't there is empty."""
    return commits.read(spark, table, version, schema)


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").parquet(table)


def append_bounded(df: DataFrame, table: str, order: list[Column], n: int) -> None:
    """Adds rows to a log of which the newest n stay; writers at the same time lose nothing."""
    kind = df.schema.simpleString().removeprefix("struct<").removesuffix(">")
    commits.update(df.sparkSession, table, lambda rows: rows.select(*df.columns).unionByName(df).orderBy(*order).limit(n), schema=kind)


def save_refs(sections: DataFrame, table: str) -> DataFrame:
    """name, ref_id, content, created of texts (name, content) before they are cut; appended."""
    refs = sections.select("name", F.substring(F.sha2("name", 256), 1, 16).alias("ref_id"), "content", F.current_timestamp().alias("created"))
    append(refs, table)
    return refs


def ref_id(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:16]


def list_refs(spark: SparkSession, table: str) -> DataFrame:
    """ref_id, created of the references, each once."""
    return spark.read.parquet(table).groupBy("ref_id").agg(F.max("created").alias("created"))


def read_ref(spark: SparkSession, table: str, name: str) -> str | None:
    """The newest content of a reference; null if there is none."""
    row = spark.read.parquet(table).where(F.col("ref_id") == ref_id(name)).orderBy(F.desc("created")).select("content").head()
    return row and row[0]


def delete_refs(spark: SparkSession, table: str, names: list[str], to: str, older_than: Column | None = None) -> None:
    """A snapshot `to` of the references without those of some names, and without those created before a time."""
    keep = spark.read.parquet(table).where(~F.col("ref_id").isin(*map(ref_id, names)) if names else F.lit(True))
    write_snapshot(keep.where(F.col("created") >= older_than) if older_than is not None else keep, to)


def send_alert(spark: SparkSession, table: str, alerts: DataFrame, keep: int = 50, channel=None) -> None:
    """Adds alerts (title, body) to a log of the newest `keep`; a channel, any function of title and body, gets each."""
    append_bounded(alerts.select(F.current_timestamp().alias("at"), "title", "body"), table, [F.desc("at"), "title"], keep)
    if channel is not None:
        for r in alerts.toLocalIterator():  # an alert for each check
            channel(r["title"], r["body"])


def write_encrypted(df: DataFrame, path: str, key: bytes) -> None:
    """Rows as encrypted JSON lines."""
    df.select(security.encrypt(F.to_json(F.struct(*df.columns)), key).alias("value")).write.text(path)


def daily_backup(df: DataFrame, folder: str, day: str, keep: int = 3) -> bool:
    """One copy a day under dt=<day>, and of the days the newest `keep`; False if the day has one."""
    spark = df.sparkSession
    mine, fs = _path(spark, f"{folder}/dt={day}")
    if fs.exists(mine):
        return False
    df.write.parquet(f"{folder}/dt={day}")
    root, _ = _path(spark, folder)
    days = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("dt="))
    for d in days[:-keep]:
        fs.delete(_path(spark, f"{folder}/{d}")[0], True)
    return True
