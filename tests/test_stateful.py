"""Guards as stateful streams against the batch forms, with timers and expiry."""

import time

import pytest
from pyspark.sql import functions as F

from recollex.streaming import guards, stateful

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def state(spark):
    stateful.keep_state(spark)
    yield spark
    spark.conf.unset(stateful._PROVIDER)


def run(spark, tmp_path, make, batches, schema, by_clock=False):
    """The rows a stream gives for batches of rows, in order. A stream that goes by the clock never ends by itself."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    name = f"out{abs(hash(str(tmp_path)))}"
    w = make(stream.withColumn("ts", F.timestamp_micros(F.expr("cast(t * 1e6 as bigint)")))).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").outputMode("append")
    if by_clock:
        q = w.start()
        stop = time.time() + 120
        while spark.table(name).count() < sum(map(len, batches)) and time.time() < stop and q.isActive:
            time.sleep(0.5)
        q.stop()
    else:
        w.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_stream_equals_batch(state, tmp_path):
    """All events in three batches give the outcomes of the batch form."""
    e = state.read.parquet(f"{DATA}/events.parquet").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    rows = sorted(map(tuple, e.collect()), key=lambda r: r[1])
    third = len(rows) // 3 + 1
    out = run(state, tmp_path, lambda s: stateful.burst_stream(s, seconds=86_400, limit=5, lock_minutes=60, late="1 second"), [rows[i : i + third] for i in range(0, len(rows), third)], "user_id long, t double")
    want = guards.guard_batch(e.withColumnRenamed("t", "epoch"), seconds=86_400, limit=5, lock_minutes=60).collect()
    assert sorted((r.user_id, r.epoch, r.outcome) for r in out if r.outcome != "unlocked") == sorted(map(tuple, want))
    assert {r.user_id for r in out if r.outcome == "unlocked"} <= {r.user_id for r in want if r.outcome == "burst"}


def test_timer_unlocks_and_forgets(state, tmp_path):
    base = 1_700_000_000.0
    batches = [[(1, base + i) for i in range(4)], [(1, base + 30.0), (2, base + 30.0)], [(2, base + 500.0)], [(2, base + 900.0)], [(1, base + 901.0)]]
    out = run(state, tmp_path, lambda s: stateful.burst_stream(s, seconds=10, limit=3, lock_minutes=1, late="0 seconds"), batches, "user_id long, t double")
    said = {(r.user_id, r.epoch - base): r.outcome for r in out}
    assert said[1, 3.0] == "burst" and said[1, 30.0] == "locked" and said[1, 63.0] == "unlocked" and said[1, 901.0] == "accepted"
    assert {o for (u, _), o in said.items() if u == 2} == {"accepted"}


def test_success_releases(state, tmp_path):
    base = 1_700_000_000.0
    batches = [[(1, base, False), (1, base + 1, False), (1, base + 2, False)], [(1, base + 3, True), (1, base + 4, False)], [(2, base + 5, False)]]
    out = run(state, tmp_path, lambda s: stateful.lockout_stream(s, seconds=600, limit=3, late="1 minute"), batches, "user_id long, t double, ok boolean")
    said = {(r.user_id, r.epoch - base): r.outcome for r in out}
    assert said == {(1, 0.0): "failed", (1, 1.0): "failed", (1, 2.0): "locked", (1, 3.0): "accepted", (1, 4.0): "failed", (2, 5.0): "failed"}


@pytest.mark.parametrize(("ttl_ms", "last"), [(1, "accepted"), (3_600_000, "burst")])
def test_expired_keys_are_gone(state, tmp_path, ttl_ms, last):
    """State that isn't written within the time to live doesn't count any more."""
    base = 1_700_000_000.0
    batches = [[(1, base), (1, base + 1), (1, base + 2)], [(2, base)], [(2, base + 3)], [(1, base + 4)]]
    out = run(state, tmp_path, lambda s: stateful.burst_stream(s, seconds=60, limit=3, ttl_ms=ttl_ms), batches, "user_id long, t double", by_clock=True)
    assert {r.epoch - base: r.outcome for r in out if r.user_id == 1}[4.0] == last
