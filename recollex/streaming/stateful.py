"""The guards as stateful streams: list and value state, timers that unlock and forget, and expiry.

`transformWithState` keeps its state in RocksDB, so a session that starts these streams calls `keep_state` first. In event
time (the default) a timer fires when the watermark passes: it reports the end of a lock, and it forgets keys of which
nothing is needed any more. With a time to live, expiry is by the clock instead: state that isn't written for so long goes,
and locks end by comparing times when the key's next row comes. Such a stream has no last batch: start it with a trigger by
interval, not `availableNow`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollex import consts as K

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTCOMES = "accepted burst locked failed unlocked".split()


def keep_state(spark: SparkSession) -> None:
    """State of streams started from now on is kept in RocksDB."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Guard(StatefulProcessor):
    """Recent times of a key in a list, the end of its lock in a value. Subclasses say what a row does."""

    def __init__(self, key: str, seconds: float, limit: int, lock_seconds: float, ttl_ms: int | None):
        self.key, self.seconds, self.limit, self.lock_seconds, self.ttl_ms = key, seconds, limit, lock_seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t double", self.ttl_ms)
        self.until = handle.getValueState("until", "t double", self.ttl_ms)

    def close(self) -> None:
        pass

    def _rows(self, key, out: list[tuple[float, str]]) -> pd.DataFrame:
        return pd.DataFrame({self.key: pd.Series([key[0]] * len(out)), "epoch": pd.Series([t for t, _ in out], dtype="float64"), "outcome": pd.Series([o for _, o in out], dtype="object")})

    def _held(self) -> tuple[list[float], float]:
        return [r[0] for r in self.recent.get()] if self.recent.exists() else [], self.until.get()[0] if self.until.exists() else 0.0

    def _needed(self, recent: list[float], until: float) -> float:
        """When the key's state stops to matter."""
        return max([until, *(t + self.seconds for t in recent)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent, until = self._held()
        had = until
        out = []
        batch = sorted((float(e), bool(o)) for pdf in rows for e, o in zip(pdf["epoch"], pdf["ok"], strict=True))
        for t, ok in batch:
            recent, until, said = self.step(recent, until, t, ok)
            out.append((t, said))
        recent = [t for t in recent if t > batch[-1][0] - self.seconds] if batch else recent
        if recent:
            self.recent.put([(t,) for t in recent])
        else:
            self.recent.clear()
        if until:
            self.until.update((until,))
        else:
            self.until.clear()
        if self.ttl_ms is None:
            if until != had:
                if had:
                    self.handle.deleteTimer(int(had * 1000))
                if until:
                    self.handle.registerTimer(int(until * 1000))
            if recent:
                self.handle.registerTimer(int(self._needed(recent, until) * 1000) + 1)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        recent, until = self._held()
        out = []
        if until and int(until * 1000) <= at:
            out.append((until, "unlocked"))
            until = 0.0
            self.until.clear()
        if not until and self._needed(recent, until) * 1000 <= at:
            self.recent.clear()
        yield self._rows(key, out)


class _Bursts(_Guard):
    """More than limit writes within the span lock the key and clear its log; a locked key's writes are refused."""

    def step(self, recent, until, t, ok):
        if t < until:
            return recent, until, "locked"
        recent = [x for x in recent if x > t - self.seconds] + [t]
        if len(recent) > self.limit:
            return [], t + self.lock_seconds, "burst"
        return recent, until, "accepted"


class _Failures(_Guard):
    """limit failures within the span lock the key; a success clears them and the lock."""

    def step(self, recent, until, t, ok):
        if ok:
            return [], 0.0, "accepted"
        recent = [x for x in recent if x > t - self.seconds] + [t]
        if len(recent) >= self.limit:
            return recent, t + self.lock_seconds, "locked"
        return recent, until, "failed"


def _run(log: DataFrame, guard: _Guard, late: str, ttl_ms: int | None) -> DataFrame:
    key = guard.key
    kind = log.schema[key].dataType.simpleString()
    ok = F.col("ok").cast("boolean") if "ok" in log.columns else F.lit(False)
    rows = log.select(key, "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"), ok.alias("ok"))
    if ttl_ms is None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(guard, f"{key} {kind}, epoch double, outcome string", "Append", "EventTime" if ttl_ms is None else "ProcessingTime")


def burst_stream(log: DataFrame, key: str = "user_id", seconds: float = K.BURST_SECONDS, limit: int = K.BURST_LIMIT, lock_minutes: float = K.BURST_LOCK_MINUTES, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """key, epoch, outcome of every write of a stream (key, ts: a timestamp): accepted, burst or locked, as `guard_batch`
    has it; and, in event time, unlocked with the end of the lock. Rows of one batch are put in order of time; batches
    have to come in order, but for what the watermark (late) allows. Null times are refused by the watermark."""
    return _run(log, _Bursts(key, seconds, limit, lock_minutes * 60, ttl_ms), late, ttl_ms)


def lockout_stream(log: DataFrame, key: str = "user_id", seconds: float = K.FAILURE_SECONDS, limit: int = K.FAILURE_LIMIT, lock_minutes: float = K.FAILURE_LOCK_MINUTES, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """key, epoch, outcome of every attempt of a stream (key, ts, ok): accepted (a success, which releases the key), failed,
    or locked from the limit's failure on; and, in event time, unlocked."""
    return _run(log, _Failures(key, seconds, limit, lock_minutes * 60, ttl_ms), late, ttl_ms)
