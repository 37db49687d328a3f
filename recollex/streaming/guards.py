"""Write-burst and failure guards: window queries, exact state, and the same as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollex import consts as K


def windowed_counts(log: DataFrame, key: str, seconds: int, limit: int, ts: str = "ts") -> DataFrame:
    """log with n (rows of the key in the last seconds, strictly after t - seconds) and hit (n over limit)."""
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return log.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("n", F.count("*").over(w)).withColumn("hit", F.col("n") > limit).drop("__us")


def lockouts(log: DataFrame, key: str, seconds: int = K.FAILURE_SECONDS, limit: int = K.FAILURE_LIMIT, minutes: int = K.FAILURE_LOCK_MINUTES, ts: str = "ts", ok: str = "ok", order: tuple[str, ...] = ()) -> DataFrame:
    """Failures of a log (key, ts, ok) with n (the key's failures in the last seconds since its last success), locked and
    until: a success clears the count, so it begins a group of its own. order: columns that put rows of one time in order;
    without them a success comes before the failures of its time. Failures of one time all count one another."""
    w = Window.partitionBy(key).orderBy(ts, *(order or [F.desc(ok)])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = log.withColumn("__since", F.sum(F.col(ok).cast("int")).over(w)).where(~F.col(ok))
    span = Window.partitionBy(key, "__since").orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    n = groups.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("n", F.count("*").over(span)).drop("__us", "__since", ok)
    locked = F.col("n") >= limit
    return n.withColumn("locked", locked).withColumn("until", F.when(locked, F.col(ts) + F.expr(f"INTERVAL {minutes} MINUTES")))


def ring_stream(rounds: DataFrame, key: str = "session_id", most: int = K.RING["rounds"]) -> DataFrame:
    """The newest rounds of each key of a stream (key, seq, text) after every batch, with place 1 the newest: the state of
    a key is its ring, so it has `most` rounds however long the session."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new = [(int(s), t) for b in batches for s, t in zip(b["seq"], b["text"], strict=True)]
        ring = sorted({*((int(s), t) for s, t in held), *new}, key=lambda x: -x[0])[:most]
        state.update(([s for s, _ in ring], [t for _, t in ring]))
        yield pd.DataFrame({key: k[0], "place": range(1, len(ring) + 1), "seq": [s for s, _ in ring], "text": [t for _, t in ring]})

    return rounds.select(key, "seq", "text").groupBy(key).applyInPandasWithState(run, f"{key} long, place long, seq long, text string", "seqs array<long>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


def rollback(rows: DataFrame, bursts: DataFrame, key: str) -> DataFrame:
    """rows (key, ts) without those from a burst's first write on: an interval anti join on (key, since)."""
    since = bursts.groupBy(key).agg(F.min("since").alias("since"))
    return rows.join(since, key, "left").where(F.col("since").isNull() | (F.col("ts") < F.col("since"))).drop("since")


def _guard(times: list[float], state: tuple[list[float], float], seconds: int, limit: int, lock_minutes: int) -> tuple[tuple[list[float], float], list[tuple[float, str]]]:
    """Folds write times into (recent writes, locked until); returns what happened: accepted, burst (clears the log and
    locks) or locked."""
    recent, until = state
    out = []
    for t in times:
        if t < until:
            out.append((t, "locked"))
            continue
        recent = [x for x in recent if x > t - seconds] + [t]
        if len(recent) > limit:
            recent, until = [], t + lock_minutes * 60
            out.append((t, "burst"))
        else:
            out.append((t, "accepted"))
    return (recent, until), out


def guard_batch(log: DataFrame, key: str = "user_id", seconds: int = K.BURST_SECONDS, limit: int = K.BURST_LIMIT, lock_minutes: int = K.BURST_LOCK_MINUTES) -> DataFrame:
    """key, epoch, outcome of every write (key, epoch): the exact guard, whose log clears when it fires."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, out = _guard(sorted(pdf["epoch"]), ([], 0.0), seconds, limit, lock_minutes)
        return pd.DataFrame({key: pdf[key].iloc[0], "epoch": [t for t, _ in out], "outcome": [o for _, o in out]})

    return log.select(key, "epoch").groupBy(key).applyInPandas(run, f"{key} long, epoch double, outcome string")


def guard_stream(log: DataFrame, key: str = "user_id", seconds: int = K.BURST_SECONDS, limit: int = K.BURST_LIMIT, lock_minutes: int = K.BURST_LOCK_MINUTES) -> DataFrame:
    """The same over a stream of (key, epoch); the state of a key is its recent writes and its lock."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in batches for t in b["epoch"])
        held = state.get if state.exists else ([], 0.0)
        (recent, until), out = _guard(times, (list(held[0]), held[1]), seconds, limit, lock_minutes)
        state.update((recent, until))
        yield pd.DataFrame({key: k[0], "epoch": [t for t, _ in out], "outcome": [o for _, o in out]})

    return log.select(key, "epoch").groupBy(key).applyInPandasWithState(run, f"{key} long, epoch double, outcome string", "recent array<double>, until double", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total by tumbling windows; with late, under a watermark."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """user_id, start, stop, n of each user's sessions, which end after a gap without events."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def loops(calls: DataFrame, key: str = "session_id", order: str = "seq", most: int = 5) -> DataFrame:
    """Calls (key, order, name, args) with period: the shortest period p for which the last p fingerprints equal the p
    before them; null if none up to most."""
    w = Window.partitionBy(key).orderBy(order)
    c = calls.withColumn("fp", F.sha2(F.concat_ws("\x1f", "name", "args"), 256))
    period = F.lit(None).cast("int")
    for p in range(most, 0, -1):
        same = F.lit(True)
        for k in range(p):
            same = same & F.coalesce(F.lag("fp", k).over(w) == F.lag("fp", k + p).over(w), F.lit(False))
        period = F.when(same, p).otherwise(period)
    return c.withColumn("period", period).drop("fp")
