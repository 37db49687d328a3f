"""Guard and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.plans.register import register
from recollex.streaming import guards as G
from recollex.tables import table

QUERIES, ORACLE_SQL, query = register()
_DAY = 86_400


def _counts_sql(seconds: int, where: str) -> str:
    return f"SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events WHERE {where}"


@query("write_burst_flags", f"SELECT user_id, event_id, n, n > 5 AS hit FROM ({_counts_sql(_DAY, 'TRUE')})")
def write_burst_flags(spark, sf_dir):
    """The events are sparse: a day stands for the minute, five for thirty."""
    return G.windowed_counts(table(spark, sf_dir, "events"), "user_id", _DAY, 5).select("user_id", "event_id", "n", "hit")


_FAIL = f"g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events), f AS (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id, since ORDER BY epoch_us(ts) RANGE BETWEEN {5 * _DAY * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM g WHERE event_type <> 'purchase')"


@query("failure_lockout", f"WITH {_FAIL} SELECT user_id, event_id, n, n >= 3 AS locked, CASE WHEN n >= 3 THEN ts + INTERVAL 30 MINUTES END AS until FROM f")
def failure_lockout(spark, sf_dir):
    """A purchase stands for success, all else for failure; five days for ten minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return G.lockouts(e, "user_id", 5 * _DAY, 3, order=("event_id",)).select("user_id", "event_id", "n", "locked", "until")


@query("burst_rollback", f"WITH f AS ({_counts_sql(_DAY, 'TRUE')}), s AS (SELECT user_id, min(ts) AS since FROM f WHERE n > 8 GROUP BY user_id) SELECT e.user_id, e.event_id FROM events e LEFT JOIN s USING (user_id) WHERE since IS NULL OR e.ts < since")
def burst_rollback(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bursts = G.windowed_counts(e, "user_id", _DAY, 8).where("hit").select("user_id", F.col("ts").alias("since"))
    return G.rollback(e.select("user_id", "event_id", "ts"), bursts, "user_id").select("user_id", "event_id")


#: The guard as a fold over each user's times: (recent writes, locked until, outcomes).
_STATE = f"""WITH t AS (SELECT user_id, list(epoch_us(ts) / 1e6 ORDER BY ts) AS ts FROM events GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_transform(ts, lambda x: {{'recent': CAST([] AS DOUBLE[]), 'until': 0.0::DOUBLE, 'out': [{{'t': x, 'o': ''}}]}}), lambda s, x: CASE
  WHEN x.out[1].t < s.until THEN {{'recent': s.recent, 'until': s.until, 'out': list_append(s.out, {{'t': x.out[1].t, 'o': 'locked'}})}}
  WHEN len(list_filter(s.recent, lambda v: v > x.out[1].t - {_DAY})) + 1 > 5 THEN {{'recent': CAST([] AS DOUBLE[]), 'until': x.out[1].t + 3600.0::DOUBLE, 'out': list_append(s.out, {{'t': x.out[1].t, 'o': 'burst'}})}}
  ELSE {{'recent': list_append(list_filter(s.recent, lambda v: v > x.out[1].t - {_DAY}), x.out[1].t), 'until': s.until, 'out': list_append(s.out, {{'t': x.out[1].t, 'o': 'accepted'}})}} END,
  {{'recent': CAST([] AS DOUBLE[]), 'until': 0.0::DOUBLE, 'out': CAST([] AS STRUCT(t DOUBLE, o VARCHAR)[])}}) AS s FROM t)
SELECT user_id, x.t AS epoch, x.o AS outcome FROM (SELECT user_id, unnest(s.out) AS x FROM r)"""


@query("burst_state", _STATE)
def burst_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("epoch"))
    return G.guard_batch(e, seconds=_DAY, limit=5, lock_minutes=60)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return G.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("stream_sliding", "WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY start")
def stream_sliding(spark, sf_dir):
    return G.sliding(table(spark, sf_dir, "events"))


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    return G.sessions(table(spark, sf_dir, "events"))


@query("tool_call_loops", "WITH f AS (SELECT user_id, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), l AS (SELECT *, lag(t, 1) OVER w AS a, lag(t, 2) OVER w AS b, lag(t, 3) OVER w AS c FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CASE WHEN t = a THEN 1 WHEN t = b AND a = c THEN 2 ELSE 0 END AS period FROM l")
def tool_call_loops(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("name"), F.lit("").alias("args"))
    return G.loops(e, "user_id", "event_id", 2).select("user_id", "event_id", F.coalesce("period", F.lit(0)).alias("period"))
