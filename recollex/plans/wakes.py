"""Wake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.plans.context import _ROUNDS, compress_sql
from recollex.plans.lifecycle import _GREEDY, _LIFE, FATE, _life
from recollex.plans.register import register
from recollex.plans.wake import wake
from recollex.tables import table

QUERIES, ORACLE_SQL, query = register()


def _wake(spark, sf_dir):
    m = _life(spark, sf_dir).withColumn("merged_into", F.when(F.col("memory_id") % 11 == 5, "MERGE-0")).withColumn("is_merged", F.lit(False))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", F.sha2("text", 256).alias("sha256"))
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    return wake(m, m.select("memory_id", "scene", "ts"), turns, d.select("path", "sha256"), d.where("lang <> 'es'").select("path", "sha256"), F.lit(FATE).cast("timestamp_ntz"))


@query("wake_report", f"WITH {_LIFE} SELECT decision, count(*) AS n FROM fate GROUP BY decision")
def wake_report(spark, sf_dir):
    return _wake(spark, sf_dir).report


#: The five newest active memories and the newest session's bridge, as sections of one prompt.
_SECTIONS = f"""{_LIFE}, {_ROUNDS}, lines AS (SELECT r.*, '[' || CAST(place AS VARCHAR) || '] ' AS head FROM rounds r WHERE place <= 3 AND session_id = (SELECT max(conv_id) FROM conversations)),
bridge AS (SELECT 'Topic: ' || (SELECT substr(min_by(text, turn), 1, 60) FROM conversations WHERE role = 'user' AND conv_id = (SELECT max(conv_id) FROM conversations)) || chr(10)
 || string_agg(head || 'user: ' || substr("user", 1, 80) || coalesce(chr(10) || head || 'assistant: ' || substr(assistant, 1, 80), ''), chr(10) ORDER BY place DESC) AS content FROM lines),
newest AS (SELECT substr(summary, 1, 500) AS content, row_number() OVER (ORDER BY ts DESC, memory_id DESC) AS seq FROM fate WHERE decision NOT IN ('demote', 'archive', 'stays_demoted')),
sec AS (SELECT CAST(0 AS BIGINT) AS payload_id, seq, content, 5 AS priority, 'memory' AS category, CAST(seq AS VARCHAR) AS name FROM newest WHERE seq <= 5 UNION ALL SELECT 0, 0, content, 2, 'bridge', '0' FROM bridge WHERE content IS NOT NULL)"""


@query("wake_actions", f"WITH RECURSIVE {compress_sql(_SECTIONS)} SELECT payload_id, seq, action, kept FROM done")
def wake_actions(spark, sf_dir):
    return _wake(spark, sf_dir).actions


_ACTIVE = _GREEDY.replace(_GREEDY[len("WITH RECURSIVE ") : _GREEDY.index(", k AS (")], _LIFE).replace("FROM memories WHERE memory_id % 9 <> 0 AND memory_id % 11 <> 5", "FROM fate WHERE decision NOT IN ('demote', 'archive', 'stays_demoted') AND memory_id % 11 <> 5")


@query("wake_message", _ACTIVE + """, n AS (SELECT 1 AS o, 'demoted ' || CAST(count(*) AS VARCHAR) || ' memories' AS l, count(*) AS n FROM fate WHERE decision = 'demote' UNION ALL SELECT 2, CAST(count(*) AS VARCHAR) || ' can be archived', count(*) FROM fate WHERE decision = 'archive'
UNION ALL SELECT 3, CAST(count(*) AS VARCHAR) || ' files differ', count(*) FROM documents WHERE lang = 'es' UNION ALL SELECT 4, 'merged ' || CAST(count(*) AS VARCHAR) || ' groups', count(*) FROM grp) SELECT string_agg(l, '. ' ORDER BY o) AS message FROM n WHERE n > 0""")
def wake_message(spark, sf_dir):
    return _wake(spark, sf_dir).message


@query("wake_bridge", "WITH s AS (SELECT max(conv_id) AS c FROM conversations) SELECT conv_id AS session_id, substr(min_by(text, turn), 1, 60) AS topic FROM conversations, s WHERE conv_id = c AND role = 'user' GROUP BY conv_id")
def wake_bridge(spark, sf_dir):
    """The newest session's topic, as the bridge's first line has it."""
    b = _wake(spark, sf_dir).bridge
    return b.select("session_id", F.substring(F.regexp_extract("summary", "(?s)^Topic: (.*?)\\n\\[", 1), 1, 60).alias("topic"))
