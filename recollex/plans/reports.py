"""Reports and texts for a prompt: compression, warnings, working memory, bridge, learner, reflection, wake."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import context as C
from recollex.operators import reflection as R
from recollex.plans import sqltext as S
from recollex.plans.context import _LEVEL, _ROUNDS, _SEC, _SESS, _sections, _sessions, _turns
from recollex.plans.register import register
from recollex.plans.reflection import _SEEN, _lessons
from recollex.tables import quoted, table, texts, texts_sql

QUERIES, ORACLE_SQL, query = register()

_T = f"{_SEC}, t AS (SELECT payload_id, CAST(sum(length(content)) AS BIGINT) AS total FROM sec GROUP BY 1), l AS (SELECT *, {_LEVEL} AS level FROM t)"
_PCT = "round_even(least(total * 100.0 / 2000, 100.0), 1)"


@query("compression_status", f"WITH {_T} SELECT payload_id, level, {_PCT} AS usage_pct, 2000 AS budget, 0.7 AS mild, 0.85 AS auto, 0.7 AS warn FROM l")
def compression_status(spark, sf_dir):
    p = C.payload_levels(_sections(spark, sf_dir))
    return p.select("payload_id", "level", F.col("pct").alias("usage_pct"), F.lit(K.BUDGET_CHARS).alias("budget"), F.lit(K.MILD).alias("mild"), F.lit(K.AUTO).alias("auto"), F.lit(K.WARN).alias("warn"))


@query("status_lines", f"WITH {_T}, p AS (SELECT payload_id, CAST(floor({_PCT}) AS INTEGER) AS p FROM l) SELECT payload_id, 'budget: ' || CAST(p AS VARCHAR) || '% (' || CAST(100 - p AS VARCHAR) || '% left), mild 70% / auto 85%' AS line FROM p WHERE p > 0")
def status_lines(spark, sf_dir):
    p = C.payload_levels(_sections(spark, sf_dir)).select("payload_id", F.floor("pct").cast("int").alias("p")).where("p > 0")
    return p.select("payload_id", F.concat(F.lit("budget: "), F.col("p").cast("string"), F.lit("% ("), (100 - F.col("p")).cast("string"), F.lit("% left), mild 70% / auto 85%")).alias("line"))


_EV = "ev AS (SELECT user_id AS key, event_id, CAST(floor(value * 100) AS BIGINT) + 500 AS before, CAST(floor(value * 60) AS BIGINT) + 300 AS after, CASE WHEN event_type = 'error' THEN event_id END AS reported FROM events)"


@query("compression_reports", f"WITH {_EV}, e AS (SELECT key, max_by(before, event_id) AS before, max_by(after, event_id) AS after, max(event_id) AS last, max(reported) AS reported FROM ev GROUP BY key) SELECT key, 'saved ~' || CAST((before - after) // 4 AS VARCHAR) || ' tokens (' || CAST(CAST(round_even(after * 100.0 / before, 1) AS DECIMAL(9, 1)) AS VARCHAR) || '% left)' AS message FROM e WHERE before > after AND (reported IS NULL OR reported <> last)")
def compression_reports(spark, sf_dir):
    """Users' last compressions that weren't reported; errors stand for reports."""
    e = table(spark, sf_dir, "events")
    ev = e.select(F.col("user_id").alias("key"), "event_id", (F.floor(F.col("value") * 100) + 500).alias("before"), (F.floor(F.col("value") * 60) + 300).alias("after"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("reported"))
    return C.report_message(ev)


_PW = f"WITH s AS ({_SESS}), l AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, session_id DESC) AS k FROM s), p AS (SELECT provider, CAST(least(100, round_even(input_tokens * 100.0 / 200000, 0)) AS INTEGER) AS pct, api_calls > 20 AND least(100, round_even(input_tokens * 100.0 / 200000, 0)) < 30 AS deep FROM l WHERE k = 1)"


@query("context_warnings", _PW + " SELECT provider, lang, CASE WHEN deep THEN CASE lang WHEN 'zh' THEN provider || '上下文 ' || CAST(pct AS VARCHAR) || '%，对话已深' ELSE provider || ' context at ' || CAST(pct AS VARCHAR) || '%, deeply compressed' END WHEN pct >= 70 THEN CASE lang WHEN 'zh' THEN provider || '上下文 ' || CAST(pct AS VARCHAR) || '%，接近 70% 预警线' ELSE provider || ' context at ' || CAST(pct AS VARCHAR) || '%, near the 70% line' END ELSE '' END AS message FROM p, (VALUES ('en'), ('zh')) v(lang)")
def context_warnings(spark, sf_dir):
    """Each provider's warning in both languages."""
    p = C.latest_session(_sessions(spark, sf_dir), 200_000).withColumn("lang", F.explode(F.array(F.lit("en"), F.lit("zh"))))
    return p.select("provider", "lang", C.warning(F.col("provider"), F.col("pct"), F.col("compressed"), F.col("lang")).alias("message"))


for _name, _forced in (("provider_resolution", None), ("provider_forced", "error")):

    def _resolution(spark, sf_dir, forced=_forced):
        return C.resolve(_sessions(spark, sf_dir), ["purchase", "click"], forced)

    _rank = (f"CASE provider WHEN '{_forced}' THEN 0 " if _forced else "CASE provider ") + "WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"
    QUERIES[_name] = _resolution
    ORACLE_SQL[_name] = f"WITH s AS ({_SESS}) SELECT provider, count(*) AS n FROM s GROUP BY provider ORDER BY {_rank}, provider LIMIT 1"


@query("provider_json_sessions", "WITH n AS (SELECT conv_id AS session_id, CAST(count(*) AS INTEGER) AS calls FROM conversations GROUP BY conv_id) SELECT session_id, calls, calls * 1000 AS tokens, CAST(least(100, round_even(calls * 100000.0 / 128000, 0)) AS INTEGER) AS pct, calls > 40 OR calls * 1000 > 128000 AS compressed FROM n WHERE calls >= 2")
def provider_json_sessions(spark, sf_dir):
    """Conversations as JSON session files."""
    t = _turns(spark, sf_dir).groupBy("session_id").agg(F.collect_list(F.struct("role", "text")).alias("messages"))
    return C.json_sessions(t.select("session_id", F.to_json(F.struct("messages")).alias("content")))


_WM = "w AS (SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"


@query("working_memory_text", f"WITH {_WM} SELECT session_id, '**Task:** ' || substr(min_by(text, turn), 1, 60) || chr(10) || string_agg('- [' || CAST(turn AS VARCHAR) || '] ' || substr(text, 1, 200), chr(10) ORDER BY turn) FILTER (back <= 5) || chr(10) || string_agg('- [ ] ' || substr(text, 1, 200), chr(10) ORDER BY turn) FILTER (back <= 2) AS text FROM w GROUP BY session_id")
def working_memory_text(spark, sf_dir):
    """A session's first turn as the task, its last five as contexts and its last two as open to-dos."""
    w = Window.partitionBy("session_id")
    t = _turns(spark, sf_dir).withColumn("id", F.row_number().over(w.orderBy("turn")).cast("long")).withColumn("back", F.row_number().over(w.orderBy(F.desc("turn"))))
    todos = t.select("session_id", "id", F.substring("text", 1, 200).alias("todo"), (F.col("back") > 2).alias("done"))
    contexts = t.where("back <= 5").select("session_id", F.col("id").alias("place"), F.col("turn").cast("string").alias("at"), F.substring("text", 1, 200).alias("text"))
    return C.working_memory_text(todos, contexts)


@query("bridge_summary", f"WITH {_ROUNDS}, s AS (SELECT conv_id AS session_id, substr(min_by(text, turn), 1, 60) AS topic FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT session_id, 'Topic: ' || topic || chr(10) || string_agg('[' || CAST(place AS VARCHAR) || '] user: ' || substr(\"user\", 1, 80) || CASE WHEN assistant IS NULL THEN '' ELSE chr(10) || '[' || CAST(place AS VARCHAR) || '] assistant: ' || substr(assistant, 1, 80) END, chr(10) ORDER BY place DESC) AS summary FROM rounds JOIN s USING (session_id) WHERE place <= 3 GROUP BY session_id, topic")
def bridge_summary(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    topic = turns.where("role = 'user'").groupBy("session_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("topic"))
    return C.bridge_text(C.last_rounds(turns), topic)


_HEADS = f"SELECT DISTINCT regexp_extract(substr(text, 1, 30), '^\\s*([^\\s，。！？、!?.]{{1,10}})[，。！？、!?.]', 1) AS signal FROM texts"


@query("trigger_words", f"WITH {texts_sql('documents', 'conversations')}, h AS ({_HEADS}) SELECT signal FROM h WHERE signal <> '' AND NOT list_contains({S.sql_list([*R.TRIGGER_STOP, *K.CORRECTION_SIGNALS])}, signal)")
def trigger_words(spark, sf_dir):
    return R.trigger_words(texts(spark, sf_dir, "documents", "conversations"), K.CORRECTION_SIGNALS)


@query("behavior_rules", f"WITH c AS (SELECT lesson, count(*) AS n FROM ({_SEEN}) GROUP BY lesson) SELECT 'rule' AS kind, '- ' || lesson AS line FROM c WHERE n >= 3 UNION ALL SELECT 'pending', '- ' || lesson || ' (' || CAST(n AS VARCHAR) || ' times)' FROM c WHERE n = 2 AND (SELECT max(n) FROM c) < 3")
def behavior_rules(spark, sf_dir):
    return R.behavior_rules(_lessons(spark, sf_dir))


#: Lessons as customers' names for events, each at most twice, so that none is promoted.
_FEW = "l AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS lesson, count(*) AS n FROM events GROUP BY 1), c AS (SELECT lesson, least(n, 2) AS n FROM l)"


@query("behavior_rules_pending", f"WITH {_FEW} SELECT 'pending' AS kind, '- ' || lesson || ' (2 times)' AS line FROM c WHERE n = 2")
def behavior_rules_pending(spark, sf_dir):
    """No lesson is promoted here, so those seen twice show as pending."""
    e = table(spark, sf_dir, "events")
    c = e.groupBy(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("lesson")).agg(F.least(F.count("*"), F.lit(2)).alias("count"))
    return R.behavior_rules(c.withColumn("promoted", F.lit(False)))


@query("learner_stats", f"WITH c AS (SELECT lesson, count(*) AS n FROM ({_SEEN}) GROUP BY lesson), {texts_sql('documents', 'conversations')}, h AS ({_HEADS}), s AS (SELECT count(*) AS learned FROM h WHERE signal <> '' AND NOT list_contains({S.sql_list([*R.TRIGGER_STOP, *K.CORRECTION_SIGNALS])}, signal)) SELECT count(*) AS lessons, count(*) FILTER (n >= 3) AS rules, {len(K.CORRECTION_SIGNALS)} + any_value(learned) AS signals, any_value(learned) AS learned FROM c, s")
def learner_stats(spark, sf_dir):
    one = _lessons(spark, sf_dir).agg(F.count("*").alias("lessons"), F.count_if("promoted").alias("rules"))
    learned = trigger_words(spark, sf_dir).agg(F.count("*").alias("learned"))  # one row each
    return one.crossJoin(learned).select("lessons", "rules", (F.col("learned") + len(K.CORRECTION_SIGNALS)).alias("signals"), "learned")


_VALUES = " UNION ALL ".join(f"SELECT src, id, {i} AS seq, '{f}' AS field, trim(regexp_extract(text, {quoted(p)}, 1, 'i')) AS value FROM texts" for i, (p, f) in enumerate(K.PROFILE_PATTERNS))
_FOUND = f"{texts_sql('conversations')}, p0 AS ({_VALUES}), p AS (SELECT id AS user_id, seq, field, value FROM p0 WHERE value <> '' AND NOT list_contains({S.sql_list(K.PROFILE_SKIP)}, lower(value)))"
_PROFILES = f"{_FOUND}, prof AS (SELECT user_id, field, max_by(value, seq) AS value FROM p WHERE field <> 'tools' GROUP BY 1, 2 UNION ALL SELECT user_id, 'tools', string_agg(value, ', ' ORDER BY seq, value) FROM (SELECT user_id, value, min(seq) AS seq FROM p WHERE field = 'tools' GROUP BY 1, 2) GROUP BY user_id)"


def _profiles(spark, sf_dir):
    return R.profiles(texts(spark, sf_dir, "conversations").select(F.col("id").alias("user_id"), F.lit(0).alias("at"), "text"))


@query("user_profiles", f"WITH {_PROFILES} SELECT user_id, field, value FROM prof")
def user_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)


@query("profile_stats", f"WITH {_PROFILES} SELECT field, count(*) AS users, count(DISTINCT value) AS n_values FROM prof GROUP BY field")
def profile_stats(spark, sf_dir):
    return _profiles(spark, sf_dir).groupBy("field").agg(F.count("*").alias("users"), F.countDistinct("value").alias("n_values"))
