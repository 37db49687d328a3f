"""Context, bridge, knowledge-file, integrity and provider queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.operators import context as C
from recollex.operators import gate as G
from recollex.plans import sqltext as S
from recollex.plans.gate import _labels_sql
from recollex.plans.register import register
from recollex.tables import table

QUERIES, ORACLE_SQL, query = register()

_SEC = "sec AS (SELECT conv_id AS payload_id, turn AS seq, text AS content, (turn * 3) % 11 AS priority, CASE role WHEN 'assistant' THEN 'memory' ELSE role END AS category, role || '-' || CAST(turn AS VARCHAR) AS name FROM conversations)"


def _sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("payload_id"), F.col("turn").alias("seq"), F.col("text").alias("content"), (F.col("turn") * 3 % 11).alias("priority"), F.when(F.col("role") == "assistant", "memory").otherwise(F.col("role")).alias("category"), F.concat("role", F.lit("-"), F.col("turn").cast("string")).alias("name"))


_LEVEL = "CASE WHEN total / 2000.0 >= 1 THEN 'over' WHEN total / 2000.0 >= 0.85 THEN 'auto' WHEN total / 2000.0 >= 0.7 THEN 'mild' ELSE 'ok' END"


@query("context_levels", f"WITH {_SEC}, t AS (SELECT payload_id, CAST(sum(length(content)) AS BIGINT) AS total FROM sec GROUP BY 1) SELECT payload_id, total, CAST(floor(total / 4) AS BIGINT) AS tokens, round_even(least(total * 100.0 / 2000, 100.0), 1) AS pct, {_LEVEL} AS level FROM t")
def context_levels(spark, sf_dir):
    return C.payload_levels(_sections(spark, sf_dir))


def compress_sql(sec: str, budget: int = 2000) -> str:
    """CTEs that walk the two tiers section by section: `done` has payload_id, seq, k, n, action, kept, txt of a CTE `sec`."""
    mild, auto = budget * 7 // 10, budget * 85 // 100

    def admitted(name: str, rows: str, yes: str) -> str:
        """name: payload_id, k, kept, yes; a section joins what is kept so far if `yes` holds."""
        return f"""{name} AS (SELECT DISTINCT payload_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS kept, true AS yes FROM {rows}
 UNION ALL SELECT x.payload_id, x.k, CASE WHEN x.ok THEN x.kept + x.n ELSE x.kept END, x.ok FROM (SELECT r.*, w.kept, {yes.format("w.kept")} AS ok FROM {name} w JOIN {rows} r ON r.payload_id = w.payload_id AND r.k = w.k + 1) x)"""

    def cut(name: str, rows: str, admit: str, most: str, does: str) -> str:
        """name: payload_id, k, total, cut; a section is cut to `most` if `does` holds, and the total falls by what that saves."""
        return f"""{name} AS (SELECT payload_id, CAST(0 AS BIGINT) AS k, CAST(max(kept) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS cut FROM {admit} GROUP BY payload_id
 UNION ALL SELECT x.payload_id, x.k, CASE WHEN x.does THEN x.total - (x.n - x.m - x.mark) ELSE x.total END, CASE WHEN x.does THEN x.m END
 FROM (SELECT r.*, w.total, {most} AS m, y.yes AND r.category = 'memory' AND {does.format("w.total")} AS does FROM {name} w JOIN {rows} r ON r.payload_id = w.payload_id AND r.k = w.k + 1 JOIN {admit} y ON y.payload_id = r.payload_id AND y.k = r.k) x)"""

    return f"""{sec}, o AS (SELECT *, length(content) AS n, 10 + length(name) AS mark, CAST(floor(length(content) * 0.6::DOUBLE) AS BIGINT) AS share1, CAST(floor(length(content) * 0.3::DOUBLE) AS BIGINT) AS share2,
 row_number() OVER (PARTITION BY payload_id ORDER BY priority, seq) AS k, sum(length(content)) OVER (PARTITION BY payload_id) > {mild} AS first FROM sec),
{admitted("a1", "o", "r.priority < 9 OR NOT r.first OR {0} <= " + str(budget))},
{cut("c1", "o", "a1", "least(r.share1, 200)", "r.first AND r.priority >= 5 AND {0} > " + str(mild) + " AND r.n > least(r.share1, 200)")},
t AS (SELECT o.*, c1.cut AS cut1, a1.yes AS in1, coalesce(c1.cut + o.mark, o.n) AS size, o.first AND last_value(c1.total) OVER (PARTITION BY o.payload_id ORDER BY o.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) > {auto} AS second FROM o JOIN c1 USING (payload_id, k) JOIN a1 USING (payload_id, k)),
{admitted("a2", "t", "r.in1 AND (r.priority < 7 OR NOT r.second OR {0} <= " + str(budget) + ")")},
{cut("c2", "t", "a2", "least(r.share2, 100)", "r.second AND {0} > " + str(budget) + " AND r.size > least(r.share2, 100)")},
done AS (SELECT payload_id, seq, k, n, first, CASE WHEN NOT in1 THEN 'deferred' WHEN NOT a2.yes THEN 'demoted' WHEN c2.cut IS NOT NULL THEN 'truncated_aggressive' WHEN cut1 IS NOT NULL THEN 'truncated' ELSE 'keep' END AS action,
 CASE WHEN NOT a2.yes THEN 0 ELSE coalesce(coalesce(c2.cut, cut1) + mark, n) END AS kept,
 CASE WHEN NOT a2.yes THEN NULL WHEN coalesce(c2.cut, cut1) IS NULL THEN content ELSE substr(content, 1, coalesce(c2.cut, cut1)) || '… [↩ ref:' || name || ']' END AS txt
 FROM t JOIN a2 USING (payload_id, k) JOIN c2 USING (payload_id, k))"""


@query("context_compress", f"WITH RECURSIVE {compress_sql(_SEC)} SELECT payload_id, seq, action, kept FROM done")
def context_compress(spark, sf_dir):
    return C.compress(_sections(spark, sf_dir))


_PARTS = "coalesce(string_agg(txt, chr(10) || chr(10) ORDER BY CASE WHEN first THEN k ELSE seq END) FILTER (regexp_matches(txt, '\\S')), '')"
_STAYS = "coalesce(sum(n) FILTER (txt IS NOT NULL), 0)"


@query("context_injection", f"WITH RECURSIVE {compress_sql(_SEC, 600)} SELECT payload_id, sha256({_PARTS}) AS text_sha256, CAST({_STAYS} AS BIGINT) AS injected, round_even(least({_STAYS} * 100.0 / 600, 100.0), 1) AS pct, count(txt) AS sections, CAST(sum(n - kept) AS BIGINT) AS saved, count(*) FILTER (action <> 'keep') AS actions FROM done GROUP BY payload_id")
def context_injection(spark, sf_dir):
    """Each conversation as a prompt of 600 characters, with the report of what was cut."""
    i = C.injection(_sections(spark, sf_dir), 600)
    return i.select("payload_id", F.sha2("text", 256).alias("text_sha256"), "injected", "pct", "sections", "saved", "actions")


@query("truncation_running_budget", f"WITH {_SEC}, n AS (SELECT *, length(content) AS n, greatest(length(content) - least(200, CAST(floor(length(content) * 0.6) AS BIGINT)), 0) AS saved FROM sec), b AS (SELECT *, sum(n) OVER (PARTITION BY payload_id) AS total, coalesce(sum(saved) OVER (PARTITION BY payload_id ORDER BY priority, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT payload_id, seq, CAST(CASE WHEN total - before > 1400 AND saved > 0 THEN n - saved ELSE n END AS BIGINT) AS cut_to FROM b")
def truncation_running_budget(spark, sf_dir):
    return C.running_truncation(_sections(spark, sf_dir), 1400, K.MILD_KEEP, K.MILD_CAP)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")


_ROUNDS = "w AS (SELECT conv_id AS session_id, turn, role, text, lead(role) OVER x AS r2, lead(text) OVER x AS t2 FROM conversations WINDOW x AS (PARTITION BY conv_id ORDER BY turn)), rounds AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place, text AS \"user\", CASE WHEN r2 = 'assistant' THEN t2 END AS assistant FROM w WHERE role = 'user')"


@query("bridge_last_rounds", f"WITH {_ROUNDS} SELECT session_id, place, md5(\"user\") AS user_md5, md5(assistant) AS assistant_md5 FROM rounds WHERE place <= 3")
def bridge_last_rounds(spark, sf_dir):
    r = C.last_rounds(_turns(spark, sf_dir))
    return r.select("session_id", F.col("place").cast("long").alias("place"), F.md5(F.col("user").cast("binary")).alias("user_md5"), F.md5(F.col("assistant").cast("binary")).alias("assistant_md5"))


_PREFILL = f"""WITH {_ROUNDS}, l3 AS (SELECT *, {_labels_sql("concat_ws(chr(10), \"user\", assistant)")} AS found FROM rounds WHERE place <= 3),
m AS (SELECT session_id, list_concat(list(struct_pack(o := -place * 2, role := 'user', content := \"user\")), list(struct_pack(o := -place * 2 + 1, role := 'assistant', content := assistant)) FILTER (assistant IS NOT NULL)) AS x FROM l3 WHERE len(found) = 0 GROUP BY session_id)
SELECT session_id, CAST(len(x) AS INTEGER) AS n, array_to_string(list_transform(list_sort(x), lambda y: y.role || ':' || md5(y.content)), ',') AS messages FROM m"""


@query("prefill_export", _PREFILL)
def prefill_export(spark, sf_dir):
    """The export read back from its JSON: roles and digests of the messages in order."""
    turns = _turns(spark, sf_dir)
    rejected = G.quarantine(C.last_rounds(turns).select("session_id", "place", F.concat_ws("\n", "user", "assistant").alias("text"))).select("session_id", "place")
    m = F.from_json("messages", "array<struct<role:string,content:string>>")
    out = C.prefill(turns, rejected).select("session_id", m.alias("m"))
    return out.select("session_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["content"].cast("binary")))), ",").alias("messages"))


@query("bridge_context_md", f"WITH {_ROUNDS} SELECT session_id, string_agg('- **user**: ' || substr(\"user\", 1, 80), chr(10) ORDER BY place DESC) AS md FROM rounds WHERE place <= 3 GROUP BY session_id")
def bridge_context_md(spark, sf_dir):
    r = C.last_rounds(_turns(spark, sf_dir)).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("o"), F.substring("user", 1, 80).alias("u")))).alias("r"))
    return r.select("session_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("- **user**: "), x["u"])), "\n").alias("md"))


@query("session_topic", "SELECT conv_id AS session_id, substr(min_by(text, turn), 1, 60) AS topic, count(*) AS conversation_count FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_topic(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'user'")
    return t.groupBy("session_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("topic"), F.count("*").alias("conversation_count"))


@query("working_memory", "SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id, substr(text, 1, 200) AS todo, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS done FROM conversations")
def working_memory(spark, sf_dir):
    """Turns as to-dos: ids in order, the last two open, texts cut."""
    w = Window.partitionBy("session_id")
    t = _turns(spark, sf_dir)
    return t.select("session_id", F.row_number().over(w.orderBy("turn")).cast("long").alias("id"), F.substring("text", 1, 200).alias("todo"), (F.row_number().over(w.orderBy(F.desc("turn"))) > 2).alias("done"))


_STRIP = "regexp_replace({0}, '<[^>]*>', '{1}', 'g')"
_KW = f"""list_concat(list_concat(regexp_extract_all(html, '(?s)<h[1-4][^>]*>(.*?)</h[1-4]>', 1), regexp_extract_all(html, '(?s)<b>(.*?)</b>', 1)),
 list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: array_to_string(regexp_split_to_array(trim({_STRIP.format('x', '')}), '\\s+')[1:3], ' ')))"""
_KEYS = f"list_distinct(flatten(list_transform({_KW}, lambda p: regexp_extract_all(lower({_STRIP.format('p', ' ')}), '{S.CJK}{{2,}}|[a-z]{{3,}}'))))"


@query("kb_keyword_index", f"SELECT page_id AS file_id, {S.joined(_KEYS)} AS triggers FROM pages")
def kb_keyword_index(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("file_id"), F.array_join(F.array_sort(C.html_keywords(F.col("html"))), "|").alias("triggers"))


_KBQ = "the asci example tion"
_PTS = "CASE WHEN list_contains(triggers, w) THEN 10 WHEN len(list_filter(triggers, lambda t: contains(t, w) OR contains(w, t))) > 0 THEN 5 ELSE 0 END + CASE WHEN contains(lower(filename), w) THEN 3 ELSE 0 END"


@query("kb_search", f"WITH f AS (SELECT page_id AS file_id, url AS filename, {_KEYS} AS triggers FROM pages), w AS (SELECT unnest({S.sql_list(_KBQ.split())}) AS w), s AS (SELECT file_id, CAST(sum({_PTS}) AS INTEGER) AS score FROM f, w GROUP BY file_id) SELECT file_id, score FROM s WHERE score > 0 ORDER BY score DESC, file_id LIMIT 3")
def kb_search(spark, sf_dir):
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("filename"), C.html_keywords(F.col("html")).alias("triggers"))
    return C.kb_scores(f, _KBQ)


@query("kb_stats", "SELECT count(*) AS files, CAST(sum(length(html)) AS BIGINT) AS chars, count(*) FILTER (contains(url, 'en')) AS matching FROM pages")
def kb_stats(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("files"), F.sum(F.length("html")).cast("long").alias("chars"), F.count_if(F.contains("url", F.lit("en"))).alias("matching"))


@query("integrity_diff", "WITH e AS (SELECT doc_id AS path, sha256(text) AS w FROM documents WHERE doc_id % 10 <> 1), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3) SELECT path, CASE WHEN h IS NULL THEN 'missing' WHEN w IS NULL THEN 'unknown' WHEN w = h THEN 'ok' ELSE 'changed' END AS status FROM e FULL OUTER JOIN a USING (path)")
def integrity_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    e = d.where("path % 10 <> 1").select("path", F.sha2("text", 256).alias("sha256"))
    a = d.where("path % 10 <> 3").select("path", F.sha2(F.when(F.col("path") % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return C.integrity_diff(e, a)


@query("json_validity", "SELECT event_id, coalesce(json_valid(props), false) AS valid FROM events")
def json_validity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"))


@query("backup_retention", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 3)")
def backup_retention(spark, sf_dir):
    return C.retained_days(table(spark, sf_dir, "events")).select("event_id", F.to_date("ts").cast("string").alias("day"))


@query("bounded_log", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def bounded_log(spark, sf_dir):
    return C.bounded_log(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


_SESS = "SELECT event_type AS provider, event_id AS session_id, CAST(floor(value * 1000) AS BIGINT) AS input_tokens, event_id % 50 AS api_calls, ts AS started_at FROM events"


def _sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("session_id"), F.floor(F.col("value") * 1000).alias("input_tokens"), (F.col("event_id") % 50).alias("api_calls"), F.col("ts").alias("started_at"))


@query("provider_latest_session", f"WITH s AS ({_SESS}), l AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY started_at DESC, session_id DESC) AS k FROM s) SELECT provider, session_id, input_tokens AS tokens, api_calls AS calls, CAST(least(100, round_even(input_tokens * 100.0 / 200000, 0)) AS INTEGER) AS pct, api_calls > 20 AND least(100, round_even(input_tokens * 100.0 / 200000, 0)) < 30 AS compressed FROM l WHERE k = 1")
def provider_latest_session(spark, sf_dir):
    return C.latest_session(_sessions(spark, sf_dir), 200_000)


@query("provider_tail_tokens", f"WITH s AS ({_SESS}), l AS (SELECT provider, CASE WHEN session_id % 7 <> 0 THEN input_tokens END AS t, row_number() OVER (PARTITION BY provider ORDER BY session_id DESC) AS k FROM s) SELECT provider, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens, count(*) FILTER (t > 0) AS calls FROM l WHERE k <= 20 GROUP BY provider")
def provider_tail_tokens(spark, sf_dir):
    s = _sessions(spark, sf_dir).select("provider", F.col("session_id").alias("seq"), F.when(F.col("session_id") % 7 != 0, F.col("input_tokens")).alias("tokens"))
    return C.tail_tokens(s)


@query("provider_recent_messages", "SELECT count(*) AS messages, count(*) * 1500 AS tokens FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY")
def provider_recent_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("ts") > F.expr("timestamp_ntz'2024-01-30 00:00:00' - INTERVAL 1 DAY"))
    return e.agg(F.count("*").alias("messages"), (F.count("*") * 1500).alias("tokens"))


@query("audit_report", "SELECT 'memories' AS layer, 'rows' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'memories', 'distinct', count(DISTINCT md5(text)) FROM documents UNION ALL SELECT 'vectors', 'rows', count(*) FROM embeddings UNION ALL SELECT 'sessions', 'rows', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'log', 'errors', count(*) FILTER (event_type = 'error') FROM events")
def audit_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    row = lambda df, layer, metric, v: df.agg(v.alias("value")).select(F.lit(layer).alias("layer"), F.lit(metric).alias("metric"), "value")
    out = row(d, "memories", "rows", F.count("*"))
    for x in (row(d, "memories", "distinct", F.countDistinct(F.md5(F.col("text").cast("binary")))), row(table(spark, sf_dir, "embeddings"), "vectors", "rows", F.count("*")), row(table(spark, sf_dir, "conversations"), "sessions", "rows", F.countDistinct("conv_id")), row(table(spark, sf_dir, "events"), "log", "errors", F.count_if(F.col("event_type") == "error"))):
        out = out.unionByName(x)
    return out


@query("ref_ttl_purge", "SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS ref_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
def ref_ttl_purge(spark, sf_dir):
    """References younger than a week."""
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - INTERVAL 7 DAYS"))
    return e.select("event_id", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16).alias("ref_id"))


@query("safe_filenames", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]+', '-', 'g'), 1, 40) || '.md' AS filename FROM pages")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.substring(F.regexp_replace("url", "[^A-Za-z0-9_-]+", "-"), 1, 40), F.lit(".md")).alias("filename"))


@query("task_map", "SELECT conv_id AS session_id, string_agg('T' || CAST(turn AS VARCHAR), ' --> ' ORDER BY turn) AS graph FROM conversations GROUP BY conv_id")
def task_map(spark, sf_dir):
    t = _turns(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return t.select("session_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("T"), x.cast("string"))), " --> ").alias("graph"))


