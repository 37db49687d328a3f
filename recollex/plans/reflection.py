"""Reflection and learning queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import reflection as R
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.tables import FIXTURES_SQL, fixtures, quoted, table, texts, texts_sql

QUERIES, ORACLE_SQL, query = register()

#: Notes: documents, a third of them praised and a third blamed, so that moods meet.
_NOTES = f"""n0 AS (SELECT doc_id AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS day, text || CASE doc_id % 3 WHEN 0 THEN ' I like it' WHEN 1 THEN ' it is bad' ELSE '' END AS t FROM documents),
notes AS (SELECT id, day, {S.topics('t')} AS topics, {S.sentiment('t')} AS mood FROM n0)"""
#: Notes of documents' summaries.
_HEADS = _NOTES.replace("text || CASE", "substr(text, 1, 500) || CASE")


def _notes(spark, sf_dir, body: Column | str = "text"):
    d = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, " I like it").when(F.col("doc_id") % 3 == 1, " it is bad").otherwise("")
    n = d.select(F.col("doc_id").alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"), F.concat(body, tail).alias("t"))
    return n.select("id", "day", text.topics(F.col("t")).alias("topics"), text.sentiment(F.col("t")).alias("mood"))


@query("contradictions", f"WITH {_NOTES}, x AS (SELECT id, day, mood, unnest(topics) AS topic FROM notes WHERE mood <> 'neutral'), m AS (SELECT a.id AS id_a, b.id AS id_b, a.day AS day_a, b.day AS day_b, min(a.topic) AS topic FROM x a JOIN x b ON a.topic = b.topic AND a.day < b.day AND a.mood <> b.mood GROUP BY 1, 2, 3, 4), r AS (SELECT topic, day_a, day_b, min({{'a': id_a, 'b': id_b}}) AS x FROM m GROUP BY 1, 2, 3) SELECT topic, x.a AS id_a, x.b AS id_b, CAST(day_a AS VARCHAR) AS day_a, CAST(day_b AS VARCHAR) AS day_b FROM r")
def contradictions(spark, sf_dir):
    c = R.contradictions(_notes(spark, sf_dir))
    return c.withColumns({"day_a": F.col("day_a").cast("string"), "day_b": F.col("day_b").cast("string")})


@query("connections", f"WITH {_HEADS}, x AS (SELECT day, unnest(topics) AS topic FROM notes) SELECT topic, count(*) AS mentions, count(DISTINCT day) AS days, CAST(max(day) - min(day) AS BIGINT) AS span FROM x GROUP BY topic HAVING count(DISTINCT day) >= 2 ORDER BY days DESC, mentions DESC, topic LIMIT 5")
def connections(spark, sf_dir):
    return R.connections(_notes(spark, sf_dir, F.substring("text", 1, 500))).orderBy(F.desc("days"), F.desc("mentions"), "topic").limit(5)


@query("topics", f"WITH {texts_sql('documents', 'conversations')} SELECT src, id, array_to_string({S.topics('text')}, '|') AS topics FROM texts")
def topics(spark, sf_dir):
    """Topics of whole texts, CJK terms among them."""
    return texts(spark, sf_dir, "documents", "conversations").select("src", "id", F.array_join(text.topics(F.col("text")), "|").alias("topics"))


_REPORT = f"""{_NOTES}, x AS (SELECT id, day, mood, unnest(topics) AS topic FROM notes), m AS (SELECT a.id AS id_a, b.id AS id_b, a.day AS day_a, b.day AS day_b, min(a.topic) AS topic FROM x a JOIN x b ON a.topic = b.topic AND a.day < b.day AND a.mood <> b.mood WHERE a.mood <> 'neutral' AND b.mood <> 'neutral' GROUP BY 1, 2, 3, 4),
c AS (SELECT DISTINCT topic, day_a, day_b FROM m), k AS (SELECT topic, count(*) AS mentions, count(DISTINCT day) AS days, CAST(max(day) - min(day) AS BIGINT) AS span FROM x GROUP BY topic HAVING count(DISTINCT day) >= 2)"""


@query("reflection_report", f"WITH {_REPORT} (SELECT 'conflict' AS kind, topic || ': ' || CAST(day_a AS VARCHAR) || ' and ' || CAST(day_b AS VARCHAR) AS line FROM c ORDER BY day_b DESC, topic, day_a LIMIT 5) UNION ALL (SELECT 'link', topic || ': ' || CAST(mentions AS VARCHAR) || ' mentions on ' || CAST(days AS VARCHAR) || ' days over ' || CAST(span AS VARCHAR) FROM k ORDER BY days DESC, mentions DESC, topic LIMIT 5) UNION ALL SELECT 'summary', CAST((SELECT count(*) FROM c) AS VARCHAR) || ' conflicts, ' || CAST((SELECT count(*) FROM k) AS VARCHAR) || ' links'")
def reflection_report(spark, sf_dir):
    """The newest conflicts, the strongest links, and how many there are."""
    return R.report(_notes(spark, sf_dir))


@query("sentiment", f"WITH {texts_sql('documents')} SELECT src, id, {S.sentiment('text')} AS mood FROM texts")
def sentiment(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("src", "id", text.sentiment(F.col("text")).alias("mood"))


_LAST = "substr(list_extract(string_split(lower(trim(text)), chr(10)), -1), 1, 300)"
_VETO = " OR ".join(f"regexp_matches(l, {quoted(p)})" for p in K.CORRECTION_IGNORE)
_HITS = f"CASE WHEN {_VETO} THEN [] ELSE list_filter({S.sql_list(K.CORRECTION_SIGNALS)}, lambda s: contains(l, s)) END"


@query("correction_detect", f"WITH {texts_sql('conversations')}, x AS (SELECT src, id, {_LAST} AS l FROM texts), h AS (SELECT src, id, {_HITS} AS h FROM x) SELECT src, id, array_to_string(h, '|') AS signals FROM h WHERE len(h) > 0")
def correction_detect(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations").withColumn("signals", text.held(text.correction_signals(F.col("text"))))
    return t.where(F.size("signals") > 0).select("src", "id", F.array_join("signals", "|").alias("signals"))


_LESSON = "coalesce('User: ' || substr(trim(coalesce(" + ", ".join(f"nullif(regexp_extract(text, {quoted(p)}, 1, 'i'), '')" for p in K.LESSON_PATTERNS) + ")), 1, 60), substr(trim(text), 1, 80))"


@query("lesson_extract", f"WITH {texts_sql('conversations')} SELECT src, id, {_LESSON} AS lesson FROM texts")
def lesson_extract(spark, sf_dir):
    return texts(spark, sf_dir, "conversations").select("src", "id", text.lesson(F.col("text")).alias("lesson"))


_PROFILE = " UNION ALL ".join(f"SELECT src, id, {i} AS seq, '{f}' AS field, trim(regexp_extract(text, {quoted(p)}, 1, 'i')) AS value FROM texts" for i, (p, f) in enumerate(K.PROFILE_PATTERNS))


@query("profile_extract", f"WITH {texts_sql('conversations')}, p AS ({_PROFILE}) SELECT src, id, seq, field, value FROM p WHERE value <> '' AND NOT list_contains({S.sql_list(K.PROFILE_SKIP)}, lower(value))")
def profile_extract(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations").select("src", "id", F.explode(text.profile_values(F.col("text"))).alias("x"))
    return t.select("src", "id", "x.seq", "x.field", "x.value")


_SEEN = "SELECT event_type || '/' || CAST(user_id % 40 AS VARCHAR) AS lesson FROM events"


def _lessons(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return R.lesson_counts(e.select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 40).cast("string")).alias("lesson")))


@query("lesson_promotion", f"SELECT lesson, count(*) AS count, count(*) >= 3 AS promoted FROM ({_SEEN}) GROUP BY lesson")
def lesson_promotion(spark, sf_dir):
    return _lessons(spark, sf_dir)


#: The tables have no CJK texts, so each word of a user turn is written as the sign that its digest names, of 20,000.
_SIGNED = f"""{FIXTURES_SQL}, signed AS (SELECT id, text AS lesson FROM fixtures UNION ALL SELECT conv_id * 100 + turn, array_to_string(list_transform(string_split(text, ' '), lambda w: chr(CAST(19968 + CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 20000 AS INTEGER))), '') FROM conversations WHERE role = 'user')"""


def _signed(spark, sf_dir):
    code = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("long") % 20000 + 19968
    sign = lambda w: F.decode(F.unhex(F.hex(code(w))), "UTF-16BE")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    lesson = F.array_join(F.transform(F.split("text", " "), sign), "")
    return fixtures(spark).withColumnRenamed("text", "lesson").unionByName(turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), lesson.alias("lesson")))


@query("lesson_similarity_pairs", f"WITH {_SIGNED}, c AS (SELECT id, list_distinct(regexp_extract_all(lesson, '{S.CJK}')) AS c FROM signed), e AS (SELECT id, len(c) AS n, unnest(c) AS w FROM c) SELECT a.id AS a, b.id AS b, round(count(*) / greatest(any_value(a.n), any_value(b.n)), 6) AS overlap FROM e a JOIN e b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2 HAVING count(*) / greatest(any_value(a.n), any_value(b.n)) > 0.15")
def lesson_similarity_pairs(spark, sf_dir):
    """Pairs of lessons that share signs; a turn's lesson has a sign for each of its words."""
    p = R.lesson_pairs(_signed(spark, sf_dir), 0.15)
    return p.select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("lesson_classes", f"WITH {_SIGNED}, c AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lesson, '{S.CJK}'))) AS c FROM signed), r AS (SELECT id, c, min(id) OVER (PARTITION BY c) AS rep FROM c WHERE len(c) > 0), e AS (SELECT id, len(c) AS n, unnest(c) AS w FROM r WHERE id = rep), m AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.w = b.w AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) / greatest(any_value(a.n), any_value(b.n)) > 0.15), k AS (SELECT a, count(*) AS links FROM m GROUP BY a) SELECT id, rep, coalesce(links, 0) AS links FROM r LEFT JOIN k ON a = rep")
def lesson_classes(spark, sf_dir):
    """Each lesson's class and the number of other classes that are close to it; copies make no pairs."""
    members, close = R.lesson_classes(_signed(spark, sf_dir), 0.15)
    links = close.select(F.explode(F.array("ra", "rb")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


#: One user turn after the other: a list of kept lessons grows, or one of them is counted again.
_LEARN = f"""seen AS (SELECT CAST(floor(id / 100) AS BIGINT) AS user_id, id AS seq, {_LESSON} AS lesson FROM (SELECT id, text, {_HITS} AS h FROM (SELECT id, text, {_LAST} AS l FROM texts)) WHERE len(h) > 0),
ls AS (SELECT *, list_distinct(regexp_extract_all(lesson, '{S.CJK}')) AS c, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM seen),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(lesson VARCHAR, c VARCHAR[], n BIGINT)[]) AS kept FROM ls
 UNION ALL SELECT user_id, k, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, {{'lesson': lesson, 'c': c, 'n': CAST(1 AS BIGINT)}}) ELSE list_transform(kept, lambda v, i: {{'lesson': v.lesson, 'c': v.c, 'n': v.n + CASE WHEN i = hit THEN 1 ELSE 0 END}}) END
 FROM (SELECT ls.*, w.kept, list_position(list_transform(w.kept, lambda v: v.lesson = ls.lesson OR CASE WHEN len(v.c) > 0 AND len(ls.c) > 0 THEN len(list_intersect(v.c, ls.c)) / greatest(len(v.c), len(ls.c)) > 0.3 ELSE false END), true) AS hit FROM w JOIN ls ON ls.user_id = w.user_id AND ls.k = w.k + 1)),
fin AS (SELECT user_id, max_by(kept, k) AS kept FROM w GROUP BY user_id), one AS (SELECT user_id, unnest(range(1, len(kept) + 1)) AS i, unnest(kept) AS x FROM fin)"""


@query("learn_lessons", f"WITH RECURSIVE {texts_sql('conversations')}, {_LEARN} SELECT user_id, printf('LSN-%03d', i) AS lesson_id, x.lesson AS lesson, x.n AS count, x.n >= 3 AS promoted FROM one")
def learn_lessons(spark, sf_dir):
    t = texts(spark, sf_dir, "conversations").where(F.size(text.correction_signals(F.col("text"))) > 0)
    return R.learn(t.select(F.floor(F.col("id") / 100).alias("user_id"), F.col("id").alias("seq"), text.lesson(F.col("text")).alias("lesson")))


_HEAD = r"regexp_extract(substr(text, 1, 30), '^\s*([^\s，。！？、!?.]{1,10})[，。！？、!?.]', 1)"


@query("learned_signals", f"WITH {texts_sql('conversations')}, h AS (SELECT DISTINCT {_HEAD} AS signal FROM texts) SELECT unnest({S.sql_list(K.CORRECTION_SIGNALS)}) AS signal UNION ALL SELECT signal FROM h WHERE signal <> '' AND NOT list_contains({S.sql_list([*R.TRIGGER_STOP, *K.CORRECTION_SIGNALS])}, signal)")
def learned_signals(spark, sf_dir):
    """Built-in signals and those learned from messages, as a bag."""
    base = spark.range(1).select(F.explode(text.constant_list(K.CORRECTION_SIGNALS)).alias("signal"))
    return base.unionByName(R.trigger_words(texts(spark, sf_dir, "conversations"), K.CORRECTION_SIGNALS))
