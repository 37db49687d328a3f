"""Knowledge-graph queries; customers' orders stand for relations that the next order ends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.operators import asof
from recollex.operators import kg as G
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.staging import staged
from recollex.tables import MEMORIES_SQL, memories, quoted, table, texts, texts_sql

QUERIES, ORACLE_SQL, query = register()

_REL = """rel AS (SELECT c_name AS source, 'ordered' AS relation, o_orderpriority AS target, o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS valid_from,
  CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS TIMESTAMP) AS valid_until, CAST(NULL AS VARCHAR) AS invalid_reason
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_AT = "1996-06-01 00:00:00"


def relations(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_name").alias("source"), F.lit("ordered").alias("relation"), F.col("o_orderpriority").alias("target"), "o_orderkey", F.col("o_orderdate").alias("valid_from"), until.alias("valid_until"), F.lit(None).cast("string").alias("invalid_reason"))


def _at():
    return F.lit(_AT).cast("timestamp_ntz")


_VALID = f"(valid_from IS NULL OR (valid_from <= TIMESTAMP '{_AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{_AT}')))"
for _mode, _where in (("snapshot_asof", _VALID), ("current", "valid_until IS NULL"), ("all", "TRUE")):

    def _kg(spark, sf_dir, mode=_mode):
        return G.snapshot(relations(spark, sf_dir), mode.removeprefix("snapshot_"), _at()).select("source", "relation", "target", "o_orderkey")

    QUERIES[f"kg_{_mode}"] = _kg
    ORACLE_SQL[f"kg_{_mode}"] = f"WITH {_REL} SELECT source, relation, target, o_orderkey FROM rel WHERE {_where}"


def _triples_sql(c: str) -> str:
    skip = S.sql_list(K.TRIPLE_SKIP)
    parts = []
    for i, (p, r) in enumerate(K.TRIPLE_PATTERNS):
        a, b = (f"regexp_extract_all({c}, {quoted(p)}, {g}, 'i')" for g in (1, 2))
        parts.append(f"SELECT src, id, {i} AS seq, unnest({a}) AS source, '{r}' AS relation, unnest({b}) AS target FROM texts")
    return f"tri AS (SELECT src, id, seq, trim(source) AS source, relation, trim(target) AS target FROM ({' UNION ALL '.join(parts)}) WHERE NOT list_contains({skip}, lower(trim(source))) AND NOT list_contains({skip}, lower(trim(target))))"


def _triples(spark, sf_dir):
    t = texts(spark, sf_dir, "documents", "conversations").select(F.concat_ws(":", "src", "id").alias("id"), "text")
    return G.extract_triples(t).select(F.split_part("id", F.lit(":"), F.lit(1)).alias("src"), F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("id"), "seq", "source", "relation", "target")


_TRI = f"{texts_sql('documents', 'conversations')}, {_triples_sql('text')}"


@query("kg_triples_extract", f"WITH {_TRI} SELECT * FROM tri")
def kg_triples_extract(spark, sf_dir):
    return _triples(spark, sf_dir)


@query("kg_new_relations", f"WITH {_TRI}, known AS (SELECT DISTINCT source, relation, target FROM tri WHERE src = 'documents') SELECT DISTINCT source, relation, target FROM tri t WHERE src <> 'documents' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source = t.source AND k.relation = t.relation AND k.target = t.target)")
def kg_new_relations(spark, sf_dir):
    """Triples of fixtures and conversations that the documents' graph doesn't have."""
    t = _triples(spark, sf_dir)
    return G.new_relations(t.where("src <> 'documents'"), t.where("src = 'documents'"))


_NORM = r"regexp_replace(lower(trim(name)), '[^\p{L}\p{N}_\x{4e00}-\x{9fff}]', '', 'g')"


@query("kg_entity_upsert", f"WITH m AS (SELECT c_name AS name, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderpriority, CAST(o_orderdate AS TIMESTAMP) FROM orders), e AS (SELECT {_NORM} AS entity_id, ts FROM m) SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mention_count FROM e WHERE entity_id <> '' GROUP BY entity_id")
def kg_entity_upsert(spark, sf_dir):
    r = relations(spark, sf_dir)
    m = r.select(F.col("source").alias("name"), F.col("valid_from").alias("ts")).unionByName(r.select(F.col("target").alias("name"), F.col("valid_from").alias("ts")))
    return G.upsert_entities(m)


_SEARCHED = "lower(regexp_replace(entity, '[^A-Za-z0-9_]', '', 'g')) IN ('customer000000007', 'customer000000010', '1urgent')"
_TOUCH = "t AS (SELECT source AS entity, * FROM v UNION ALL SELECT target AS entity, * FROM v WHERE source <> target)"


@query("kg_search", f"""WITH {_REL}, v AS (SELECT * FROM rel WHERE {_VALID}), {_TOUCH}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY o_orderkey) AS rn FROM t WHERE {_SEARCHED})
SELECT entity, rn, source || ' ordered ' || target || CASE WHEN valid_until IS NULL THEN '' ELSE ' [expired ' || strftime(valid_until, '%Y-%m-%d') || ']' END AS text FROM r WHERE rn <= 8""")
def kg_search(spark, sf_dir):
    """Entities whose name shares a token with the query, at a time, with at most eight relations each."""
    r = relations(spark, sf_dir).withColumnRenamed("o_orderkey", "key")
    return G.search(r, "customer000000007 and customer000000010, 1urgent", _at(), "asof")


_FOUND = f"{_TRI}, d AS (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS ts FROM documents), f AS (SELECT tri.source, tri.relation, tri.target, coalesce(d.ts, TIMESTAMP '2024-01-01') AS ts FROM tri LEFT JOIN d ON tri.src = 'documents' AND d.doc_id = tri.id)"


def _found(spark, sf_dir):
    t = _triples(spark, sf_dir)
    m = memories(spark, sf_dir).select(F.lit("documents").alias("src"), F.col("memory_id").alias("id"), "ts")
    found = t.join(m, ["src", "id"], "left").select("source", "relation", "target", F.coalesce("ts", F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    return staged(found, "found")  # each user reads it more than once, the texts are searched once


_NAME = r"regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_\x{{4e00}}-\x{{9fff}}]', '', 'g')"


@query("kg_add_relations", f"WITH {_FOUND} SELECT {_NAME.format('source')} AS source, relation, {_NAME.format('target')} AS target, min(ts) AS valid_from FROM f WHERE relation <> 'uses' GROUP BY 1, 2, 3")
def kg_add_relations(spark, sf_dir):
    """Relations that texts bring into a graph that has all `uses` relations already."""
    f = _found(spark, sf_dir)
    have = G.add_triples(f.where("relation = 'uses'"), None, _no_relations(spark))[1]
    return G.add_triples(f, None, have)[1].select("source", "relation", "target", "valid_from")


def _no_relations(spark):
    return spark.createDataFrame([], "source string, relation string, target string")


@query("kg_add_entities", f"WITH {_FOUND}, e AS (SELECT {_NAME.format('source')} AS entity_id, ts FROM f UNION ALL SELECT {_NAME.format('target')}, ts FROM f) SELECT entity_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS mention_count FROM e WHERE entity_id <> '' GROUP BY entity_id")
def kg_add_entities(spark, sf_dir):
    return G.add_triples(_found(spark, sf_dir), None, _no_relations(spark))[0]


@query("kg_entity_history", f"WITH {_REL}, v AS (SELECT * FROM rel), {_TOUCH} SELECT entity, source, target, o_orderkey, valid_from, valid_until, CASE WHEN valid_until IS NULL THEN 'active' ELSE 'expired' END AS state, row_number() OVER (PARTITION BY entity ORDER BY valid_from, o_orderkey) AS place FROM t WHERE entity <> target")
def kg_entity_history(spark, sf_dir):
    """The timelines of all customers."""
    h = relations(spark, sf_dir).withColumn("entity", F.col("source"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("valid_from", "o_orderkey"))
    return h.select("entity", "source", "target", "o_orderkey", "valid_from", "valid_until", F.when(F.col("valid_until").isNull(), "active").otherwise("expired").alias("state"), place.cast("long").alias("place"))


_INV = "SELECT source, relation, target, o_orderkey, CASE WHEN valid_until IS NULL AND {0} THEN TIMESTAMP '2000-01-01' ELSE valid_until END AS valid_until, CASE WHEN valid_until IS NULL AND {0} THEN '{1}' END AS invalid_reason FROM rel"


@query("kg_invalidate_relation", f"WITH {_REL} " + _INV.format("target = '1-URGENT'", "superseded"))
def kg_invalidate_relation(spark, sf_dir):
    r = G.invalidate(relations(spark, sf_dir), F.col("target") == "1-URGENT", F.lit("2000-01-01").cast("timestamp_ntz"), "superseded")
    return r.select("source", "relation", "target", "o_orderkey", "valid_until", "invalid_reason")


@query("kg_invalidate_entity", f"WITH {_REL} " + _INV.format("(source = 'Customer#000000007' OR target = 'Customer#000000007')", "entity gone"))
def kg_invalidate_entity(spark, sf_dir):
    name = F.lit("Customer#000000007")
    r = G.invalidate(relations(spark, sf_dir), (F.col("source") == name) | (F.col("target") == name), F.lit("2000-01-01").cast("timestamp_ntz"), "entity gone")
    return r.select("source", "relation", "target", "o_orderkey", "valid_until", "invalid_reason")


@query("kg_cross_scene_tunnels", f"WITH {MEMORIES_SQL}, e AS (SELECT DISTINCT scene, unnest({S.scene_tokens('summary')}) AS entity FROM memories) SELECT a.scene AS source, b.scene AS target, min(a.entity) AS entity FROM e a JOIN e b ON a.entity = b.entity AND a.scene < b.scene GROUP BY 1, 2")
def kg_cross_scene_tunnels(spark, sf_dir):
    from recollex.functions import text

    m = memories(spark, sf_dir).select("scene", F.explode(text.scene_tokens(F.col("summary"))).alias("entity"))
    return G.cross_scene_tunnels(m)


@query("kg_stats", f"WITH {_REL} SELECT count(*) AS relations, count(DISTINCT source) AS entities, count(*) FILTER (valid_until IS NULL) AS active, count(*) FILTER (valid_until IS NOT NULL) AS expired FROM rel")
def kg_stats(spark, sf_dir):
    return relations(spark, sf_dir).agg(F.count("*").alias("relations"), F.countDistinct("source").alias("entities"), F.count_if(F.col("valid_until").isNull()).alias("active"), F.count_if(F.col("valid_until").isNotNull()).alias("expired"))


@query("kg_top_entities", f"WITH {_REL} SELECT source AS entity, count(*) AS mentions FROM rel GROUP BY source ORDER BY mentions DESC, source LIMIT 5")
def kg_top_entities(spark, sf_dir):
    return relations(spark, sf_dir).groupBy(F.col("source").alias("entity")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity").limit(5)


@query("kg_backfill", f"WITH {_REL} SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE valid_from END, TIMESTAMP '1990-01-01') AS valid_from FROM rel")
def kg_backfill(spark, sf_dir):
    r = relations(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("valid_from")).alias("valid_from"), F.lit("1990-01-01").cast("timestamp_ntz").alias("created"))
    return G.backfill(r, "created").select("o_orderkey", "valid_from")


#: Events look back from their own year to those of the orders.
_BACK = "(event_id % 7 + 25)"
_EVENTS = f"ev AS (SELECT event_id, user_id, ts - to_years(CAST({_BACK} AS INTEGER)) AS at FROM events)"
_HOLDS = "(r.valid_from IS NULL OR (r.valid_from <= ev.at AND (r.valid_until IS NULL OR r.valid_until > ev.at)))"


def _times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.expr(f"cast(ts as timestamp_ntz) - make_ym_interval(cast({_BACK} as int), 0)").alias("at"))


def _some_unknown(spark, sf_dir):
    """Relations by customer; of every eleventh order the start is unknown."""
    o = table(spark, sf_dir, "orders")
    until = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    known = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))
    return o.select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderpriority", known.alias("valid_from"), until.alias("valid_until"))


_UNKNOWN = "r AS (SELECT o_custkey AS user_id, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_until FROM orders)"


@query("kg_asof_events", f"WITH {_EVENTS}, {_UNKNOWN} SELECT event_id, o_orderkey, o_orderpriority FROM ev JOIN r ON ev.user_id = r.user_id AND {_HOLDS}")
def kg_asof_events(spark, sf_dir):
    """The relations of each event's user that held at its time."""
    return asof.join(_times(spark, sf_dir), _some_unknown(spark, sf_dir), ["user_id"]).select("event_id", "o_orderkey", "o_orderpriority")


@query("kg_asof_counts", f"WITH {_EVENTS}, {_UNKNOWN} SELECT event_id, (SELECT count(*) FROM r WHERE r.valid_from IS NULL) + coalesce(n, 0) AS valid FROM ev LEFT JOIN (SELECT event_id, count(*) AS n FROM ev JOIN r ON r.valid_from <= ev.at AND coalesce(r.valid_until, TIMESTAMP '9999-01-01') > ev.at GROUP BY 1) USING (event_id)")
def kg_asof_counts(spark, sf_dir):
    """How many relations of all customers held at each event's time."""
    return asof.counts(_times(spark, sf_dir), _some_unknown(spark, sf_dir)).select("event_id", "valid")


@query("kg_asof_user_counts", f"WITH {_EVENTS}, {_UNKNOWN} SELECT event_id, count(r.o_orderkey) AS valid FROM ev LEFT JOIN r ON ev.user_id = r.user_id AND {_HOLDS} GROUP BY event_id")
def kg_asof_user_counts(spark, sf_dir):
    """The same for the event's user alone."""
    return asof.counts(_times(spark, sf_dir), _some_unknown(spark, sf_dir), ["user_id"]).select("event_id", "valid")
