"""Lifecycle queries; users stand for memories where accesses matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex import consts as K
from recollex.operators import kg
from recollex.operators import lifecycle as L
from recollex.plans import sqltext as S
from recollex.plans.kg import _triples_sql
from recollex.plans.register import register
from recollex.tables import MEMORIES_SQL, memories, table

QUERIES, ORACLE_SQL, query = register()
#: A week after the last events' day, so that some users' scenes are hot and some are not.
AS_OF = "2024-02-06 12:00:00"
SCENES = {"spam": ["http", "www"], "code": ["the and", "ing the"], "mail": ["@"]}


@query("scene_keywords_band", f"WITH {MEMORIES_SQL}, w AS (SELECT DISTINCT memory_id, unnest({S.scene_tokens('summary')}) AS keyword FROM memories) SELECT keyword, count(*) AS n FROM w GROUP BY keyword HAVING count(*) >= 2 AND count(*) <= greatest(1, floor((SELECT count(*) FROM memories) * 0.3))")
def scene_keywords_band(spark, sf_dir):
    return L.scene_keywords(memories(spark, sf_dir))


_SCENE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(summary), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in SCENES.items()) + " ELSE 'general' END"


@query("scene_assign", f"WITH {MEMORIES_SQL} SELECT memory_id, {_SCENE} AS scene FROM memories")
def scene_assign(spark, sf_dir):
    return memories(spark, sf_dir).select("memory_id", L.assign_scene(F.col("summary"), SCENES).alias("scene"))


@query("scene_index", f"WITH {MEMORIES_SQL} SELECT scene, count(*) AS n, min(memory_id) AS first_id, max(memory_id) AS last_id, CAST(sum(memory_id) AS BIGINT) AS ids_sum FROM memories GROUP BY scene")
def scene_index(spark, sf_dir):
    """Scenes with digests of their members that merge; the members themselves are rows of `scene_assign`."""
    return memories(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"), F.max("memory_id").alias("last_id"), F.sum("memory_id").alias("ids_sum"))


_ACCESS = "acc AS (SELECT user_id, CAST(user_id AS VARCHAR) AS scene, ts FROM events WHERE event_type <> 'error')"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _access(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type <> 'error'").select("user_id", F.col("user_id").cast("string").alias("scene"), "ts")


_HOT = f"hot AS (SELECT scene, max(ts) AS last FROM acc GROUP BY scene HAVING max(ts) > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS)"


@query("hot_scenes", f"WITH {_ACCESS}, {_HOT} SELECT scene, last FROM hot")
def hot_scenes(spark, sf_dir):
    return L.hot_scenes(_access(spark, sf_dir), _as_of())


_TREND = """r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS p FROM acc),
g AS (SELECT user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 3.6e9 AS gap FROM r WHERE p <= 20),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM g WHERE gap > 0),
a AS (SELECT user_id, count(*) AS n_gaps, median(gap) AS median_gap, avg(gap) FILTER (i <= floor(m / 2)) AS early, avg(gap) FILTER (i > floor(m / 2)) AS late FROM q GROUP BY user_id),
trend AS (SELECT u.user_id, coalesce(n_gaps, 0) AS n_gaps, median_gap, CASE WHEN coalesce(n_gaps, 0) < 2 THEN 'insufficient' WHEN late > early * 1.5 THEN 'widening' ELSE 'stable' END AS trend
  FROM (SELECT DISTINCT user_id FROM acc) u LEFT JOIN a USING (user_id))"""


@query("access_density_trend", f"WITH {_ACCESS}, {_TREND} SELECT user_id, n_gaps, round(median_gap, 4) AS median_gap, trend FROM trend")
def access_density_trend(spark, sf_dir):
    t = L.density_trend(_access(spark, sf_dir))
    return t.select("user_id", "n_gaps", F.round("median_gap", 4).alias("median_gap"), "trend")


@query("access_ring_buffer", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20")
def access_ring_buffer(spark, sf_dir):
    r = L.ring_buffer(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], K.RING["access"])
    return r.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


_MEM = "mem AS (SELECT user_id AS memory_id, user_id % 5 AS access_count, TIMESTAMP '2023-11-01' + to_days(CAST(user_id % 60 AS INTEGER)) AS last_accessed, user_id % 4 = 0 AS demoted FROM (SELECT DISTINCT user_id FROM events))"


def _mem(spark, sf_dir):
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    at = F.expr("timestampadd(DAY, cast(user_id % 60 as int), timestamp_ntz'2023-11-01 00:00:00')")
    return u.select(F.col("user_id").alias("memory_id"), (F.col("user_id") % 5).alias("access_count"), at.alias("last_accessed"), (F.col("user_id") % 4 == 0).alias("demoted"))


@query("track_access", f"WITH {_MEM}, x AS (SELECT user_id, count(*) AS more, max(ts) AS seen FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT memory_id, access_count + coalesce(more, 0) AS access_count, coalesce(seen, last_accessed) AS last_accessed, demoted AND seen IS NULL AS demoted FROM mem LEFT JOIN x ON memory_id = user_id")
def track_access(spark, sf_dir):
    a = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("memory_id"), "ts")
    return L.track_access(_mem(spark, sf_dir), a)


_DECIDE = f"""WITH {_ACCESS}, {_HOT}, {_TREND}, {_MEM.replace("user_id % 60", "user_id % 90")},
d AS (SELECT memory_id, CAST(memory_id AS VARCHAR) AS scene, demoted, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_accessed)) / 86400000000.0 AS days, (SELECT count(*) FILTER (NOT demoted) FROM mem) AS active FROM mem),
dec AS (SELECT d.memory_id, d.scene, CASE WHEN demoted THEN CASE WHEN days >= 60 THEN 'archive' ELSE 'stays_demoted' END WHEN active <= 15 THEN 'kept_few' WHEN days <= 14 THEN 'kept_window'
  WHEN hot.scene IS NOT NULL THEN 'protected' WHEN trend = 'stable' THEN 'kept_density' ELSE 'demote' END AS decision FROM d LEFT JOIN hot USING (scene) LEFT JOIN trend ON trend.user_id = d.memory_id)"""


def _decisions(spark, sf_dir):
    at = F.expr("timestampadd(DAY, cast(memory_id % 90 as int), timestamp_ntz'2023-11-01 00:00:00')")
    m = _mem(spark, sf_dir).withColumn("last_accessed", at).withColumn("scene", F.col("memory_id").cast("string"))
    access = _access(spark, sf_dir)
    trends = L.density_trend(access).withColumnRenamed("user_id", "memory_id")
    return L.forgetting_decisions(m, L.hot_scenes(access, _as_of()), trends, _as_of())


@query("forgetting_decisions", _DECIDE + " SELECT memory_id, scene, decision FROM dec")
def forgetting_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query("forgetting_report", _DECIDE + " SELECT decision, count(*) AS n FROM dec GROUP BY decision")
def forgetting_report(spark, sf_dir):
    return _decisions(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"))


@query("forget_history", _DECIDE + " SELECT memory_id, scene, decision FROM dec WHERE decision IN ('demote', 'archive') ORDER BY memory_id DESC LIMIT 5")
def forget_history(spark, sf_dir):
    return _decisions(spark, sf_dir).where(F.col("decision").isin("demote", "archive")).orderBy(F.desc("memory_id")).limit(5)


#: Memories in their life: some were accessed long ago, every ninth is demoted, and the scenes with a memory of the last
#: hours are hot.
FATE = "2024-02-06 20:30:00"
_LIFE = f"""{MEMORIES_SQL}, life AS (SELECT memory_id, source AS scene, ts, summary, text, memory_id % 9 = 0 AS demoted, TIMESTAMP '{FATE}' - to_days(CAST(memory_id % 90 AS INTEGER)) AS last_accessed FROM memories),
seen AS (SELECT source AS scene, max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER))) AS last FROM documents GROUP BY source HAVING max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER))) > TIMESTAMP '{FATE}' - INTERVAL 7 DAYS),
fate AS (SELECT *, CASE WHEN demoted THEN CASE WHEN memory_id % 90 >= 60 THEN 'archive' ELSE 'stays_demoted' END WHEN (SELECT count(*) FILTER (NOT demoted) FROM life) <= 15 THEN 'kept_few' WHEN memory_id % 90 <= 14 THEN 'kept_window'
  WHEN scene IN (SELECT scene FROM seen) THEN 'protected' ELSE 'demote' END AS decision FROM life)"""


def _life(spark, sf_dir):
    m = memories(spark, sf_dir)
    at = F.expr(f"timestampadd(DAY, cast(-(memory_id % 90) as int), timestamp_ntz'{FATE}')")
    return m.withColumn("scene", F.col("source")).withColumn("demoted", F.col("memory_id") % 9 == 0).withColumn("last_accessed", at)


def _fate(spark, sf_dir):
    m = _life(spark, sf_dir)
    trends = spark.createDataFrame([], "memory_id long, trend string")
    return L.forgetting_decisions(m, L.hot_scenes(m.select("scene", "ts"), F.lit(FATE).cast("timestamp_ntz")), trends, F.lit(FATE).cast("timestamp_ntz"))


_DISTIL = f"{_LIFE}, texts AS (SELECT 'm' AS src, memory_id AS id, text FROM fate WHERE decision = 'demote'), {_triples_sql('text')}"


@query("distill_demoted", f"WITH {_DISTIL} SELECT tri.source, tri.relation, tri.target, min(m.ts) AS valid_from FROM tri JOIN memories m ON m.memory_id = tri.id GROUP BY 1, 2, 3")
def distill_demoted(spark, sf_dir):
    """Triples of the memories that are about to be demoted, valid from the memory's time, each once."""
    gone = _fate(spark, sf_dir).where("decision = 'demote'").select("memory_id")
    m = memories(spark, sf_dir).join(gone, "memory_id", "left_semi")
    t = m.select("ts", F.explode(kg.triples(F.col("text"))).alias("x"))
    return t.groupBy("x.source", "x.relation", "x.target").agg(F.min("ts").alias("valid_from"))


@query("forget_rows", f"WITH {_LIFE} SELECT memory_id, decision = 'demote' OR demoted AS demoted, decision = 'archive' AS archivable FROM fate")
def forget_rows(spark, sf_dir):
    """What the decisions write into the memories."""
    d = _fate(spark, sf_dir)
    m = _life(spark, sf_dir).select("memory_id", "demoted").join(d.select("memory_id", "decision"), "memory_id")
    return m.select("memory_id", (F.col("demoted") | (F.col("decision") == "demote")).alias("demoted"), (F.col("decision") == "archive").alias("archivable"))


_KEYS = f"{MEMORIES_SQL}, k AS (SELECT memory_id, {S.keywords('summary')} AS k FROM memories), s AS (SELECT memory_id, len(k) AS n, unnest(k) AS w FROM k WHERE len(k) >= 3), p AS (SELECT a.memory_id AS a, b.memory_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.w = b.w AND a.memory_id < b.memory_id GROUP BY 1, 2)"


@query("merge_pairs_jaccard", f"WITH {_KEYS} SELECT a, b, round(i / (na + nb - i), 6) AS jaccard FROM p WHERE i / (na + nb - i) >= 0.25")
def merge_pairs_jaccard(spark, sf_dir):
    return L.keyword_pairs(memories(spark, sf_dir)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _mergeable(spark, sf_dir):
    """Memories, of which every ninth is demoted and every eleventh merged before, so that neither is a candidate."""
    return _life(spark, sf_dir).withColumn("merged_into", F.when(F.col("memory_id") % 11 == 5, "MERGE-0")).withColumn("is_merged", F.lit(False))


def _groups(spark, sf_dir):
    m = L.merge_candidates(_mergeable(spark, sf_dir))
    return L.class_groups(*L.keyword_classes(m))


_CAND = _KEYS.replace("FROM memories), s AS", "FROM memories WHERE memory_id % 9 <> 0 AND memory_id % 11 <> 5), s AS") + ", e AS MATERIALIZED (SELECT a, b FROM p WHERE i / (na + nb - i) >= 0.25)"
#: The greedy pass as a recursion: each step takes the least id that begins pairs and isn't used, with its unused partners.
_GREEDY = f"""WITH RECURSIVE {_CAND}, adj AS MATERIALIZED (SELECT a, list(b ORDER BY b) AS bs FROM e GROUP BY a),
g(leader, members, used) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT x.a, x.free, list_concat(g.used, list_concat([x.a], x.free))
  FROM g, LATERAL (SELECT adj.a, list_filter(adj.bs, lambda v: NOT list_contains(g.used, v)) AS free FROM adj WHERE adj.a > g.leader AND NOT list_contains(g.used, adj.a) ORDER BY adj.a LIMIT 1) x
),
grp AS (SELECT leader, list_concat([leader], members)[1:5] AS ids FROM g WHERE leader >= 0 AND len(members) > 0)"""


@query("merge_groups", _GREEDY + " SELECT leader, unnest(ids) AS memory_id, unnest(range(len(ids))) AS place FROM grp")
def merge_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("leader", "memory_id", F.col("place").cast("long").alias("place"))


_MKEY = "'MERGE-' || substr(sha256(array_to_string(list_sort(ids), ',')), 1, 16)"


@query("merge_marks", _GREEDY + f" SELECT unnest(ids) AS memory_id, {_MKEY} AS merged_into FROM grp")
def merge_marks(spark, sf_dir):
    return L.merge_marks(_groups(spark, sf_dir))


_WORDSOF = f"list_sort({S.keywords('summaries')})"
_TITLED = _GREEDY + f", u AS (SELECT leader, ids, unnest(ids) AS memory_id, unnest(range(len(ids))) AS place FROM grp), j AS (SELECT leader, any_value(ids) AS ids, string_agg(summary, ' ' ORDER BY place) AS summaries, max(ts) AS ts, string_agg('• [' || strftime(ts, '%Y-%m-%d') || '] (' || source || ') ' || substr(summary, 1, 150), chr(10) ORDER BY ts DESC, place) AS lines FROM u JOIN memories USING (memory_id) GROUP BY leader)"


@query("merge_dry_run", _TITLED + f" SELECT leader, len(ids) AS count, array_to_string(ids, ',') AS ids, array_to_string({_WORDSOF}[1:5], '|') AS topics FROM j")
def merge_dry_run(spark, sf_dir):
    return L.merge_dry_run(_groups(spark, sf_dir), memories(spark, sf_dir))


@query("merge_composites", _TITLED + f" SELECT {_MKEY} AS id, ts, 'merge' AS source, '[merged] ' || array_to_string({_WORDSOF}[1:3], ', ') || ' - ' || CAST(len(ids) AS VARCHAR) || ' related' AS summary, array_to_string(list_sort(ids), ',') AS merged_ids, md5(lines) AS expandable_md5 FROM j")
def merge_composites(spark, sf_dir):
    m = L.merged_rows(_groups(spark, sf_dir), memories(spark, sf_dir))
    return m.select("id", "ts", "source", "summary", "merged_ids", F.md5(F.col("expandable").cast("binary")).alias("expandable_md5"))


@query("scene_incremental", f"WITH {MEMORIES_SQL} SELECT memory_id, {_SCENE} AS scene FROM memories WHERE ts > TIMESTAMP '2024-01-20' OR scene IS NULL")
def scene_incremental(spark, sf_dir):
    """Scenes of memories past the high-watermark or without a scene."""
    m = memories(spark, sf_dir).where((F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")) | F.col("scene").isNull())
    return m.select("memory_id", L.assign_scene(F.col("summary"), SCENES).alias("scene"))


@query("latest_active_memories", f"WITH {_LIFE} SELECT memory_id, ts, substr(summary, 1, 60) AS head FROM life WHERE NOT demoted ORDER BY ts DESC, memory_id DESC LIMIT 5")
def latest_active_memories(spark, sf_dir):
    m = _life(spark, sf_dir).where(~F.col("demoted"))
    return m.select("memory_id", "ts", F.substring("summary", 1, 60).alias("head")).orderBy(F.desc("ts"), F.desc("memory_id")).limit(5)
