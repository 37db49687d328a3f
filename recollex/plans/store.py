"""Queries over the stored index: lookups, joins of vectors, hits and memories, upkeep, guards and rebuilds."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.functions import text
from recollex.operators import blockindex
from recollex.operators import index as I
from recollex.operators import retrieval as R
from recollex.operators import tunnels
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.plans.retrieval import _COSQL, _ENT, _SW, QUERY, TERMS, _bm25_sql, _cosines, _entities
from recollex.plans.stored import index_of, new_table
from recollex.sources import commits
from recollex.tables import AS_OF, MEMORIES_SQL, as_of, memories, table

QUERIES, ORACLE_SQL, query = register()
_HITS = f"{_bm25_sql(TERMS)}, hits AS (SELECT memory_id, round(bm25, 6) AS bm25, matched FROM bm WHERE matched > 0 ORDER BY round(bm25, 6) DESC, memory_id LIMIT 20)"


def _lookup(spark, sf_dir, most=20):
    return blockindex.search(spark, index_of(spark, sf_dir), QUERY, most)


@query("fts_index_search", f"WITH {_HITS} SELECT memory_id, source, bm25, matched FROM hits JOIN memories USING (memory_id)")
def fts_index_search(spark, sf_dir):
    """Four times the five wanted hits, from postings alone, joined with their memories."""
    hits = _lookup(spark, sf_dir).select("memory_id", F.round("bm25", 6).alias("bm25"), "matched")
    return hits.join(memories(spark, sf_dir).select("memory_id", "source"), "memory_id")


_FULL = "coalesce(CASE WHEN length(m.summary) > 100 THEN m.summary END, 'vector ' || CAST(e.vec_id AS VARCHAR))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("summary"))


@query("hybrid_join_candidates", f"WITH {_HITS} SELECT e.vec_id AS memory_id, coalesce(h.bm25, 0.0) AS bm25, m.source, md5({_FULL}) AS summary_md5 FROM embeddings e LEFT JOIN hits h ON h.memory_id = e.vec_id LEFT JOIN (SELECT * FROM memories WHERE length(summary) > 100) m ON m.memory_id = e.vec_id")
def hybrid_join_candidates(spark, sf_dir):
    """All vectors, with their keyword hits and memories; memories of short summaries aren't stored here, so the vector's
    own summary shows."""
    hits = _lookup(spark, sf_dir).select("memory_id", F.round("bm25", 6).alias("bm25"))
    c = I.hybrid_candidates(_vectors(spark, sf_dir), hits, memories(spark, sf_dir).where(F.length("summary") > 100))
    return c.select("memory_id", "bm25", "source", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


_BONUS = f"{_ENT}, bonus AS (SELECT a.memory_id, least(count(DISTINCT b.memory_id) * 0.05, 0.3) AS bonus FROM ent a JOIN ent b ON a.entity = b.entity AND a.memory_id <> b.memory_id GROUP BY 1)"
_TOP = "top AS (SELECT list(entity) AS wanted FROM (SELECT entity FROM ent GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 5))"
_OVER = "over AS (SELECT memory_id, count(*) AS n FROM ent, top WHERE list_contains(wanted, entity) GROUP BY memory_id)"
_BOOST = "CASE WHEN coalesce(n, 0) > 0 THEN 0.5 / (1 + 0.001 * (n - 1) * (n - 1)) ELSE 0.0 END"


def _wanted(entities):
    """The five commonest entities: the query's."""
    top = entities.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(5)
    return top.agg(F.collect_list("entity").alias("wanted"))  # one row


@query("entity_overlap_boost", f"WITH {_ENT}, {_TOP}, {_OVER} SELECT memory_id, CAST(coalesce(n, 0) AS BIGINT) AS overlap, round({_BOOST}, 6) AS boost FROM memories LEFT JOIN over USING (memory_id)")
def entity_overlap_boost(spark, sf_dir):
    m = memories(spark, sf_dir).select("memory_id", text.held(text.entities(F.col("text"))).alias("e")).crossJoin(F.broadcast(_wanted(_entities(spark, sf_dir))))
    n = I.entity_overlap(F.col("e"), F.col("wanted"))
    return m.select("memory_id", n.cast("long").alias("overlap"), F.round(R.entity_boost(n), 6).alias("boost"))


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0"
_RANK = f"""{_COSQL[5:]}, {_BONUS}, {_TOP}, {_OVER},
f AS (SELECT memory_id, round(least((cosine + greatest(0.1, 1 - greatest({_AGE}, 0.0) / 30) + {_BOOST}) * CAST({_SW} AS DOUBLE) / 3.5, 1.0), 6) AS score
  FROM c JOIN memories m ON m.memory_id = c.vec_id LEFT JOIN over USING (memory_id) WHERE cosine >= 0.08),
t AS (SELECT * FROM f ORDER BY score DESC, memory_id LIMIT 20)"""


def _ranked(spark, sf_dir, bonuses=None):
    m = memories(spark, sf_dir).select("memory_id", "ts", "source", text.held(text.entities(F.col("text"))).alias("e"))
    rows = _cosines(spark, sf_dir).select(F.col("vec_id").alias("memory_id"), F.col("cosine").alias("sem")).join(m, "memory_id").crossJoin(F.broadcast(_wanted(_entities(spark, sf_dir))))
    rows = rows.select("memory_id", "source", "sem", F.lit(0.0).alias("key"), R.recency(R.age_days(F.col("ts"), as_of()), None).alias("rec"), R.entity_boost(I.entity_overlap(F.col("e"), F.col("wanted"))).alias("ent"))
    return I.score_and_rank(rows, 20, bonuses=bonuses)


@query("rank_fusion_gate", f"WITH {_RANK} SELECT memory_id, score FROM t")
def rank_fusion_gate(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query("rank_fusion_resort", f"WITH {_RANK} SELECT memory_id, least(round(score + coalesce(bonus, 0.0), 6), 1.0) AS score FROM t LEFT JOIN bonus USING (memory_id)")
def rank_fusion_resort(spark, sf_dir):
    return _ranked(spark, sf_dir, R.connectivity_bonus(_entities(spark, sf_dir)))


@query("entity_bonus", f"WITH {_BONUS} SELECT memory_id, round(bonus, 6) AS bonus FROM bonus")
def entity_bonus(spark, sf_dir):
    """The bonus for neighbours, without listing them."""
    return R.connectivity_bonus(_entities(spark, sf_dir)).select("memory_id", F.round("bonus", 6).alias("bonus"))


_NEW = "SELECT doc_id AS memory_id, min(substr(text, 1, 80)) AS summary FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE lang = 'en') GROUP BY doc_id"


@query("index_add", f"WITH n AS ({_NEW}) SELECT vec_id AS memory_id, 'vector ' || CAST(vec_id AS VARCHAR) AS summary FROM embeddings UNION ALL SELECT memory_id, summary FROM n WHERE memory_id NOT IN (SELECT vec_id FROM embeddings)")
def index_add(spark, sf_dir):
    """All memories (the English ones twice) arrive at an index that has the embeddings' ids."""
    m = memories(spark, sf_dir)
    return I.add_to_index(_vectors(spark, sf_dir), m.unionByName(m.where("scene = 'en'")).select("memory_id", "summary"))


@query("fts_index_maintain", f"WITH {MEMORIES_SQL}, s AS (SELECT memory_id, CASE WHEN scene = 'de' THEN summary || ' changed today' ELSE summary END AS summary FROM memories WHERE scene <> 'es'), t AS (SELECT memory_id, unnest({S.tokens('summary')}) AS term FROM s) SELECT memory_id, count(DISTINCT term) AS terms, count(*) AS words, min(term) AS first FROM t GROUP BY memory_id")
def fts_index_maintain(spark, sf_dir):
    """German memories were changed and Spanish ones deleted: the kept-up index equals one that is built anew."""
    m = memories(spark, sf_dir).select("memory_id", "scene", "summary")
    changed = m.where("scene = 'de'").select("memory_id", F.concat("summary", F.lit(" changed today")).alias("summary"))
    at = new_table(spark, "kept")
    blockindex.build(m, at)
    blockindex.maintain(spark, at, changed, m.where("scene = 'es'"))
    kept = commits.read(spark, at).where("term <> ''").select("term", F.explode("postings").alias("p"))
    return kept.groupBy("p.memory_id").agg(F.count("*").alias("terms"), F.sum("p.tf").alias("words"), F.min("term").alias("first"))


@query("vector_dim_guard", "SELECT vec_id, CASE WHEN len(embedding[1:CASE WHEN label = 0 THEN 32 ELSE 64 END]) = 64 THEN 'vector' ELSE 'ngram' END AS method FROM embeddings")
def vector_dim_guard(spark, sf_dir):
    """Vectors of label 0 come from a model of half the length."""
    return I.guarded_method(_mixed(spark, sf_dir), 64)


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, F.when(F.col("label") == 0, 32).otherwise(64)).alias("embedding"))


@query("vector_rebuild", "SELECT 'mixed' AS state, doc_id AS memory_id FROM documents WHERE (SELECT count(DISTINCT CASE WHEN label = 0 THEN 32 ELSE 64 END) > 1 FROM embeddings) OR doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'uniform', doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_rebuild(spark, sf_dir):
    """What has to be embedded: all, when lengths are mixed; else what lacks."""
    m, out = memories(spark, sf_dir), None
    for state, e in (("mixed", _mixed(spark, sf_dir)), ("uniform", table(spark, sf_dir, "embeddings"))):
        part = I.to_index(m, e.select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))).select(F.lit(state).alias("state"), "memory_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("embedding_fallback", f"WITH {MEMORIES_SQL} SELECT memory_id, CASE WHEN vec_id IS NOT NULL THEN 'given 0' ELSE 'ngram' END AS method, CASE WHEN vec_id IS NOT NULL THEN len(embedding) ELSE 256 END AS dims, CASE WHEN vec_id IS NOT NULL THEN len(list_filter(embedding, lambda x: x <> 0)) ELSE len({S.buckets('summary')}) END AS used FROM memories LEFT JOIN embeddings ON vec_id = memory_id")
def embedding_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    v = I.embeddings(memories(spark, sf_dir), e)
    return v.select("memory_id", "method", F.size("vector").alias("dims"), F.size(F.filter("vector", lambda x: x != 0)).alias("used"))


@query("global_stats", f"WITH {_ENT} SELECT (SELECT count(*) FROM documents) AS memories, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(DISTINCT entity) FROM ent) AS entities, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings) AS dims")
def global_stats(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    one = d.agg(F.count("*").alias("memories"), F.countDistinct("source").alias("sources"))
    one = one.crossJoin(_entities(spark, sf_dir).agg(F.countDistinct("entity").alias("entities")))  # one row each
    return one.crossJoin(e.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims")))


@query("entities_batch", f"WITH {MEMORIES_SQL}, b AS (SELECT memory_id, [substr(text, 1, 1000), substr(text, 1001)] AS parts FROM memories) SELECT memory_id, len(parts) AS n, array_to_string(list_transform(parts, lambda p: {S.joined(S.entities('p'))}), '#') AS entities FROM b")
def entities_batch(spark, sf_dir):
    """Entities of each text of a batch (an array of texts): a text's first thousand characters and the rest."""
    m = memories(spark, sf_dir).select("memory_id", F.array(F.substring("text", 1, 1000), F.expr("substring(text, 1001)")).alias("parts"))
    return m.select("memory_id", F.size("parts").alias("n"), F.array_join(F.transform("parts", lambda p: F.array_join(F.array_sort(text.entities(p)), "|")), "#").alias("entities"))


@query("tunnels_ingest", f"WITH {MEMORIES_SQL}, e AS (SELECT DISTINCT source AS scene, unnest({S.scene_tokens('summary')}) AS entity FROM memories) SELECT a.scene AS source, b.scene AS target, min(a.entity) AS entity FROM e a JOIN e b ON a.entity = b.entity AND a.scene < b.scene GROUP BY 1, 2")
def tunnels_ingest(spark, sf_dir):
    """Memories arrive in two parts, by time, some of them twice: the tunnels are those of all memories at once."""
    m = memories(spark, sf_dir).select("ts", F.col("source").alias("scene"), F.explode(text.scene_tokens(F.col("summary"))).alias("entity"))
    scenes, kept = new_table(spark, "scenes"), new_table(spark, "tunnels")
    tunnels.ingest(spark, scenes, kept, m.where("ts < timestamp_ntz'2024-01-26 00:00:00'"))
    tunnels.ingest(spark, scenes, kept, m.where("ts >= timestamp_ntz'2024-01-25 00:00:00'"))
    return commits.read(spark, kept).select("source", "target", "entity")
