"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import blockindex
from recollex.operators import retrieval as R
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.plans.stored import features_of, index_of
from recollex.tables import AS_OF, MEMORIES_SQL, as_of, memories, quoted, table, texts, texts_sql

QUERIES, ORACLE_SQL, query = register()
QUERY, TERMS = "the and of er", ["the", "and", "of", "er"]


def _bm25_sql(terms, body="summary"):
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf_{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((n - df_{i} + 0.5) / (df_{i} + 0.5) + 1) * tf_{i} * 2.5 / (tf_{i} + 1.5 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    matched = " + ".join(f"CASE WHEN tf_{i} > 0 THEN 1 ELSE 0 END" for i in range(len(terms)))
    return f"""{MEMORIES_SQL}, tok AS (SELECT *, {S.tokens(body)} AS t FROM memories),
fr AS (SELECT *, len(t) AS dl, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM fr),
bm AS (SELECT fr.*, {score} AS bm25, {matched} AS matched FROM fr, st)"""


_BM = _bm25_sql(TERMS)


@query("bm25_topk", f"WITH {_BM} SELECT memory_id, round(bm25, 6) AS bm25 FROM bm WHERE matched > 0 ORDER BY round(bm25, 6) DESC, memory_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return R.bm25(memories(spark, sf_dir), QUERY).select("memory_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "memory_id").limit(20)


@query("bm25_sigmoid_norm", f"WITH {_BM} SELECT memory_id, round(1 / (1 + exp(-0.6 * (bm25 - 7))), 6) AS score FROM bm WHERE matched > 0")
def bm25_sigmoid_norm(spark, sf_dir):
    return R.bm25(memories(spark, sf_dir), QUERY).select("memory_id", F.round(R.sigmoid_norm(F.col("bm25"), len(TERMS)), 6).alias("score"))


@query("fts_all_terms_match", f"WITH {_BM} SELECT memory_id, round(bm25, 6) AS bm25 FROM bm WHERE matched = 4 ORDER BY round(bm25, 6) DESC, memory_id LIMIT 20")
def fts_all_terms_match(spark, sf_dir):
    hits = R.bm25(memories(spark, sf_dir), QUERY).where(F.col("matched") == len(TERMS))
    return hits.select("memory_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "memory_id").limit(20)


@query("keyword_norm_reference", f"WITH {_BM}, r AS (SELECT memory_id, -round(bm25, 6) AS rank FROM bm WHERE matched = 4) SELECT memory_id, round(1 / (1 + abs(rank) / greatest(abs((SELECT max(rank) FROM r)), 1.0)), 6) AS score FROM r")
def keyword_norm_reference(spark, sf_dir):
    hits = R.bm25(memories(spark, sf_dir), QUERY).where(F.col("matched") == len(TERMS)).select("memory_id", (-F.round("bm25", 6)).alias("rank"))
    return hits.crossJoin(F.broadcast(hits.agg(F.max("rank").alias("top")))).select("memory_id", F.round(R.keyword_norm_reference(F.col("rank"), F.col("top")), 6).alias("score"))


@query("like_search_conjunction", f"WITH {MEMORIES_SQL} SELECT memory_id, -0.5 AS rank FROM memories WHERE summary ILIKE '%the%' AND summary ILIKE '%And%' ORDER BY memory_id LIMIT 50")
def like_search_conjunction(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.where(F.col("summary").ilike("%the%") & F.col("summary").ilike("%And%")).select("memory_id", F.lit(-0.5).alias("rank")).orderBy("memory_id").limit(50)


_SIGNAL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in K.TEMPORAL_SIGNALS.items()) + " END"


@query("temporal_signal_classify", f"WITH {texts_sql('conversations')} SELECT src, id, {_SIGNAL} AS signal FROM texts")
def temporal_signal_classify(spark, sf_dir):
    return texts(spark, sf_dir, "conversations").select("src", "id", R.temporal_signal(F.col("text")).alias("signal"))


_AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0"
_RECENCY = {"default": (None, "greatest(0.1, 1 - d / 30)"), "past": ("past", "least(1.0, greatest(0.1, d / 30))"), "recent": ("recent", "greatest(0.1, 1 - d * 24 / 168)"), "future": ("future", "0.7")}
for _name, (_signal, _sql) in _RECENCY.items():

    def _recency(spark, sf_dir, signal=_signal):
        e = table(spark, sf_dir, "events")
        return e.select("event_id", F.round(R.recency(R.age_days(F.col("ts"), as_of()), signal), 6).alias("recency"))

    QUERIES[f"recency_{_name}"] = _recency
    ORACLE_SQL[f"recency_{_name}"] = f"SELECT event_id, round(CAST({_sql} AS DOUBLE), 6) AS recency FROM (SELECT event_id, greatest({_AGE}, 0.0) AS d FROM events)"


@query("entity_extract_regex", f"WITH {texts_sql('documents')} SELECT src, id, {S.joined(S.entities('text'))} AS entities FROM texts")
def entity_extract_regex(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("src", "id", F.array_join(F.array_sort(text.entities(F.col("text"))), "|").alias("entities"))


_ENT = f"{MEMORIES_SQL}, ent AS (SELECT DISTINCT memory_id, unnest({S.entities('text')}) AS entity FROM memories)"


def _entities(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select("memory_id", F.explode(text.entities(F.col("text"))).alias("entity"))


@query("entity_inverted_index", f"WITH {_ENT} SELECT entity, memory_id, row_number() OVER (PARTITION BY entity ORDER BY memory_id) = 1 AS first FROM ent")
def entity_inverted_index(spark, sf_dir):
    """The index as rows (entity, memory_id): no entity's list has to fit in a task."""
    e = _entities(spark, sf_dir)
    first = e.groupBy("entity").agg(F.min("memory_id").alias("least"))
    return e.join(first, "entity").select("entity", "memory_id", (F.col("memory_id") == F.col("least")).alias("first"))


@query("shared_entities", f"WITH {_ENT} SELECT entity, count(DISTINCT memory_id) AS n FROM ent GROUP BY entity HAVING count(DISTINCT memory_id) >= 2")
def shared_entities(spark, sf_dir):
    return _entities(spark, sf_dir).groupBy("entity").agg(F.count("memory_id").alias("n")).where("n >= 2")


@query("entity_connectivity", f"WITH {_ENT}, s AS (SELECT * FROM ent) SELECT a.memory_id, count(DISTINCT b.memory_id) AS neighbours, round(least(count(DISTINCT b.memory_id) * 0.05, 0.3), 6) AS bonus FROM s a JOIN s b ON a.entity = b.entity AND a.memory_id <> b.memory_id GROUP BY a.memory_id")
def entity_connectivity(spark, sf_dir):
    return R.connectivity(_entities(spark, sf_dir)).select("memory_id", "neighbours", F.round("bonus", 6).alias("bonus"))


@query("entity_boost", f"WITH {MEMORIES_SQL}, o AS (SELECT memory_id, len(list_intersect(list_distinct({S.scene_tokens('summary')}), {S.sql_list(['ther', 'and', 'ion', 'ered', 'onan'])})) AS n FROM memories) SELECT memory_id, CAST(n AS BIGINT) AS overlap, CASE WHEN n > 0 THEN round(0.5 / (1 + 0.001 * (n - 1) * (n - 1)), 6) ELSE 0.0 END AS boost FROM o")
def entity_boost(spark, sf_dir):
    wanted = text.constant_list(["ther", "and", "ion", "ered", "onan"])
    n = F.size(F.array_intersect(text.scene_tokens(F.col("summary")), wanted))
    return memories(spark, sf_dir).select("memory_id", n.cast("long").alias("overlap")).select("memory_id", "overlap", F.round(R.entity_boost(F.col("overlap")), 6).alias("boost"))


@query("source_distribution", "SELECT source, count(*) AS n, count(DISTINCT lang) AS scenes FROM documents GROUP BY source")
def source_distribution(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("scene").alias("scenes")).orderBy(F.desc("n"), "source")


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
_COS = f"{_DOT.format('e.embedding', 'q.v')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.v', 'q.v')}) + 1e-10)"


def _cosines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row: the query
    return e.crossJoin(q).select("vec_id", "label", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


_COSQL = f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, label, round({_COS}, 6) AS cosine FROM embeddings e, q)"


@query("vector_cosine_topk", _COSQL + " SELECT vec_id, cosine FROM c ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_cosine_topk(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", "cosine").orderBy(F.desc("cosine"), "vec_id").limit(10)


@query("vector_semantic_gate", _COSQL + " SELECT vec_id, label, cosine FROM c WHERE cosine >= 0.08")
def vector_semantic_gate(spark, sf_dir):
    return _cosines(spark, sf_dir).where(F.col("cosine") >= K.SEMANTIC_GATE)


@query("vector_dim_check", "SELECT count(DISTINCT len(embedding)) AS dims, count(DISTINCT len(embedding)) > 1 AS mismatch, count(*) AS n FROM embeddings")
def vector_dim_check(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").agg(F.countDistinct(F.size("embedding")).alias("dims"), F.count("*").alias("n"))
    return d.select("dims", (F.col("dims") > 1).alias("mismatch"), "n")


@query("vector_reindex_missing", "SELECT d.doc_id AS memory_id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_reindex_missing(spark, sf_dir):
    """Memories that the vector index lacks."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"))
    return memories(spark, sf_dir).select("memory_id").join(e, "memory_id", "left_anti")


@query("ngram_embedding_cosine", f"WITH {MEMORIES_SQL}, q AS (SELECT {S.buckets(quoted(QUERY))} AS q), b AS (SELECT memory_id, {S.buckets('summary')} AS b FROM memories) SELECT memory_id, round(len(list_intersect(b, q)) / (sqrt(len(b)) * sqrt(len(q)) + 1e-10), 6) AS cosine FROM b, q")
def ngram_embedding_cosine(spark, sf_dir):
    b = memories(spark, sf_dir).select("memory_id", text.trigram_buckets(F.col("summary")).alias("b"), text.trigram_buckets(F.lit(QUERY)).alias("q"))
    return b.select("memory_id", F.round(R.bucket_cosine(F.col("b"), F.col("q")), 6).alias("cosine"))


_SW = "CASE source WHEN 'user' THEN 1.0 WHEN 'agent_confirmed' THEN 1.0 WHEN 'system' THEN 0.85 WHEN 'agent' THEN 0.85 ELSE 0.7 END"
_HQ = "last and of er"
_HYBRID = f"""WITH {_bm25_sql(_HQ.split())}, q AS (SELECT {S.buckets(quoted(_HQ))} AS q),
p AS (SELECT memory_id, source, CASE WHEN matched > 0 THEN 1 / (1 + exp(-0.6 * (bm25 - 7))) ELSE 0.0 END AS key,
  (SELECT len(list_intersect(b, q)) / (sqrt(len(b)) * sqrt(len(q)) + 1e-10) FROM (SELECT {S.buckets('summary')} AS b)) AS sem,
  least(1.0, greatest(0.1, {_AGE} / 30)) AS rec FROM bm, q)
SELECT memory_id, round(least((sem + key + rec) * CAST({_SW} AS DOUBLE) / 3.5, 1.0), 4) AS score FROM p ORDER BY 2 DESC, 1 LIMIT 5"""


@query("hybrid_search_topk", _HYBRID)
def hybrid_search_topk(spark, sf_dir):
    """From the stored index and features; no text is read."""
    return blockindex.hybrid(spark, index_of(spark, sf_dir), features_of(spark, sf_dir), _HQ, as_of())


@query("hybrid_search_scan", _HYBRID)
def hybrid_search_scan(spark, sf_dir):
    """The same from the texts, where there is no index."""
    return R.hybrid_search(memories(spark, sf_dir), _HQ, as_of())


_CONV = "SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 1.0 WHEN 'system' THEN 0.85 ELSE 0.7 END AS w, length(text) AS n FROM conversations"


@query("rank_fusion_source_weight", f"SELECT conv_id, turn, round(least((0.9 + n / 1000.0) * w / 3.5, 1.0), 6) AS score FROM ({_CONV}) ORDER BY 3 DESC, 1, 2 LIMIT 25")
def rank_fusion_source_weight(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    score = F.least((0.9 + F.length("text") / 1000.0) * R.source_weight(F.col("role")) / K.FUSION_NORM, F.lit(1.0))
    return c.select("conv_id", "turn", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(25)


@query("fts_index_sync", f"WITH {MEMORIES_SQL}, done AS (SELECT memory_id FROM memories WHERE scene = 'en') SELECT memory_id, unnest(list_distinct({S.tokens('summary')})) AS term FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM done)")
def fts_index_sync(spark, sf_dir):
    """Postings of memories that the index doesn't hold yet."""
    m = memories(spark, sf_dir)
    done = m.where("scene = 'en'").select("memory_id")
    return m.join(done, "memory_id", "left_anti").select("memory_id", F.explode(F.array_distinct(text.tokens(F.col("summary")))).alias("term"))


@query("query_language_route", f"WITH {texts_sql('documents', 'conversations')} SELECT src, id, len(regexp_extract_all(text, '{S.CJK}')) > 0.3 * length(text) AS cjk FROM texts")
def query_language_route(spark, sf_dir):
    """Whether a text, asked as a query, goes the way for CJK."""
    return texts(spark, sf_dir, "documents", "conversations").select("src", "id", (F.regexp_count("text", F.lit(text.CJK)) > 0.3 * F.length("text")).alias("cjk"))
