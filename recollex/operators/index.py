"""The stored keyword and vector index: postings, lookups that never scan the texts, upkeep, guards and rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import retrieval


def counted(rows: DataFrame, id_col: str = "memory_id", body: str = "summary") -> DataFrame:
    """memory_id, dl and words, an array of (term, tf), of every row: a row's words are sorted and counted in place."""
    t = rows.select(F.col(id_col).alias("memory_id"), text.held(F.sort_array(text.tokens(F.coalesce(body, F.lit(""))))).alias("t"))
    first = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: ~F.get("t", i - 1).eqNullSafe(F.get("t", i - 2)))
    t = t.withColumn("s", text.held(F.when(F.size("t") > 0, first).otherwise(F.array().cast("array<int>"))))
    word = lambda a, z: F.struct(F.get("t", a - 1).alias("term"), (F.coalesce(z, F.size("t") + 1) - a).cast("long").alias("tf"))
    return t.select("memory_id", F.size("t").alias("dl"), F.zip_with("s", F.slice("s", F.lit(2), F.size("t") + 1), word).alias("words"))


def postings(rows: DataFrame, id_col: str = "memory_id", body: str = "summary") -> DataFrame:
    """term, memory_id, tf, dl of every distinct word of rows: what the index stores, best clustered by term."""
    return counted(rows, id_col, body).select("memory_id", "dl", F.explode("words").alias("w")).select("w.term", "memory_id", "w.tf", "dl")


def lookup(index: DataFrame, totals: DataFrame, query: str, most: int | None = None) -> DataFrame:
    """memory_id, matched, bm25 from postings and totals (one row: n, avgdl): the query's terms are a pushed filter, so
    only their postings are read; with most, the best that many (ties by id)."""
    terms = list(dict.fromkeys(query.lower().split()))
    hits = index.where(F.col("term").isin(*terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    met = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / F.col("avgdl")))
    out = met.groupBy("memory_id").agg(F.count("*").alias("matched"), F.sum(part).alias("bm25"))
    return out if most is None else out.orderBy(F.desc(F.round("bm25", 6)), "memory_id").limit(most)


def totals(rows: DataFrame, body: str = "summary") -> DataFrame:
    """One row: n (texts) and avgdl (words a text)."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.size(text.tokens(F.col(body)))).alias("avgdl"))


def maintain(index: DataFrame, changed: DataFrame, deleted: DataFrame, body: str = "summary") -> DataFrame:
    """The index after some rows (memory_id, body) were added or changed and others (memory_id) deleted: their old
    postings go, and only the changed texts are read again."""
    stale = changed.select("memory_id").union(deleted.select("memory_id")).distinct()
    return index.join(stale, "memory_id", "left_anti").select("term", "memory_id", "tf", "dl").unionByName(postings(changed, body=body))


def hybrid_candidates(vectors: DataFrame, hits: DataFrame, memories: DataFrame) -> DataFrame:
    """vectors (memory_id, summary, ...) with bm25 of their keyword hit (0 without one) and the memory's source and
    summary; a memory that isn't there leaves the index row's summary."""
    m = memories.select("memory_id", F.col("summary").alias("full"), "source", "ts")
    joined = vectors.join(hits.select("memory_id", "bm25"), "memory_id", "left").join(m, "memory_id", "left")
    return joined.withColumn("bm25", F.coalesce("bm25", F.lit(0.0))).withColumn("summary", F.coalesce("full", "summary")).drop("full")


def score_and_rank(rows: DataFrame, k: int, gate: bool = True, bonuses: DataFrame | None = None) -> DataFrame:
    """memory_id, score of the k best rows (memory_id, sem, key, rec, ent, source): those below the semantic gate go if
    the vectors are real; then, with bonuses (memory_id, bonus), the k are raised and sorted again."""
    if gate:
        rows = rows.where(F.col("sem") >= K.SEMANTIC_GATE)
    fused = F.least((F.col("sem") + F.col("key") + F.col("rec") + F.col("ent")) * retrieval.source_weight(F.col("source")) / K.FUSION_NORM, F.lit(1.0))
    best = rows.select("memory_id", F.round(fused, 6).alias("score")).orderBy(F.desc("score"), "memory_id").limit(k)
    if bonuses is None:
        return best
    raised = best.join(bonuses.select("memory_id", "bonus"), "memory_id", "left")
    return raised.select("memory_id", F.least(F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 6), F.lit(1.0)).alias("score")).orderBy(F.desc("score"), "memory_id").limit(k)


def add_to_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """index (memory_id, summary) with the new rows (memory_id, summary) that it lacks, each id once (its least summary)."""
    fresh = new.groupBy("memory_id").agg(F.min(F.substring("summary", 1, 80)).alias("summary"))
    return index.select("memory_id", "summary").unionByName(fresh.join(index.select("memory_id"), "memory_id", "left_anti").select("memory_id", "summary"))


def to_index(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """memory_id of the memories to embed: those without a vector, or all if the vectors (memory_id, vector) have
    different lengths."""
    mixed = vectors.agg((F.countDistinct(F.size("vector")) > 1).alias("mixed"))  # one row
    have = vectors.select("memory_id", F.lit(True).alias("have")).distinct()
    return memories.select("memory_id").join(have, "memory_id", "left").crossJoin(F.broadcast(mixed)).where("mixed or have is null").select("memory_id")


def guarded_method(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, method: `vector` where a stored vector has the query's length, else `ngram`, by which the query and the row's
    text are compared instead."""
    return vectors.select(id_col, F.when(F.size(vector) == dim, "vector").otherwise("ngram").alias("method"))


def embeddings(memories: DataFrame, *providers: DataFrame) -> DataFrame:
    """memory_id, method, vector: from the first provider (memory_id, vector) that has one, by number, else the hashed
    trigrams of the summary."""
    out = memories.select("memory_id", text.held(text.trigram_buckets(F.col("summary"))).alias("__b"))
    for i, p in enumerate(providers):
        out = out.join(p.select("memory_id", F.col("vector").alias(f"__v{i}")), "memory_id", "left")
    method, vector = F.lit("ngram"), text.bucket_vector(F.col("__b"))
    for i in reversed(range(len(providers))):
        have = F.col(f"__v{i}").isNotNull()
        method, vector = F.when(have, f"given {i}").otherwise(method), F.when(have, F.col(f"__v{i}").cast("array<float>")).otherwise(vector)
    return out.select("memory_id", method.alias("method"), vector.alias("vector"))


def entity_overlap(entities: Column, wanted: Column) -> Column:
    """How many of the query's entities a memory has."""
    return F.size(F.array_intersect(entities, wanted))
