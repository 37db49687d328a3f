"""Retrieval: keyword, vector and hybrid ranking in one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.staging import staged


def term_frequencies(docs: DataFrame, terms: list[str], id_col: str = "memory_id", body: str = "summary") -> DataFrame:
    """id, dl and tf_<i> of each query term: one narrow pass, no explode."""
    t = docs.select(id_col, text.held(text.tokens(F.col(body))).alias("tokens"))
    return t.select(id_col, F.size("tokens").alias("dl"), *frequencies("tokens", terms))


def frequencies(tokens: str, terms: list[str]) -> list[Column]:
    """tf_<i>: how often each term is among the tokens."""
    return [(F.size(tokens) - F.size(F.array_remove(tokens, w))).alias(f"tf_{i}") for i, w in enumerate(terms)]


def corpus_stats(freqs: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, average length, document frequency of each term."""
    return freqs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))])


def bm25(docs: DataFrame, query: str, id_col: str = "memory_id", body: str = "summary") -> DataFrame:
    """id, matched (how many query terms occur) and bm25 of every document with a query term."""
    terms = list(dict.fromkeys(query.lower().split()))
    freqs = term_frequencies(docs, terms, id_col, body)
    both = freqs.crossJoin(F.broadcast(corpus_stats(freqs, terms)))  # the statistics are one row
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + idf * tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / F.col("avgdl")))
        matched = matched + (tf > 0).cast("int")
    return both.select(id_col, matched.alias("matched"), score.alias("bm25")).where("matched > 0")


def sigmoid_norm(score: Column, query_terms: int) -> Column:
    mid, steep = next((m, s) for n, m, s in K.SIGMOID_BY_LENGTH if n is None or query_terms <= n)
    return 1 / (1 + F.exp(-steep * (score - mid)))


def keyword_norm_reference(rank: Column, max_rank: Column) -> Column:
    """1 / (1 + |rank| / max(|max rank|, 1)): better hits, whose rank is more negative, score lower."""
    return 1 / (1 + F.abs(rank) / F.greatest(F.abs(max_rank), F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-10)


def bucket_cosine(a: Column, b: Column) -> Column:
    """Cosine of two 0/1 vectors given by their set positions."""
    return F.size(F.array_intersect(a, b)) / (F.sqrt(F.size(a)) * F.sqrt(F.size(b)) + 1e-10)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows of largest cosine with the query vector; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, cosine(F.col(vector), q).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)


def temporal_signal(c: Column) -> Column:
    """past, future or recent: the first of them with a keyword in the lower-cased text; else null."""
    out = None
    for name, words in K.TEMPORAL_SIGNALS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def recency(age_days: Column, signal: str | None) -> Column:
    """Weight of an age (null: unknown) under a temporal signal; negative ages count as 0."""
    d = F.greatest(age_days, F.lit(0.0))
    by = {
        "recent": F.greatest(F.lit(0.1), 1 - d * 24 / 168),
        "past": F.least(F.lit(1.0), F.greatest(F.lit(0.1), d / 30)),
        "future": F.lit(0.7),
        None: F.greatest(F.lit(0.1), 1 - d / 30),
    }
    return F.when(age_days.isNull(), 0.5).otherwise(by[signal])


def source_weight(c: Column) -> Column:
    out = F.when(c == "user", K.SOURCE_WEIGHTS["user"])
    for s, w in list(K.SOURCE_WEIGHTS.items())[1:]:
        out = out.when(c == s, w)
    return out.otherwise(K.OTHER_SOURCE_WEIGHT)


def entity_boost(overlap: Column) -> Column:
    return F.when(overlap > 0, K.ENTITY_BOOST / (1 + 0.001 * F.pow(overlap - 1, F.lit(2)))).otherwise(0.0)


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000


def hybrid_search(memories: DataFrame, query: str, as_of: Column, k: int = 5, gate: bool = False) -> DataFrame:
    """memory_id, score of the k best memories (memory_id, ts, source, summary): trigram cosine, BM25 under the adaptive
    sigmoid, recency under the query's temporal signal and entity boost, times the source's weight. One plan: a scan for
    the statistics, a scan for the scores, TakeOrdered."""
    words = query.lower().split()
    signal = next((n for n, ws in K.TEMPORAL_SIGNALS.items() if any(w in query.lower() for w in ws)), None)
    terms = list(dict.fromkeys(words))
    base = memories.select("memory_id", "ts", "source", "summary", text.held(text.tokens(F.col("summary"))).alias("tokens"), text.held(text.trigram_buckets(F.col("summary"))).alias("b"), text.trigram_buckets(F.lit(query)).alias("q"))
    freqs = base.select("memory_id", "ts", "source", "summary", "b", "q", F.size("tokens").alias("dl"), *frequencies("tokens", terms))
    both = freqs.crossJoin(F.broadcast(corpus_stats(freqs, terms)))
    key = F.lit(0.0)
    for i in range(len(terms)):
        t, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        key = key + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * t * (K.BM25_K1 + 1) / (t + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / F.col("avgdl")))
    sem = bucket_cosine(F.col("b"), F.col("q"))
    overlap = F.size(F.array_intersect(text.entities(F.col("summary")), text.entities(F.lit(query))))
    parts = both.select("memory_id", "source", sem.alias("sem"), F.when(key > 0, sigmoid_norm(key, len(words))).otherwise(0.0).alias("key"), recency(age_days(F.col("ts"), as_of), signal).alias("rec"), entity_boost(overlap).alias("ent"))
    if gate:
        parts = parts.where(F.col("sem") >= K.SEMANTIC_GATE)
    score = F.least((F.col("sem") + F.col("key") + F.col("rec") + F.col("ent")) * source_weight(F.col("source")) / K.FUSION_NORM, F.lit(1.0))
    return parts.select("memory_id", F.bround(score, 4).alias("score")).orderBy(F.desc("score"), "memory_id").limit(k)


def connectivity(entities_by_memory: DataFrame) -> DataFrame:
    """memory_id, neighbours, bonus: other memories that share an entity. Rows are (memory_id, entity).

    Memories of equal entities are one class. Another memory that shares t entities is counted t times by its entities and
    t (t - 1) / 2 times by pairs of them; the first less the second, and (t - 1) (t - 2) / 2 more from three on, is one. So
    the first two are plain counts of each entity and each pair, and only classes that share three entities meet at all."""
    sets = entities_by_memory.where("memory_id is not null and entity is not null").groupBy("memory_id").agg(F.sort_array(F.collect_set("entity")).alias("e"))
    sets = staged(sets, "entities")
    classes = staged(sets.groupBy("e").agg(F.min("memory_id").alias("c"), F.count("*").alias("n")), "classes")
    one = classes.select("c", "n", F.explode("e").alias("x"))
    of_one = one.join(one.groupBy("x").agg(F.sum("n").alias("k")), "x").select("c", "k")
    firsts = classes.where(F.size("e") >= 2).select("c", "n", "e", F.posexplode("e").alias("i", "x"))
    two = staged(firsts.select("c", "n", F.size("e").alias("size"), "x", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("y")), "pairs")
    of_two = two.join(two.groupBy("x", "y").agg(F.sum("n").alias("k")), ["x", "y"]).select("c", (-F.col("k")).alias("k"))
    many = two.where("size >= 3")
    met = many.select("c", "x", "y").join(many.select(F.col("c").alias("d"), "n", "x", "y"), ["x", "y"]).groupBy("c", "d", "n").agg(F.count("*").alias("pairs")).where("pairs >= 3")
    shared = F.round((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2).cast("long")
    of_more = met.select("c", (F.col("n") * ((shared - 1) * (shared - 2) / 2).cast("long")).alias("k"))
    n = of_one.unionByName(of_two).unionByName(of_more).groupBy("c").agg((F.sum("k") - 1).alias("neighbours")).where("neighbours > 0")
    members = sets.join(classes.select("e", "c"), "e").select("memory_id", "c")
    return members.join(n, "c").select("memory_id", "neighbours", F.least(F.col("neighbours") * K.CONNECTIVITY_STEP, F.lit(K.CONNECTIVITY_CAP)).alias("bonus"))


def connectivity_bonus(entities_by_memory: DataFrame) -> DataFrame:
    """memory_id, bonus, as `connectivity` gives it, without its pairs: as the bonus stops at some neighbours, it is enough
    to know of each entity one more than so many of its memories, the least ids. An entity with all its memories among
    them hides none; one with more shows enough. So a memory meets a few rows for each of its entities, however hot."""
    most = round(K.CONNECTIVITY_CAP / K.CONNECTIVITY_STEP) + 1
    place = F.row_number().over(Window.partitionBy("entity").orderBy("memory_id"))
    some = entities_by_memory.select("entity", "memory_id").withColumn("place", place).where(F.col("place") <= most).groupBy("entity").agg(F.collect_list("memory_id").alias("some"))
    met = entities_by_memory.join(some, "entity").select("memory_id", F.explode("some").alias("other")).where("memory_id <> other").distinct()
    n = met.groupBy("memory_id").agg(F.count("*").alias("n"))
    return n.select("memory_id", F.least(F.col("n") * K.CONNECTIVITY_STEP, F.lit(K.CONNECTIVITY_CAP)).alias("bonus"))
