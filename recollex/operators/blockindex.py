"""The stored keyword index: postings in blocks with their largest frequencies, and searches that read what can matter.

Memories are dealt by hash to ranges of some RANGE_ROWS. A block holds one term's postings of one range, with the largest
frequency and the least length among them, from which the block's largest BM25 part follows under any corpus statistics.
All terms' blocks of a range hold the same memories, so the parts of a query's terms add up to a bound of every score in
the range. A search bounds all ranges from those few numbers alone, scores the most promising ranges to learn what the
k-th best has at least, and then reads the postings of only those ranges whose bound reaches that (block-max pruning).
The table is a commit log sorted by term: a search's terms are a pushed filter that leaves most files and row groups out.
A common word has many blocks, and none grows beyond its range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import index
from recollex.sources import commits
from recollex.staging import staged

#: Memories of a range, about.
RANGE_ROWS = 512
#: Ranges that are scored first, at least.
FIRST_RANGES = 16
_NONE = "term string, range long, n long, max_tf long, min_dl int, postings array<struct<memory_id:long,tf:long,dl:int>>"


def _blocks(postings: DataFrame, ranges: int) -> DataFrame:
    """Blocks sorted by term: postings are dealt by ranges of what they are grouped by, so they move once."""
    p = postings.withColumn("range", F.pmod(F.xxhash64("memory_id"), F.lit(ranges))).repartitionByRange("term", "range")
    one = F.struct(F.col("memory_id").cast("long").alias("memory_id"), F.col("tf").cast("long").alias("tf"), F.col("dl").cast("int").alias("dl"))
    b = p.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(one).alias("postings"))
    return b.sortWithinPartitions("term", "range")


def _postings(rows: DataFrame, body: str) -> tuple[DataFrame, tuple[int, int]]:
    """term, memory_id, tf, dl of rows, and how many memories and words they are; the term '' has every memory, also one
    without words. The words are counted once and written, as the postings are read twice: for their ranges and to be dealt."""
    c = staged(index.counted(rows, body=body), "words")
    every = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
    p = c.select("memory_id", "dl", F.explode(F.concat(every, "words")).alias("w")).select("w.term", "memory_id", "w.tf", "dl")
    return p, tuple(c.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def _totals(postings: DataFrame) -> tuple[int, int]:
    """Memories and words of postings."""
    return tuple(postings.where("term = ''").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())


def build(rows: DataFrame, table: str, body: str = "summary", range_rows: int | None = None) -> int:
    """Writes the index of rows (memory_id, body) as a new version of the table. Null and empty texts count as memories
    without words; a memory_id is met once."""
    p, (n, words) = _postings(rows, body)
    ranges = max(1, n // (range_rows or RANGE_ROWS))
    return commits.write(_blocks(p, ranges), table, "overwrite", marks={"ranges": ranges, "n": n, "words": words})


def maintain(spark: SparkSession, table: str, changed: DataFrame, deleted: DataFrame, body: str = "summary", attempts: int = 20) -> int:
    """The index after rows (memory_id, body) were added or changed and others (memory_id) deleted, in one commit: blocks of
    ranges that aren't touched stay as they are, and only the changed texts are read. Anew if another writer came between."""
    stale = changed.select("memory_id").union(deleted.select("memory_id")).distinct()
    fresh, more = _postings(changed, body)
    for last in range(attempts, 0, -1):
        now = commits.state(spark, table)
        blocks = commits.read(spark, table, now["version"] or None, _NONE)
        marks = {"ranges": 1, "n": 0, "words": 0} | now["marks"]
        touched = stale.select(F.pmod(F.xxhash64("memory_id"), F.lit(marks["ranges"])).alias("range")).distinct()
        old = blocks.join(touched, "range", "left_semi").select("term", F.explode("postings").alias("p")).select("term", "p.*")
        less = _totals(old.join(stale, "memory_id", "left_semi"))
        new = _blocks(old.join(stale, "memory_id", "left_anti").unionByName(fresh), marks["ranges"])
        rest = blocks.join(touched, "range", "left_anti").select(*new.columns)
        new = new.unionByName(rest.repartitionByRange("term", "range").sortWithinPartitions("term", "range"))
        marks |= {"n": marks["n"] - less[0] + more[0], "words": marks["words"] - less[1] + more[1]}
        try:
            return commits.write(new, table, "overwrite", base=now["version"], marks=marks)
        except commits.Conflict:
            if last == 1:
                raise
    raise AssertionError("attempts must be positive")


def _part(idf: Column, tf: Column, dl: Column, avgdl: float) -> Column:
    return idf * tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / F.lit(avgdl)))


def _matches(spark: SparkSession, table: str, query: str) -> tuple[DataFrame, Column, float]:
    """The blocks of a query's terms, each term's weight as a column, and the average length."""
    now = commits.state(spark, table)
    n, words = now["marks"].get("n", 0), now["marks"].get("words", 0)
    terms = list(dict.fromkeys(query.lower().split()))
    blocks = commits.read(spark, table, now["version"] or None, _NONE).where(F.col("term").isin(*terms))
    df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each term of the query
    idf = F.lit(None).cast("double")
    for t, d in df.items():
        idf = F.when(F.col("term") == t, math.log((n - d + 0.5) / (d + 0.5) + 1)).otherwise(idf)
    return blocks, idf, (words / n if words else 1.0)


def _scored(blocks: DataFrame, idf: Column, avgdl: float) -> DataFrame:
    """memory_id, matched, bm25 of all postings of blocks."""
    p = blocks.select(idf.alias("idf"), F.explode("postings").alias("p"))
    return p.groupBy("p.memory_id").agg(F.count("*").alias("matched"), F.sum(_part(F.col("idf"), F.col("p.tf"), F.col("p.dl"), avgdl)).alias("bm25"))


def scores(spark: SparkSession, table: str, query: str) -> DataFrame:
    """memory_id, matched, bm25 of every memory with a term of the query."""
    return _scored(*_matches(spark, table, query))


def bounds(spark: SparkSession, table: str, query: str) -> DataFrame:
    """range, docs (postings) and bound, which no score in the range exceeds: from the blocks' numbers alone."""
    return _bounds(*_matches(spark, table, query))


def _bounds(blocks: DataFrame, idf: Column, avgdl: float) -> DataFrame:
    return blocks.groupBy("range").agg(F.max("n").alias("docs"), F.sum(_part(idf, F.col("max_tf"), F.col("min_dl"), avgdl)).alias("bound"))


def search(spark: SparkSession, table: str, query: str, k: int, digits: int = 6) -> DataFrame:
    """memory_id, matched, bm25 of the k best memories (scores rounded, ties by id). Without a term that occurs: none."""
    blocks, idf, avgdl = _matches(spark, table, query)
    ranges = _bounds(blocks, idf, avgdl)
    first = ranges.orderBy(F.desc("bound"), "range").limit(max(k, FIRST_RANGES)).select("range")  # k ranges hold k memories at least
    rank = lambda df: df.orderBy(F.desc(F.round("bm25", digits)), "memory_id").limit(k)
    known = rank(_scored(blocks.join(F.broadcast(first), "range", "left_semi"), idf, avgdl)).agg(F.count("*").alias("n"), F.min("bm25").alias("least")).first()
    if known["n"] < k:  # all that match have been seen
        return rank(_scored(blocks, idf, avgdl))
    wanted = ranges.where(F.col("bound") >= known["least"] - 2 * 10.0**-digits).select("range")
    return rank(_scored(blocks.join(wanted, "range", "left_semi"), idf, avgdl))


# ---- what hybrid search needs besides


def build_features(memories: DataFrame, table: str) -> int:
    """Writes, for memories (memory_id, ts, source, summary), what hybrid search compares: trigram buckets and entities."""
    m = memories.withColumn("summary", F.coalesce("summary", F.lit("")))
    rows = m.select("memory_id", "ts", "source", text.trigram_buckets(F.col("summary")).alias("buckets"), text.entities(F.col("summary")).alias("entities"))
    return commits.write(rows, table, "overwrite")


def hybrid(spark: SparkSession, table: str, features: str, query: str, as_of: Column, k: int = 5, gate: bool = False) -> DataFrame:
    """`retrieval.hybrid_search` from the stored index and features: no text is read."""
    from recollex.operators import retrieval as R

    words = query.lower().split()
    signal = next((n for n, ws in K.TEMPORAL_SIGNALS.items() if any(w in query.lower() for w in ws)), None)
    m = commits.read(spark, features).join(scores(spark, table, query).select("memory_id", "bm25"), "memory_id", "left")
    key = F.when(F.col("bm25") > 0, R.sigmoid_norm(F.col("bm25"), len(words))).otherwise(0.0)
    sem = R.bucket_cosine(F.col("buckets"), text.trigram_buckets(F.lit(query)))
    overlap = F.size(F.array_intersect("entities", text.entities(F.lit(query))))
    parts = m.select("memory_id", "source", sem.alias("sem"), key.alias("key"), R.recency(R.age_days(F.col("ts"), as_of), signal).alias("rec"), R.entity_boost(overlap).alias("ent"))
    if gate:
        parts = parts.where(F.col("sem") >= K.SEMANTIC_GATE)
    score = F.least((F.col("sem") + F.col("key") + F.col("rec") + F.col("ent")) * R.source_weight(F.col("source")) / K.FUSION_NORM, F.lit(1.0))
    return parts.select("memory_id", F.bround(score, 4).alias("score")).orderBy(F.desc("score"), "memory_id").limit(k)
