"""The stored index against plain BM25; merging and neighbours by classes against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.operators import blockindex, lifecycle, retrieval
from recollex.sources import commits


def ranked(texts, query, k):
    """The k best of {id: text} by BM25, by hand."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1)
    out = []
    for i, w in words.items():
        s = hits = 0
        for t in dict.fromkeys(query.lower().split()):
            df, tf = sum(t in v for v in words.values()), w.count(t)
            if tf:
                hits += 1
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * len(w) / avg))
        if hits:
            out.append((i, hits, round(s, 6)))
    return sorted(out, key=lambda r: (-r[2], r[0]))[:k]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["common"] * 30 + [f"w{i}" for i in range(40)]
    return {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) + (" rare rare rare" if i % 97 == 5 else "") for i in range(n)}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "memory_id long, summary string")


def found(df):
    return [(r.memory_id, r.matched, round(r.bm25, 6)) for r in df.collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    texts = corpus(3000)
    texts |= {9000: None, 9001: "", 9002: "common"}
    table = f"file://{tmp_path_factory.mktemp('index')}/t"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as it is, the table has several files
    blockindex.build(frame(spark, texts), table, range_rows=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return table, texts


@pytest.mark.parametrize(("query", "k"), [("rare", 5), ("common", 7), ("rare common w3", 10), ("w1 w2", 20), ("nothing here", 5), ("rare", 1000), ("", 5), ("Rare RARE", 40)])
def test_search(spark, built, query, k):
    table, texts = built
    assert found(blockindex.search(spark, table, query, k)) == ranked(texts, query, k)


def test_bounds_hold_and_spare_reading(spark, built):
    table, texts = built
    n = commits.state(spark, table)["marks"]["ranges"]
    of = {r.memory_id: r.range for r in frame(spark, texts).select("memory_id", F.pmod(F.xxhash64("memory_id"), F.lit(n)).alias("range")).collect()}
    bound = {r.range: r.bound for r in blockindex.bounds(spark, table, "rare common").collect()}
    every = ranked(texts, "rare common", len(texts))
    assert all(s <= bound[of[i]] + 1e-6 for i, _, s in every)
    kth = every[4][2]
    assert sum(b >= kth for b in bound.values()) < 0.7 * len(bound)  # the ranges whose postings a search for five reads
    # the terms are a pushed filter
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(blockindex.scores(spark, table, "rare common")._jdf.queryExecution(), "formatted")
    assert "In(term, [common,rare])" in plan.split("PushedFilters")[1].split("\n")[0]
    files = commits.read(spark, table).select("term", F.input_file_name().alias("f"))
    assert files.where("term = 'rare'").select("f").distinct().count() < files.select("f").distinct().count()


def test_upkeep(spark, tmp_path):
    texts = corpus(400, 3)
    table = f"file://{tmp_path}/t"
    blockindex.build(frame(spark, texts), table, range_rows=20)
    changed, deleted = {3: "rare w1", 7: "", 8: None, 1000: "brand new w1", 1001: ""}, [11, 12, 5000]
    blockindex.maintain(spark, table, frame(spark, changed), spark.createDataFrame([(i,) for i in deleted], "memory_id long"))
    now = {i: t for i, t in (texts | changed).items() if i not in deleted}
    for query in ("rare", "new w1", "common w5"):
        assert found(blockindex.search(spark, table, query, 12)) == ranked(now, query, 12)
    marks = commits.state(spark, table)["marks"]
    assert (marks["n"], marks["words"]) == (len(now), sum(len((t or "").split()) for t in now.values()))
    empty = f"file://{tmp_path}/empty"
    blockindex.maintain(spark, empty, frame(spark, {1: "a b"}), spark.createDataFrame([], "memory_id long"))
    assert found(blockindex.search(spark, empty, "b", 3)) == ranked({1: "a b"}, "b", 3)


def test_groups_by_classes(spark):
    """The pass over classes gives the groups that the pass over all pairs gives."""
    rng = random.Random(6)
    for most in (5, 3):
        rows = [(i, sorted(rng.sample("abcdefgh", rng.randrange(3, 6)))) for i in rng.sample(range(1000), 120)]
        sets = spark.createDataFrame(rows, "memory_id long, k array<string>")
        by_pairs = lifecycle.merge_groups(lifecycle.similar_sets(sets, 0.6), sets, most)
        by_class = lifecycle.class_groups(*lifecycle.similar_classes(sets, 0.6), most)
        get = lambda df: sorted(map(tuple, df.select("leader", "memory_id", "place").collect()))
        assert get(by_class) == get(by_pairs) != []


def test_many_equal_rows(spark):
    """A hundred thousand copies of a set are one class, and no pair of them is made."""
    k = F.array(*[F.lit(w) for w in ("alpha", "beta", "gamma")])
    sets = spark.range(100_000).select(F.col("id").alias("memory_id"), k.alias("k")).unionByName(spark.range(100_000, 100_010).select(F.col("id").alias("memory_id"), F.array(F.lit("alpha"), F.lit("beta"), F.lit("delta")).alias("k")))
    assert [tuple(r) for r in lifecycle.class_groups(*lifecycle.similar_classes(sets, 0.25)).orderBy("memory_id").collect()] == [(0, i, i) for i in range(5)]


def test_bonus_without_pairs(spark):
    rng = random.Random(8)
    rows = {(i, rng.choice(["hot"] * 5 + [f"e{j}" for j in range(60)])) for i in range(400) for _ in range(rng.randrange(3))}
    e = spark.createDataFrame(sorted(rows), "memory_id long, entity string")
    get = lambda df: sorted((r.memory_id, round(r.bonus, 6)) for r in df.collect())
    assert get(retrieval.connectivity_bonus(e)) == get(retrieval.connectivity(e))
    hot = spark.range(300_000).select(F.col("id").alias("memory_id"), F.lit("x").alias("entity"))
    assert retrieval.connectivity_bonus(hot).agg(F.count("*"), F.min("bonus")).first()[:] == (300_000, K.CONNECTIVITY_CAP)
