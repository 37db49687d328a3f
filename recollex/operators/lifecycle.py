"""Lifecycle: scenes, access density, forgetting and merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text
from recollex.operators import setjoin
from recollex.staging import staged

#: So few pairs are folded by one task; more are first settled in rounds.
FOLD_PAIRS = 200_000


def scene_keywords(memories: DataFrame, body: str = "summary") -> DataFrame:
    """keyword, n: words in at least two and at most three in ten memories."""
    words = memories.select(F.explode(F.array_distinct(text.scene_tokens(F.col(body)))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    total = memories.agg(F.count("*").alias("total"))
    most = F.greatest(F.lit(1), F.floor(F.col("total") * K.SCENE_MAX_COVERAGE))
    return words.crossJoin(F.broadcast(total)).where((F.col("n") >= K.SCENE_MIN_COUNT) & (F.col("n") <= most)).select("keyword", "n")


def assign_scene(c: Column, scenes: dict[str, list[str]], default: str = "general") -> Column:
    """The first scene with a keyword in the text."""
    out = None
    for name, words in scenes.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def hot_scenes(access: DataFrame, as_of: Column, days: int = K.SCENE_DAYS) -> DataFrame:
    """Scenes with an access (scene, ts) within some days; demoted rows count too."""
    last = access.groupBy("scene").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") > as_of - F.expr(f"interval {days} days"))


def ring_buffer(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key, with place 1 the newest."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def density_trend(access: DataFrame, key: str = "user_id", window: int = K.DENSITY_WINDOW) -> DataFrame:
    """key, n_gaps, median_gap (hours), trend: the last `window` accesses' gaps, zero gaps dropped; widening if the later
    half's mean is more than WIDENING times the earlier half's; under two gaps insufficient."""
    last = ring_buffer(access.select(key, "ts"), key, [F.desc("ts")], window)
    gaps = last.withColumn("gap", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy(key).orderBy("ts")).cast("timestamp"))) / 3.6e9).where("gap > 0")
    by = Window.partitionBy(key)
    placed = gaps.withColumn("i", F.row_number().over(by.orderBy("ts"))).withColumn("m", F.count("*").over(by))
    half = F.floor(F.col("m") / 2)
    agg = placed.groupBy(key).agg(F.count("*").alias("n_gaps"), F.median("gap").alias("median_gap"), F.avg(F.when(F.col("i") <= half, F.col("gap"))).alias("early"), F.avg(F.when(F.col("i") > half, F.col("gap"))).alias("late"))
    trend = F.when(F.col("n_gaps") < 2, "insufficient").when(F.col("late") > F.col("early") * K.WIDENING, "widening").otherwise("stable")
    every = access.select(key).distinct()
    return every.join(agg, key, "left").select(key, F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), "median_gap", F.when(F.col("n_gaps").isNull(), "insufficient").otherwise(trend).alias("trend"))


def track_access(memories: DataFrame, access: DataFrame) -> DataFrame:
    """memory_id, access_count, last_accessed, demoted: accesses (memory_id, ts) counted in; an access ends a demotion."""
    a = access.groupBy("memory_id").agg(F.count("*").alias("more"), F.max("ts").alias("at"))
    m = memories.join(a, "memory_id", "left")
    return m.select("memory_id", (F.coalesce("access_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("access_count"), F.coalesce("at", "last_accessed").alias("last_accessed"), (F.coalesce("demoted", F.lit(False)) & F.col("at").isNull()).alias("demoted"))


def forgetting_decisions(memories: DataFrame, hot: DataFrame, trends: DataFrame, as_of: Column, pressure: bool = False) -> DataFrame:
    """memory_id, decision of memories (memory_id, scene, last_accessed, demoted): with few active memories and no
    pressure all are kept; else archive, kept_window, protected (hot scene), kept_density or demote."""
    m = memories.join(hot.select("scene").withColumn("hot", F.lit(True)), "scene", "left").join(trends.select("memory_id", "trend"), "memory_id", "left")
    active = memories.agg(F.count_if(~F.coalesce("demoted", F.lit(False))).alias("active"))
    m = m.crossJoin(F.broadcast(active)).withColumn("days", (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_accessed").cast("timestamp"))) / 86_400_000_000)
    decision = F.when(F.coalesce("demoted", F.lit(False)), F.when(F.col("days") >= K.ARCHIVE_DAYS, "archive").otherwise("stays_demoted"))
    if not pressure:
        decision = decision.when(F.col("active") <= K.PRESSURE_MIN_ACTIVE, "kept_few")
    decision = decision.when(F.col("days") <= K.DEMOTE_DAYS, "kept_window").when(F.col("hot"), "protected").when(F.col("trend") == "stable", "kept_density").otherwise("demote")
    return m.select("memory_id", "scene", decision.alias("decision"))


def keyword_pairs(memories: DataFrame, threshold: float = K.MERGE_JACCARD, least: int = K.MERGE_MIN_KEYWORDS) -> DataFrame:
    """a, b, jaccard of pairs a < b of memories (memory_id, summary) whose keyword sets are similar enough."""
    return similar_sets(_keyword_sets(memories, least), threshold)


def keyword_classes(memories: DataFrame, threshold: float = K.MERGE_JACCARD, least: int = K.MERGE_MIN_KEYWORDS) -> tuple[DataFrame, DataFrame]:
    """`similar_classes` of the keyword sets of memories (memory_id, summary)."""
    return similar_classes(_keyword_sets(memories, least), threshold)


def _keyword_sets(memories: DataFrame, least: int) -> DataFrame:
    return memories.select("memory_id", text.held(text.keywords(F.col("summary"))).alias("k")).where(F.size("k") >= least)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of all pairs a < b of sets (memory_id, k: distinct words) with a Jaccard similarity of at least
    threshold. Of a class of n equal sets these are n (n - 1) / 2; what needs no pairs takes `similar_classes`."""
    members, similar = similar_classes(sets, threshold)
    of = lambda r, c: members.select(F.col("rep").alias(r), F.col("memory_id").alias(c))
    across = similar.join(of("ra", "x"), "ra").join(of("rb", "y"), "rb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    same = of("r", "a").join(of("r", "b"), "r").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    return across.unionByName(same)


def similar_classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (memory_id, k: distinct words), named by their least memory_id: (memory_id, rep) of all sets,
    and (ra, rb, jaccard) of pairs ra < rb of classes with a Jaccard similarity of at least threshold.

    Pairs are found and compared where the rarest word that they share brings them together (`setjoin`), so none moves
    but the similar ones. A text with any number of copies is one class."""
    classes = sets.groupBy(F.array_sort("k").alias("k")).agg(F.min("memory_id").alias("rep"))
    named = staged(classes.select("rep", "k"), "sets")
    members = sets.select("memory_id", F.array_sort("k").alias("k")).join(named, "k").select("memory_id", "rep")
    members = staged(members, "members")
    pairs = setjoin.similar(named.select(F.col("rep").alias("c"), "k"), setjoin.Jaccard(threshold))
    similar = pairs.select(F.col("ca").alias("ra"), F.col("cb").alias("rb"), (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("jaccard"))
    return members, staged(similar, "similar")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leaders by a pass over pairs in order of id."""
    used, out = set(), []
    for leader, others in pdf.sort_values("a").groupby("a")["b"]:
        if leader not in used:
            out.append(leader)
            used.update(others)
    return pd.DataFrame({"leader": out}, dtype="int64")


def merge_leaders(pairs: DataFrame) -> DataFrame:
    """leader: rows of pairs (a < b) that a greedy pass in order of id doesn't find in an earlier leader's group.

    In each round the rows without an undecided earlier neighbour are leaders, and their neighbours are used; both need
    no further look at their pairs. The last FOLD_PAIRS pairs are folded at once."""
    live, out = pairs.select("a", "b"), []
    while live.count() > FOLD_PAIRS:
        heads = staged(live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "leaders")
        used = live.join(heads, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        live = staged(live.join(heads.union(used), "a", "left_anti"), "undecided")
        out.append(heads.select(F.col("a").alias("leader")))
    found = staged(live.groupBy().applyInPandas(_fold, "leader long"), "leaders")
    for heads in out:
        found = found.union(heads)
    return found


def merge_groups(pairs: DataFrame, memories: DataFrame, most: int = K.MERGE_GROUP) -> DataFrame:
    """leader, memory_id, place of greedy leader groups among the pairs (a < b) of memories (memory_id): in order of id,
    a row joins the first leader it pairs with; members past the group size are consumed but not merged."""
    ids = memories.select("memory_id").distinct()
    edges = pairs.select("a", "b").join(ids.withColumnRenamed("memory_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("memory_id", "b"), "b", "left_semi")
    edges = staged(edges, "pairs")
    joined = edges.join(merge_leaders(edges).select(F.col("leader").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    members = joined.groupBy("leader").agg(F.array_sort(F.collect_list("b")).alias("m"))
    rows = members.select("leader", F.posexplode(F.slice(F.concat(F.array("leader"), "m"), 1, most)).alias("place", "memory_id"))
    return rows.select("leader", "memory_id", "place")


def class_groups(members: DataFrame, similar: DataFrame, most: int = K.MERGE_GROUP) -> DataFrame:
    """`merge_groups` on classes: members (memory_id, rep) and similar (ra, rb) of `similar_classes`.

    The pass in order of id treats a class as a whole: when its least member is reached and free, it takes all others of
    the class and of each similar class that is still free, for a similar class with an earlier member is used or would
    have taken this one. So the pass runs over the classes, by their least ids, and members are only ranked at the end."""
    pairs = staged(similar.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")), "pairs")
    taken = pairs.join(merge_leaders(pairs).select(F.col("leader").alias("a")), "a").groupBy("b").agg(F.min("a").alias("leader"))
    rows = members.join(taken.withColumnRenamed("b", "rep"), "rep", "left").select(F.coalesce("leader", "rep").alias("leader"), "memory_id")
    place = F.row_number().over(Window.partitionBy("leader").orderBy("memory_id")) - 1  # the leader has the least id
    ranked = rows.withColumn("place", place).where(F.col("place") < most)
    groups = ranked.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id"))).alias("m")).where(F.size("m") > 1)
    return groups.select("leader", F.explode("m").alias("x")).select("leader", "x.memory_id", "x.place")


def merge_candidates(memories: DataFrame) -> DataFrame:
    """The memories that may be merged: not demoted, not merged before, no composite."""
    return memories.where(~F.coalesce("demoted", F.lit(False)) & F.col("merged_into").isNull() & ~F.coalesce("is_merged", F.lit(False)))


def _titled(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """leader, items (by place: memory_id, ts, source, summary) and the least keywords of all the summaries."""
    m = groups.join(memories.select("memory_id", "ts", "source", "summary"), "memory_id")
    g = m.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id", "ts", "source", "summary"))).alias("items"))
    words = text.keywords(F.array_join(F.transform("items", lambda x: x["summary"]), " "))
    return g.withColumn("words", F.array_sort(words))


def merge_key(ids: Column) -> Column:
    """The id of a composite: it depends on its members alone, so a run that is repeated makes the same one."""
    return F.concat(F.lit("MERGE-"), F.substring(F.sha2(F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ","), 256), 1, 16))


def merged_rows(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """A composite row for each group: id, ts (the newest member's), source `merge`, summary (a title of three keywords
    and the number of members), merged_ids, expandable (a line for each member, newest first), is_merged."""
    g = _titled(groups, memories)
    ids = F.transform("items", lambda x: x["memory_id"])
    newest = F.reverse(F.array_sort(F.transform("items", lambda x: F.struct(x["ts"], (-x["place"]).alias("o"), x["source"], x["summary"]))))
    line = lambda x: F.concat(F.lit("• ["), F.date_format(x["ts"], "yyyy-MM-dd"), F.lit("] ("), F.coalesce(x["source"], F.lit("?")), F.lit(") "), F.substring(x["summary"], 1, 150))
    title = F.concat(F.lit("[merged] "), F.array_join(F.slice("words", 1, 3), ", "), F.lit(" - "), F.size("items").cast("string"), F.lit(" related"))
    return g.select(
        merge_key(ids).alias("id"), newest[0]["ts"].alias("ts"), F.lit("merge").alias("source"), title.alias("summary"), F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",").alias("merged_ids"),
        F.array_join(F.transform(newest, line), "\n").alias("expandable"), F.lit(True).alias("is_merged"),
    )


def merge_marks(groups: DataFrame) -> DataFrame:
    """memory_id, merged_into of the members of all groups: what a merge writes into the originals."""
    keys = groups.groupBy("leader").agg(merge_key(F.collect_list("memory_id")).alias("merged_into"))  # a few members each
    return groups.join(keys, "leader").select("memory_id", "merged_into")


def merge_dry_run(groups: DataFrame, memories: DataFrame) -> DataFrame:
    """leader, count, ids, topics (five keywords): what a merge would do, without doing it."""
    g = _titled(groups, memories)
    return g.select("leader", F.size("items").alias("count"), F.array_join(F.transform("items", lambda x: x["memory_id"].cast("string")), ",").alias("ids"), F.array_join(F.slice("words", 1, 5), "|").alias("topics"))
