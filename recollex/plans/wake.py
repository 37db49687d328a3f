"""The wake pipeline: forget, distil, merge, reflect, bridge, verify, collect and compress, as one DAG of DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import text
from recollex.operators import context, kg, lifecycle, reflection
from recollex.staging import staged


class Wake:
    """What a wake finds, each part when it is asked for; nothing is written until the caller saves it."""

    def __init__(self, memories: DataFrame, access: DataFrame, turns: DataFrame, manifest: DataFrame, inventory: DataFrame, as_of: Column, budget: int):
        self._memories, self._access, self._turns, self._manifest, self._inventory = memories, access, turns, manifest, inventory
        self._as_of, self._budget = as_of, budget

    @cached_property
    def decisions(self) -> DataFrame:
        hot, trends = lifecycle.hot_scenes(self._access, self._as_of), lifecycle.density_trend(self._access, "memory_id")
        return staged(lifecycle.forgetting_decisions(self._memories, hot, trends, self._as_of), "decisions")

    @cached_property
    def active(self) -> DataFrame:
        gone = self.decisions.where(F.col("decision").isin("demote", "archive", "stays_demoted")).select("memory_id")
        return staged(self._memories.join(gone, "memory_id", "left_anti"), "active")

    @cached_property
    def distilled(self) -> DataFrame:
        demoted = self._memories.join(self.decisions.where("decision = 'demote'").select("memory_id"), "memory_id", "left_semi")
        triples = demoted.select("ts", F.explode(kg.triples(F.col("text"))).alias("x")).select("ts", "x.source", "x.relation", "x.target")
        return triples.groupBy("source", "relation", "target").agg(F.min("ts").alias("valid_from"))

    @cached_property
    def groups(self) -> DataFrame:
        candidates = lifecycle.merge_candidates(self.active)
        return staged(lifecycle.class_groups(*lifecycle.keyword_classes(candidates)), "groups")

    @cached_property
    def composites(self) -> DataFrame:
        return lifecycle.merged_rows(self.groups, self.active)

    @cached_property
    def marks(self) -> DataFrame:
        return lifecycle.merge_marks(self.groups)

    @cached_property
    def contradictions(self) -> DataFrame:
        notes = self.active.select(F.col("memory_id").alias("id"), F.to_date("ts").alias("day"), text.topics(F.col("summary")).alias("topics"), text.sentiment(F.col("summary")).alias("mood"))
        return reflection.contradictions(notes)

    @cached_property
    def recent(self) -> DataFrame:
        return self.active.orderBy(F.desc("ts"), F.desc("memory_id")).limit(5)

    @cached_property
    def bridge(self) -> DataFrame:
        last = self._turns.groupBy().agg(F.max("session_id").alias("session_id"))  # one row: the newest session
        mine = self._turns.join(F.broadcast(last), "session_id")
        topic = mine.where("role = 'user'").groupBy("session_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("topic"))
        return context.bridge_text(context.last_rounds(mine), topic)

    @cached_property
    def verdicts(self) -> DataFrame:
        return context.integrity_diff(self._manifest, self._inventory)

    @cached_property
    def sections(self) -> DataFrame:
        memory = self.recent.select(F.row_number().over(_by_time()).cast("long").alias("seq"), F.substring("summary", 1, 500).alias("content"), F.lit(5).alias("priority"), F.lit("memory").alias("category"))
        session = self.bridge.select(F.lit(0).cast("long").alias("seq"), F.col("summary").alias("content"), F.lit(2).alias("priority"), F.lit("bridge").alias("category"))
        return staged(memory.unionByName(session).withColumn("payload_id", F.lit(0).cast("long")), "sections")  # six rows

    @cached_property
    def actions(self) -> DataFrame:
        return context.compress(self.sections, self._budget)

    @cached_property
    def report(self) -> DataFrame:
        return self.decisions.groupBy("decision").agg(F.count("*").alias("n"))

    @cached_property
    def message(self) -> DataFrame:
        counts = self.report.where(F.col("decision").isin("demote", "archive")).unionByName(self.groups.agg(F.countDistinct("leader").alias("n")).select(F.lit("merge").alias("decision"), "n"))
        return message(counts.unionByName(self.verdicts.where("status <> 'ok'").agg(F.count("*").alias("n")).select(F.lit("verify").alias("decision"), "n")))


def wake(memories: DataFrame, access: DataFrame, turns: DataFrame, manifest: DataFrame, inventory: DataFrame, as_of: Column, budget: int = 2000) -> Wake:
    """memories: memory_id, ts, source, scene, summary, text, last_accessed, demoted, merged_into, is_merged; access:
    memory_id, scene, ts; turns: session_id, turn, role, text; manifest and inventory: path, sha256."""
    return Wake(memories, access, turns, manifest, inventory, as_of, budget)


def message(counts: DataFrame) -> DataFrame:
    """One row, message: the sentences for what there is of (decision, n), in the order of the steps."""
    order = ["demote", "archive", "verify", "merge"]
    words = {"demote": "demoted {} memories", "archive": "{} can be archived", "verify": "{} files differ", "merge": "merged {} groups"}
    line = F.lit(None).cast("string")
    for k in order:
        head, tail = words[k].split("{}")
        line = F.when(F.col("decision") == k, F.concat(F.lit(head), F.col("n").cast("string"), F.lit(tail))).otherwise(line)
    rows = counts.where("n > 0").select(F.array_position(F.array(*[F.lit(k) for k in order]), F.col("decision")).alias("o"), line.alias("l"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), ". ").alias("message"))  # four rows


def _by_time():
    return Window.partitionBy(F.lit(0)).orderBy(F.desc("ts"), F.desc("memory_id"))  # over the five recent rows
