"""Tunnels between scenes that share an entity, kept up as memories arrive: only what is new is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.sources import commits
from recollex.staging import discard, small, staged

SCENES = "entity string, scene string"
TUNNELS = "source string, target string, entity string"


def delta(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """source, target, entity: the pairs of scenes, each with its least entity, that rows of fresh (entity, scene; each once
    and none of them stored) make with each other and with those stored. Pairs of two stored rows are not made, and of the
    stored rows only those of fresh's entities are kept before the join, by a broadcast behind a count."""
    names = fresh.select("entity").distinct()
    old = stored.join(small(names, names.count()), "entity", "left_semi").select("entity", "scene")
    a, b = fresh.alias("a"), old.unionByName(fresh.select("entity", "scene")).alias("b")
    met = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.scene") != F.col("b.scene")))
    ends = met.select(F.least("a.scene", "b.scene").alias("source"), F.greatest("a.scene", "b.scene").alias("target"), F.col("a.entity").alias("entity"))
    return ends.groupBy("source", "target").agg(F.min("entity").alias("entity"))


def ingest(spark: SparkSession, scenes: str, tunnels: str, new: DataFrame, attempts: int = 20) -> int:
    """Brings rows (entity, scene) into two committed tables, of scenes and of tunnels, and returns how many were new.
    Null entities and scenes link nothing and are left out; rows that repeat or are stored already change nothing.

    The tunnels are committed first. A writer that stops between the two commits leaves tunnels that running the ingest
    again finds anew, to no effect. If another writer adds scenes in between, the commit of the scenes fails and all is
    done again with that writer's rows in sight, so no pair is missed."""
    rows = new.select("entity", "scene").where("entity is not null and scene is not null").distinct()
    for last in range(attempts, 0, -1):
        base = commits.state(spark, scenes)["version"]
        stored = commits.read(spark, scenes, base or None, SCENES)
        fresh = staged(rows.join(stored, ["entity", "scene"], "left_anti"), "fresh")
        try:
            n = fresh.count()
            if n == 0 and base:
                return 0
            found = staged(delta(fresh, stored), "tunnels")
            commits.update(spark, tunnels, lambda t: t.unionByName(found).groupBy("source", "target").agg(F.min("entity").alias("entity")), TUNNELS)  # noqa: B023
            discard(found)
            commits.write(fresh, scenes, base=base)
            return n
        except commits.Conflict:
            if last == 1:
                raise
        finally:
            discard(fresh)
    raise AssertionError("attempts must be positive")
