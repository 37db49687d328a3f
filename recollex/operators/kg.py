"""Temporal knowledge graph: entities and relations with validity intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import text


#: What a text must hold for a pattern without CJK characters to match: by the pattern's place from the end.
_NEEDS = (("is",), ("work",), ("uses",), ("likes", "loves", "prefers"), ("created",), ("live", "based"), ("own", "manage"), ("know",))
#: The first run of such a pattern, and the same without steps back: what follows is a space, so no shorter run fits.
_RUN, _WHOLE_RUN = r"(\S{2,20})\s+", r"(\S{2,20}+)\s++"
_TRIPLES = "array<struct<seq:int,source:string,relation:string,target:string>>"


def triples(c: Column) -> Column:
    """Array of (seq, source, relation, target) in pattern order; skip words drop a triple. Patterns start with a run of
    any characters, which is slow to search for, so each is tried only on texts that hold what it needs: a word and, but
    for CJK patterns, what stands between the two runs. Their groups are read from the matches, which end where the last
    run does, so the text is searched once."""
    none, low, out = F.array().cast(_TRIPLES), F.lower(c), []
    first = len(K.TRIPLE_PATTERNS) - len(_NEEDS)
    for i, (pattern, relation) in enumerate(K.TRIPLE_PATTERNS[:first]):
        p = "(?i)" + pattern
        pairs = F.arrays_zip(text.find_all(c, p, 1).alias("s"), text.find_all(c, p, 2).alias("t"))
        out.append(F.transform(pairs, _triple(i, relation)))
    parts = [F.when(c.rlike(text.CJK), F.flatten(F.array(*out))).otherwise(none)]
    for i, needs in enumerate(_NEEDS, first):
        pattern, relation = K.TRIPLE_PATTERNS[i]
        holds = F.lit(False)
        for w in needs:
            holds = holds | F.contains(low, F.lit(w))
        between = "(?i)" + pattern.replace(_RUN, r"\s").rpartition("(")[0]
        p = "(?i)" + pattern.replace(_RUN, _WHOLE_RUN)
        found = F.transform(text.find_all(c, p), _groups(p))
        parts.append(F.when(holds & c.rlike(between), F.transform(found, _triple(i, relation))).otherwise(none))
    skip = text.constant_list(K.TRIPLE_SKIP)
    return F.filter(F.flatten(F.array(*parts)), lambda x: ~F.array_contains(skip, F.lower(x["source"])) & ~F.array_contains(skip, F.lower(x["target"])))


def _groups(pattern: str):
    return lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("s"), F.regexp_extract(m, pattern, 2).alias("t"))


def _triple(seq: int, relation: str):
    return lambda x: F.struct(F.lit(seq).alias("seq"), F.trim(x["s"]).alias("source"), F.lit(relation).alias("relation"), F.trim(x["t"]).alias("target"))


def extract_triples(rows: DataFrame, id_col: str = "id", body: str = "text", model=None) -> DataFrame:
    """id, seq, source, relation, target of each text. With a model, any function from a list of texts to lists of
    (source, relation, target), or None where it fails, its answer is taken and the patterns where it has none."""
    if model is not None:

        def ask(batches):
            for b in batches:
                out = model(b["__t"].tolist())
                b["__m"] = [None if o is None else [{"seq": i, "source": s, "relation": r, "target": t} for i, (s, r, t) in enumerate(o)] for o in out]
                yield b[["__id", "__m"]]

        kind = rows.schema[id_col].dataType.simpleString()
        asked = rows.select(F.col(id_col).alias("__id"), F.col(body).alias("__t")).mapInPandas(ask, f"__id {kind}, __m {_TRIPLES}")
        both = rows.join(asked, rows[id_col].eqNullSafe(asked["__id"]))
        return both.select(id_col, F.explode(F.coalesce("__m", triples(F.col(body)))).alias("x")).select(id_col, "x.seq", "x.source", "x.relation", "x.target")
    return rows.select(id_col, F.explode(triples(F.col(body))).alias("x")).select(id_col, "x.seq", "x.source", "x.relation", "x.target")


def valid_at(at: Column, start: str = "valid_from", stop: str = "valid_until") -> Column:
    """Half-open validity; an unknown start is always valid."""
    return F.col(start).isNull() | ((F.col(start) <= at) & (F.col(stop).isNull() | (F.col(stop) > at)))


def snapshot(relations: DataFrame, mode: str = "current", at: Column | None = None) -> DataFrame:
    """current: open relations; asof: those valid at a time; all: every one."""
    if mode == "all":
        return relations
    return relations.where(F.col("valid_until").isNull()) if mode == "current" else relations.where(valid_at(at))


def backfill(items: DataFrame, fallback: str) -> DataFrame:
    """valid_from from another column where it lacks; the end stays open."""
    return items.withColumn("valid_from", F.coalesce("valid_from", fallback))


def new_relations(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (source, relation, target) that known doesn't have, whether open or closed."""
    key = ["source", "relation", "target"]
    return found.select(*key).distinct().join(known.select(*key).distinct(), key, "left_anti")


def upsert_entities(mentions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """entity_id, first_seen, last_seen, mention_count of mentions (name, ts), merged with what is known."""
    fresh = mentions.select(text.normal_name(F.col("name")).alias("entity_id"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("mention_count"))
    every = fresh.unionByName(known) if known is not None else fresh
    return every.where("entity_id <> ''").groupBy("entity_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("mention_count").alias("mention_count"))


def invalidate(relations: DataFrame, condition: Column, at: Column, reason: str) -> DataFrame:
    """Open relations under a condition get an end and a reason."""
    hit = condition & F.col("valid_until").isNull()
    return relations.withColumn("invalid_reason", F.when(hit, F.lit(reason)).otherwise(F.col("invalid_reason"))).withColumn("valid_until", F.when(hit, at).otherwise(F.col("valid_until")))


def touching(relations: DataFrame, names: DataFrame, column: str = "entity") -> DataFrame:
    """Relations at either end of the given names: two equi joins, self-loops once; no join on OR."""
    ends = relations.join(names.withColumnRenamed(column, "source"), "source").withColumn("entity", F.col("source"))
    starts = relations.where("source <> target").join(names.withColumnRenamed(column, "target"), "target").withColumn("entity", F.col("target"))
    return ends.unionByName(starts)


def relation_label(c: Column) -> Column:
    out = c
    for key, label in K.RELATION_LABELS.items():
        out = F.when(c == key, label).otherwise(out)
    return out


def relation_text(source: Column, relation: Column, target: Column, until: Column) -> Column:
    ended = F.when(until.isNotNull(), F.concat(F.lit(" [expired "), F.date_format(until, "yyyy-MM-dd"), F.lit("]"))).otherwise("")
    return F.concat(source, F.lit(" "), relation_label(relation), F.lit(" "), target, ended)


def named(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations with display names for ends: names has entity_id and name, each id once; an end it lacks stays as it is."""
    out = relations
    for end in ("source", "target"):
        n = names.select(F.col("entity_id").alias(end), F.col("name").alias("__name"))
        out = out.join(n, end, "left").withColumn(end, F.coalesce("__name", end)).drop("__name")
    return out.select(*relations.columns)


def search(relations: DataFrame, query: str, at: Column | None = None, mode: str = "current", most: int = 8, names: DataFrame | None = None) -> DataFrame:
    """entity, rn, text: relations of the entities whose name shares a token with the query, under a snapshot, at most
    `most` an entity (by key). relations: source, relation, target, key, valid_from, valid_until. With names (entity_id,
    name) the ends are ids, and shown and searched by their names."""
    relations = relations if names is None else named(relations, names)
    wanted = [w for w in re.findall(r"[\u4e00-\u9fff]|[a-z0-9]+", query.lower())]
    valid = snapshot(relations, mode, at)
    names = valid.select(F.col("source").alias("entity")).union(valid.select("target")).distinct()
    tokens = text.find_all(text.normal_name(F.col("entity")), f"{text.CJK}|[a-z0-9]+")
    hits = names.where(F.arrays_overlap(tokens, text.constant_list(wanted)))
    met = touching(valid, hits)
    return _first(met, most).select("entity", "rn", relation_text(F.col("source"), F.col("relation"), F.col("target"), F.col("valid_until")).alias("text"))


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each entity by key; Spark keeps only so many a task before the shuffle."""
    rn = F.row_number().over(Window.partitionBy("entity").orderBy("key"))
    return rows.withColumn("rn", rn).where(F.col("rn") <= most).withColumn("rn", F.col("rn").cast("long"))


def add_triples(found: DataFrame, entities: DataFrame | None, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entities and the new relations that triples (source, relation, target, ts) bring into a graph: ends are
    normalised, mentions counted, and a relation is added unless the graph has it, open or closed."""
    ends = found.select(F.col("source").alias("name"), "ts").unionByName(found.select(F.col("target").alias("name"), "ts"))
    norm = found.select(text.normal_name(F.col("source")).alias("source"), "relation", text.normal_name(F.col("target")).alias("target"), "ts")
    fresh = norm.groupBy("source", "relation", "target").agg(F.min("ts").alias("valid_from"))
    key = ["source", "relation", "target"]
    return upsert_entities(ends, entities), fresh.join(relations.select(*key).distinct(), key, "left_anti")


def cross_scene_tunnels(scenes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """source, target, entity: pairs of scenes that share an entity (rows: scene, entity), one row a pair, without those known."""
    each = scenes.select("entity", "scene").distinct()
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.scene") < F.col("b.scene")))
    pairs = pairs.groupBy(F.col("a.scene").alias("source"), F.col("b.scene").alias("target")).agg(F.min("a.entity").alias("entity"))
    return pairs if known is None else pairs.join(known, ["source", "target"], "left_anti")
