"""Injection gate and ingest."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import pii, text
from recollex.functions.text import held
from recollex.operators.automaton import held_phrases
from recollex.rules import RULE_PATTERNS, built_in_rules
from recollex.staging import small, staged


def needed_words(pattern: str) -> list[str]:
    """Words of which a text must hold one for the pattern to match; empty if there are none to tell. These are the
    alternatives of a group at the top that is not optional, each as far as it is literal; of such groups the one whose
    shortest word is longest."""
    if re.search(r"\\[()|]|\[[^\]]*[()|]", pattern) or len(_alternatives(pattern)) > 1:
        return []
    best: list[str] = []
    depth, start = 0, 0
    for i, c in enumerate(pattern):
        if c == "(":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif c == ")":
            depth -= 1
            if depth == 0 and pattern[i + 1 : i + 2] not in ("?", "*", "{"):
                words = [re.match(r"(?:[a-z ](?![?*{]))*", w.removeprefix("?:")).group() for w in _alternatives(pattern[start:i])]
                if min(map(len, words)) > min(map(len, best), default=2):
                    best = words
    return sorted(w for w in set(best) if not any(o != w and o in w for o in best))


def _alternatives(group: str) -> list[str]:
    out, depth = [""], 0
    for c in group:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def with_labels(rows: DataFrame, rules=None, body: str = "text") -> DataFrame:
    """rows with labels: those of the rules that match, each once, in the order of its first rule that matches.

    One pass of an automaton finds all literal phrases, and the words that the regular expressions need. An expression is
    tried only on texts that hold what it needs (a CJK character for the built-in ones of Chinese labels, else one of its
    words), so most texts meet none. The lower-cased text, the phrases and each label's place are columns of their own, so
    that each is computed once."""
    rules = list(rules or built_in_rules())
    guarded = {p for p, label in RULE_PATTERNS if label.endswith("·中文")}
    needs = {p: needed_words(p) for p, regex, _ in rules if regex and p not in guarded}
    word = {w: len(rules) + k for k, w in enumerate(sorted({w for ws in needs.values() for w in ws}))}
    phrases = [(i, p) for i, (p, regex, _) in enumerate(rules) if not regex] + [(k, w) for w, k in word.items()]
    low = rows.withColumn("__low", F.lower(body)).withColumn("__cjk", F.col("__low").rlike(text.CJK))
    low = low.withColumn("__held", held_phrases(F.col("__low"), phrases) if phrases else F.array().cast("array<int>"))

    def matches(p: str) -> Column:
        hit = F.col("__low").rlike(p)
        if p in guarded:
            return F.col("__cjk") & hit
        return F.arrays_overlap("__held", F.array(*[F.lit(word[w]) for w in needs[p]])) & hit if needs[p] else hit

    places: dict[str, list[Column]] = {}
    for i, (p, regex, label) in enumerate(rules):
        if regex:
            places.setdefault(label, []).append(F.when(matches(p), F.lit(i)))
    names = {f"__at{k}": F.coalesce(*found) for k, found in enumerate(places.values())}
    found = low.withColumns(names)
    at = F.concat(F.array(*[F.col(n) for n in names]).cast("array<int>"), F.filter("__held", lambda i: i < len(rules)))
    label_of = text.constant_list([label for *_, label in rules])
    labels = F.array_distinct(F.transform(F.array_sort(F.filter(at, lambda x: x.isNotNull())), lambda i: F.element_at(label_of, i + 1)))
    return found.select(*rows.columns, text.held(labels).alias("labels"))


def ingest(new: DataFrame, known: DataFrame, rules=None) -> DataFrame:
    """New memories (memory_id, ts, source, text) that pass the gate, redacted, hashed over the full redacted text, once
    per hash (the least memory_id), unless the hash is known. Rows: memory_id, ts, source, summary, content_hash, entities."""
    passed = pii.with_redaction(with_labels(new, rules).where(F.size("labels") == 0)).withColumnRenamed("redacted", "clean")
    hashed = passed.withColumn("content_hash", text.content_hash(F.col("clean")))
    once = hashed.groupBy("content_hash").agg(F.min_by(F.struct("memory_id", "ts", "source", "clean"), "memory_id").alias("r"))
    fresh = once.join(known.select("content_hash").distinct(), "content_hash", "left_anti").select("content_hash", "r.*")
    return fresh.select("memory_id", "ts", "source", F.substring("clean", 1, K.SUMMARY_CHARS).alias("summary"), "content_hash", text.entities(F.col("clean")).alias("entities"))


def quarantine(new: DataFrame, rules=None) -> DataFrame:
    """Rows that the gate rejects, with their labels."""
    return with_labels(new, rules).where(F.size("labels") > 0)


def containing(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, item_id of docs (doc_id, t) that hold the whole text of passages (item_id, passage). Both are cut into
    words; a text that holds a passage of so many whole words and two more holds the run of words after its first, so one
    run of each passage, the rarest by hash, is looked up among the documents' runs, and the hits are verified. Shorter
    passages are few and compared with all texts, behind a count."""
    cut = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = passages.withColumn("w", cut(F.col("passage")))
    long = p.where(F.size("w") >= words + 2)
    run = lambda w, i: F.xxhash64(F.slice(w, i, words))
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - words), lambda i: run(F.col("w"), i))
    keys = staged(long.select("item_id", "passage", F.array_min(inner).alias("key")), "passages")
    d = docs.withColumn("w", held(cut(F.col("t"))))
    runs = d.where(F.size("w") >= words).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: run(F.col("w"), i)))).alias("key"))
    met = staged(runs.join(small(keys, keys.count()), "key").select("doc_id", "item_id"), "met")
    hits = met.join(keys.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "t"), "doc_id").where(F.contains(F.col("t"), F.col("passage")))
    rest = staged(p.where(F.size("w") < words + 2).select("item_id", "passage"), "short")
    n = rest.count()
    return hits.select("doc_id", "item_id").distinct().unionByName(docs.join(small(rest, n, 1000), F.contains(F.col("t"), F.col("passage"))).select("doc_id", "item_id")) if n else hits.select("doc_id", "item_id").distinct()
