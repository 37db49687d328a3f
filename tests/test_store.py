"""The stored index, similarity joins, knowledge records, sinks with guards, settings and pluggable models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recollex.config import Config
from recollex.operators import gate, index, kg, knowledge, lifecycle, security
from recollex.sources import readers, sinks
from recollex.streaming import guards


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
def test_similar_sets_brute_force(spark, threshold):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, sorted({words[min(39, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(3, 14))})) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(4)]
    want = {}
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        j = len(set(x) & set(y)) / len(set(x) | set(y))
        if j >= threshold:
            want[min(a, b), max(a, b)] = j
    out = lifecycle.similar_sets(spark.createDataFrame(rows, "memory_id long, k array<string>"), threshold).collect()
    assert len(out) == len(want) and {(r.a, r.b): pytest.approx(r.jaccard) for r in out} == want


def test_merge_uses_each_row_once(spark):
    """Leaders of many rows compete for the same partner: it joins the first, whatever the rows' sources."""
    pairs = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (5, 9), (4, 9)], "a long, b long")
    groups = lifecycle.merge_groups(pairs, spark.range(20).withColumnRenamed("id", "memory_id")).collect()
    ids = [r.memory_id for r in groups]
    assert len(ids) == len(set(ids)) and {(r.leader, r.memory_id) for r in groups} == {(1, 1), (1, 5), (4, 4), (4, 9)}


def test_merge_candidates(spark):
    m = spark.createDataFrame([(1, None, None, None), (2, True, None, None), (3, False, "M", None), (4, False, None, True)], "memory_id long, demoted boolean, merged_into string, is_merged boolean")
    assert [r.memory_id for r in lifecycle.merge_candidates(m).collect()] == [1]


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xx a quick brown fox jumps over it yy"), (2, "a quick brown fox leaps"), (3, "tiny"), (4, None), (5, "pre" + "one two three four five six" + "post")], "doc_id long, t string")
    items = spark.createDataFrame([(7, "quick brown fox jumps over it"), (8, "tiny"), (9, "one two three four five six"), (10, "no such passage in any document")], "item_id long, passage string")
    assert {(r.doc_id, r.item_id) for r in gate.containing(docs, items).collect()} == {(1, 7), (3, 8), (5, 9)}


@pytest.mark.parametrize(("pattern", "words"), [("(a|b)c", []), ("(forget|ignore)x(all|any)", ["forget", "ignore"]), ("(ignore)?abc", []), ("foo(barren)|zoo", []), ("(codes?|rules)", ["code", "rules"]), ("(\\(paren|other)", [])])
def test_needed_words(pattern, words):
    assert gate.needed_words(pattern) == words


def test_index_keeps_up(spark):
    m = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red hen", "blue fox", ""])], "memory_id long, summary string")
    changed = spark.createDataFrame([(1, "green hen"), (9, "new fox")], "memory_id long, summary string")
    kept = index.maintain(index.postings(m), changed, spark.createDataFrame([(2,)], "memory_id long"))
    now = m.where("memory_id not in (1, 2)").unionByName(changed)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, index.postings(now).collect()))
    hits = index.lookup(kept, index.totals(now), "fox", 1).collect()
    assert [r.memory_id for r in hits] == [0]


def test_knowledge_records(spark):
    notes = spark.createDataFrame([(1, "How to: ship", ["a"], " body "), (2, "how to: ship", ["b"], "x"), (3, "???", [], "y"), (4, "发布 流程", ["c"], "z")], "note_id long, title string, triggers array<string>, body string")
    out = {r.note_id: r for r in knowledge.record(notes, spark.createDataFrame([("how_to__ship.md",)], "filename string")).collect()}
    assert [out[i].filename for i in (1, 2, 3, 4)] == ["how_to__ship_01.md", "how_to__ship_02.md", "workflow.md", "发布_流程.md"]
    files = spark.createDataFrame([(r.filename, r.content) for r in out.values()], "filename string, content string")
    assert knowledge.read(files, "ship_02").head().body == "x" and knowledge.read(files, "none").head() is None
    assert {r.filename: r.triggers for r in knowledge.index(files).collect()}["workflow.md"] == []


def test_a_thousand_equal_titles(spark):
    """Every note gets a name of its own, the first that is free, whatever files and other titles there are."""
    titles = ["Same"] * 1000 + ["same_07", "other", "same_150", "same_07"]
    notes = spark.createDataFrame([(i, t, ["a"], "x") for i, t in enumerate(titles)], "note_id long, title string, triggers array<string>, body string")
    known = ["same.md", "same_03.md", "same_0003.md", "same_12.txt", "other_01.md", "same_1003.md"]
    out = {r.note_id: r.filename for r in knowledge.record(notes, spark.createDataFrame([(k,) for k in known], "filename string")).collect()}
    used, want, plain = set(known), {}, {t.lower() for t in titles}
    for i, t in enumerate(titles):
        base = t.lower()
        names = [f"{base}.md"] + [f"{base}_{k:02d}.md" for k in range(1, 1200)]
        want[i] = next(n for n in names if n not in used and (n == f"{base}.md" or n[:-3] not in plain))
        used.add(want[i])
    assert out == want and len(set(out.values())) == len(titles)


def test_snapshots_and_rate(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    assert sinks.write_snapshot(spark.range(1), t) == 1 and sinks.write_snapshot(spark.range(2), t) == 2
    assert sinks.read_snapshot(spark, t, version=1).count() == 1
    for k in range(3):
        sinks.check_rate(spark, f"{t}2", now=100.0 + k, limit=3)
    with pytest.raises(sinks.Locked):
        sinks.check_rate(spark, f"{t}2", now=104.0, limit=3)
    sinks.check_rate(spark, f"{t}2", now=200.0, limit=3)  # the old writes are out of the window


def test_refs_and_alerts(spark, tmp_path):
    t = f"file://{tmp_path}/refs"
    sinks.save_refs(spark.createDataFrame([("a", "1"), ("b", "2")], "name string, content string"), t)
    assert sinks.read_ref(spark, t, "a") == "1" and sinks.read_ref(spark, t, "z") is None and sinks.list_refs(spark, t).count() == 2
    sinks.delete_refs(spark, t, ["a"], f"{t}-new")
    assert [r.content for r in sinks.read_snapshot(spark, f"{t}-new").collect()] == ["2"]
    sent = []
    for k in range(3):
        sinks.send_alert(spark, f"file://{tmp_path}/alerts", spark.createDataFrame([(f"t{k}", "b")], "title string, body string"), 2, lambda *x: sent.append(x))
    assert sinks.read_snapshot(spark, f"file://{tmp_path}/alerts").count() == 2 and len(sent) == 3


def test_encrypted_tables_and_passwords(spark, tmp_path):
    key, path = security.derive_key("pw", b"salt"), f"file://{tmp_path}/enc"
    sinks.write_encrypted(spark.createDataFrame([(1, "x"), (2, None)], "id long, t string"), path, key)
    assert sorted(map(tuple, readers.read_encrypted(spark, path, key, "id long, t string").collect())) == [(1, "x"), (2, None)]
    assert readers.read_encrypted(spark, path, security.derive_key("no", b"salt"), "id long, t string").count() == 0
    record = security.password_record("s3cret")
    assert security.verify_password("s3cret", record) and not security.verify_password("other", record)


def test_config_file(tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.read(path) == Config()
    c = Config().set(path, "budget_chars", "900").set(path, "warn_language", "zh")
    assert Config.read(path) == c and c.budget_chars == 900
    for key, value in (("budget_chars", "10"), ("mild", "2"), ("warn_language", "fr"), ("none", "1"), ("mild", "x")):
        with pytest.raises((ValueError, KeyError)):
            c.set(path, key, value)
    assert Config.read(path) == c


def test_success_clears_failures(spark):
    rows = [(1, t, ok) for t, ok in [(0, False), (10, False), (20, True), (30, False), (40, False), (50, False), (9000, False)]]
    log = spark.createDataFrame(rows, "user long, s long, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = {r.s: (r.n, r.locked) for r in guards.lockouts(log, "user", 600, 3).collect()}
    assert out == {0: (1, False), 10: (2, False), 30: (1, False), 40: (2, False), 50: (3, True), 9000: (1, False)}


def test_ring_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, f"r{i}") for k in (1, 2) for i in range(5)], "session_id long, seq long, text string")
    rows.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = guards.ring_stream(s).writeStream.format("memory").queryName("ring").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.session_id, r.place, r.text) for r in spark.table("ring").collect()) == [(k, p, f"r{5 - p}") for k in (1, 2) for p in (1, 2, 3)]


def test_model_with_fallback(spark):
    t = spark.createDataFrame([(1, "Mara uses Spark"), (2, "Otto uses Arrow")], "id long, text string")
    found = kg.extract_triples(t, model=lambda texts: [[("m", "r", "t")] if "Mara" in x else None for x in texts]).collect()
    assert {(r.id, r.source, r.target) for r in found} == {(1, "m", "t"), (2, "Otto", "Arrow")}
