"""Sources, sinks and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from recollex.sources import readers, sinks
from recollex.streaming import guards


def test_memories(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a", "timestamp": "2024-01-01T00:00:00", "summary": "x"}, {"id": "b", "demoted": True, "scene": "s"}]))
    rows = {r.id: r for r in readers.read_memories(spark, f"file://{tmp_path}/m.json").collect()}
    assert rows["a"].scene == "general" and not rows["a"].demoted and rows["b"].demoted and rows["a"].access_count == 0
    assert readers.read_memories(spark, f"file://{tmp_path}/none.json").count() == 0


def test_graph_and_vectors(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entities": {"a": {"name": "A", "first_seen": "2024-01-02T00:00:00"}}, "relations": [{"source": "a", "target": "b", "relation": "uses", "created": "2024-01-03T00:00:00"}]}))
    e, r = readers.read_graph(spark, f"file://{tmp_path}/g.json")
    assert e.head().valid_from == dt.datetime(2024, 1, 2) and r.head().valid_from == dt.datetime(2024, 1, 3) and r.head().valid_until is None
    (tmp_path / "v.json").write_text(json.dumps({"vectors": [{"memory_id": "a", "vector": [1, 2]}]}))
    assert readers.read_vectors(spark, f"file://{tmp_path}/v.json").head().vector == [1.0, 2.0]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: A\n---\nbody")
    (tmp_path / "b.txt").write_text("no")
    md = readers.read_markdown(spark, f"file://{tmp_path}").collect()
    assert [m.filename for m in md] == ["a.md"]
    assert {r.path.split("/")[-1] for r in readers.inventory(spark, f"file://{tmp_path}").collect()} == {"a.md", "b.txt"}
    (tmp_path / "s.jsonl").write_text('{"input_tokens": 5}\nbroken\n{"totalTokens": 7}\n')
    log = readers.newest_file(readers.read_session_log(spark, f"file://{tmp_path}/s.jsonl"))
    assert sorted(r.tokens or 0 for r in log.collect()) == [0, 5, 7]


def test_snapshots(spark, tmp_path):
    t = f"file://{tmp_path}/t"
    sinks.write_snapshot(spark.range(3), t)
    sinks.write_snapshot(sinks.read_snapshot(spark, t).where("id > 0"), t)  # a table from itself
    assert sinks.read_snapshot(spark, t).count() == 2
    assert sinks.read_snapshot(spark, f"{t}-none", "id long").count() == 0
    sinks.append_bounded(spark.range(10, 13), t, [F.desc("id")], 4)
    assert sorted(r.id for r in sinks.read_snapshot(spark, t).collect()) == [2, 10, 11, 12]


def test_backup(spark, tmp_path):
    for d in ("01", "02", "03", "04"):
        assert sinks.daily_backup(spark.range(1), f"file://{tmp_path}/b", f"2024-01-{d}")
    assert not sinks.daily_backup(spark.range(1), f"file://{tmp_path}/b", "2024-01-04")
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["dt=2024-01-02", "dt=2024-01-03", "dt=2024-01-04"]


def test_burst(spark):
    base = 1_700_000_000.0
    log = spark.createDataFrame([(1, base + 2.0 * i) for i in range(31)] + [(2, base), (2, base + 1)], "user_id long, epoch double")
    out = guards.guard_batch(log, seconds=100).groupBy("user_id", "outcome").count().collect()
    assert {(r.user_id, r.outcome): r["count"] for r in out} == {(1, "accepted"): 30, (1, "burst"): 1, (2, "accepted"): 2}
    flags = guards.windowed_counts(log.withColumn("ts", F.timestamp_seconds("epoch")), "user_id", 60, 30)
    assert flags.where("hit").count() == 0 and flags.agg(F.max("n")).head()[0] == 30  # strictly less than 60 s apart


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(u, 1000.0 + 3 * i) for u in (1, 2) for i in range(40)], "user_id long, epoch double")
    log.repartition(1).sortWithinPartitions("epoch").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    q = guards.guard_stream(stream).writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((r.user_id, r.epoch, r.outcome) for r in df.collect())
    assert rows(spark.table("guarded")) == rows(guards.guard_batch(log))


def test_windows_stream(spark, tmp_path):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), "a", 1.0, 1) for h in range(3) for m in (0, 20, 50)], "ts timestamp, event_type string, value double, user_id long")
    e.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = guards.tumbling(s, late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start, r.n) for r in spark.table("tumbled").collect()) == sorted((r.start, r.n) for r in guards.tumbling(e).collect())


def test_loops(spark):
    calls = spark.createDataFrame([(1, i, n, "") for i, n in enumerate("abababcc")], "session_id long, seq long, name string, args string")
    assert [r.period for r in guards.loops(calls).orderBy("seq").collect()] == [None, None, None, 2, 2, 2, None, 1]
