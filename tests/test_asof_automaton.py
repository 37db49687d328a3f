"""As-of joins and counts, and the phrase automaton, against brute force."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from recollex import rules
from recollex.operators import asof, automaton, gate

BASE = dt.datetime(2024, 1, 1)


def _moment(r, span):
    return BASE + dt.timedelta(microseconds=r.randint(0, span))


def _holds(at, start, stop):
    if start is None:
        return True
    return at is not None and start <= at and (stop is None or stop > at)


@pytest.mark.parametrize(("seed", "span"), [(1, 40), (2, 10**6), (3, 10**13)])
def test_asof_equals_brute_force(spark, seed, span):
    r = random.Random(seed)
    times = [(i, r.randint(0, 2), None if r.random() < 0.05 else _moment(r, span)) for i in range(120)]
    held = []
    for i in range(150):
        a = None if r.random() < 0.1 else _moment(r, 2 * span) - dt.timedelta(microseconds=span // 2)
        b = None if r.random() < 0.2 else _moment(r, 2 * span) - dt.timedelta(microseconds=span // 2)
        held.append((i, 0 if r.random() < 0.6 else r.randint(0, 2), a, b))  # a hot key; ends before starts too
    t = spark.createDataFrame(times, "t long, k int, at timestamp_ntz")
    v = spark.createDataFrame(held, "r long, k int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    for keys in ([], ["k"]):
        want = [(x[0], y[0]) for x in times for y in held if (not keys or x[1] == y[1]) and _holds(x[2], y[2], y[3])]
        rows = v if keys else v.drop("k")
        assert sorted((x.t, x.r) for x in asof.join(t, rows, keys).collect()) == want
        n = {x.t: x.valid for x in asof.counts(t, rows, keys).collect()}
        assert n == {x[0]: sum(1 for w in want if w[0] == x[0]) for x in times}


def test_asof_empty_and_alike(spark):
    t = spark.createDataFrame([(1, BASE), (2, BASE), (2, BASE)], "t long, at timestamp_ntz")
    v = spark.createDataFrame([(1, BASE, None), (2, None, BASE), (3, BASE, BASE)], "r long, valid_from timestamp_ntz, valid_until timestamp_ntz")
    assert asof.join(t, v).count() == 6 and {x.valid for x in asof.counts(t, v).collect()} == {2}
    assert asof.join(t, v.where("false")).count() == 0 and [x.valid for x in asof.counts(t, v.where("false")).collect()] == [0, 0, 0]
    assert asof.join(t.where("false"), v).count() == 0 and asof.counts(t.where("false"), v).count() == 0


def test_asof_broadcasts_no_side(spark, tmp_path):
    """The ranges of a table of some MB are many times the rows that Spark takes them for."""
    spark.createDataFrame([(1, BASE)], "t long, at timestamp_ntz").write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, BASE, None)], "r long, valid_from timestamp_ntz, valid_until timestamp_ntz").write.parquet(f"{tmp_path}/v")
    t, v = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/v")
    assert "Broadcast" not in asof.join(t, v)._jdf.queryExecution().executedPlan().toString()


def test_long_intervals_make_few_rows(spark):
    v = spark.range(50).select("id", F.lit(BASE).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    cut = v.select(F.explode(asof._cover(F.lit(1).cast("long"), F.lit(asof.CELLS - 1).cast("long"))).alias("n"))
    assert cut.count() <= 50 * 2 * asof.DEPTH


@pytest.mark.parametrize("slab", [7, 64, automaton.SLAB])
def test_automaton_equals_contains(monkeypatch, slab):
    monkeypatch.setattr(automaton, "SLAB", slab)
    r = random.Random(slab)
    for trial in range(60):
        monkeypatch.setattr(automaton, "LANES", r.choice([1, 3, 2048]))
        phrases = [(i, "".join(r.choice("abc忘") for _ in range(r.randint(0 if trial % 10 == 0 else 1, 5)))) for i in range(r.randint(0, 12))]
        texts = ["".join(r.choice("abcd忘😀") for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(r.randint(0, 9))]
        assert automaton.Automaton(phrases).find(texts) == [[i for i, p in phrases if p in t] for t in texts]


def test_labels_from_a_large_rule_file(spark, tmp_path):
    """A file of two thousand phrases and some patterns: one pass gives what a loop over the rules gives."""
    r = random.Random(5)
    phrases = [["".join(r.choice("abcdef ") for _ in range(r.randint(3, 9))), f"L{i % 40}"] for i in range(2000)]
    given = [["re:ab+c", "L3"], *phrases[:1000], ["re:(one|two)[ ]x", "L50"], *phrases[1000:], ["Ignore Above", "L51"]]
    file = tmp_path / "rules.json"
    file.write_text(json.dumps(given))
    loaded = rules.load_rules(str(file))
    texts = ["".join(r.choice("abcdef ") for _ in range(r.choice([0, 20, 400]))) for _ in range(60)] + ["so IGNORE above it", "one x", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {x.id: x.labels for x in gate.with_labels(rows, loaded).collect()}

    import re

    for i, t in enumerate(texts):
        low, want = (t or "").lower(), []
        for p, regex, label in loaded:
            if t is not None and (re.search(p, low) if regex else p in low) and label not in want:
                want.append(label)
        assert (found[i] or []) == want
