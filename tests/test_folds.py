"""Compression and learning as sets against plain loops, and the prompt with its references."""

import random

from pyspark.sql import functions as F

from recollex.operators import context, reflection


def _loop(sections, budget):
    """{seq: (action, kept)} of one payload's [seq, name, n, priority, category], one section after the other."""
    size = {s[0]: s[2] for s in sections}
    action = {s[0]: "keep" for s in sections}
    mild, auto = int(budget * 0.7), int(budget * 0.85)
    if sum(size.values()) <= mild:
        return {q: ("keep", size[q]) for q in size}
    line = sorted(sections, key=lambda s: (s[3], s[0]))
    for floor, share, cap, least, enough, word, cut in ((9, 0.6, 200, 5, mild, "deferred", "truncated"), (7, 0.3, 100, 0, budget, "demoted", "truncated_aggressive")):
        if floor == 7 and sum(size[s[0]] for s in line) <= auto:
            break
        held, stay = 0, []
        for s in line:
            if s[3] < floor or held <= budget:
                held += s[2]
                stay.append(s)
            else:
                action[s[0]], size[s[0]] = word, 0
        line, total = stay, held
        for q, name, n, p, c in line:
            if total <= enough:
                break
            most = min(int(n * share), cap)
            if c == "memory" and p >= least and size[q] > most:
                total -= n - (most + 10 + len(name))
                size[q], action[q] = most + 10 + len(name), cut
    return {q: (action[q], size[q]) for q in size}


def test_compress_equals_loop(spark):
    rnd = random.Random(7)
    payloads = {}
    for i in range(300):
        top = rnd.choice((8, 80, 500))
        payloads[i] = [(q, "n" * rnd.randint(0, 12), rnd.randint(0, top), rnd.randint(1, 10), rnd.choice(("memory", "memory", "rule"))) for q in range(rnd.randint(1, 12))]
    rows = [(i, q, name, "x" * n, p, c) for i, ss in payloads.items() for q, name, n, p, c in ss]
    df = spark.createDataFrame(rows, "payload_id long, seq long, name string, content string, priority int, category string")
    seen = set()
    for budget in (60, 600, 2000):
        found = {}
        for r in context.compress(df, budget).collect():
            found.setdefault(r.payload_id, {})[r.seq] = (r.action, r.kept)
            seen.add(r.action)
        assert found == {i: _loop(ss, budget) for i, ss in payloads.items()}
    assert seen == {"keep", "deferred", "demoted", "truncated", "truncated_aggressive"}


def test_compress_moves_no_texts_twice(spark):
    df = spark.createDataFrame([(1, 1, "x", 5, "memory")], "payload_id long, seq long, content string, priority int, category string")
    plan = context.compress(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_injection_and_references(spark):
    rows = [(1, 1, "rules", "r" * 100, 1, "rule"), (1, 2, "old", "m" * 90, 6, "memory"), (1, 3, "blank", "  ", 2, "rule"), (1, 4, "late", "z", 10, "rule"), (2, 1, "a", "b", 9, "memory"), (2, 2, "c", "d", 1, "rule")]
    df = spark.createDataFrame(rows, "payload_id long, seq long, name string, content string, priority int, category string")
    out = {r.payload_id: r for r in context.injection(df, 150).collect()}
    assert out[1].text == "r" * 100 + "\n\n" + "m" * 27 + "… [↩ ref:old]" and out[1].actions == 2 and out[1].sections == 3
    assert out[2].text == "b\n\nd" and out[2].saved == 0  # a payload that fits keeps its order
    assert [(r.name, r.content) for r in context.cut_originals(df, 150).collect()] == [("old", "m" * 90)]


def test_compress_edges(spark):
    schema = "payload_id long, seq long, name string, content string, priority int, category string, n long, left string"
    df = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, 1, "a", "x" * 3000, None, None, 5, "q"), (1, 1, "a", "x" * 3000, None, None, 5, "q")], schema)
    out = sorted((r.payload_id or 0, r.action, r.kept) for r in context.compress(df).collect())
    assert out == [(0, "keep", 0), (1, "truncated", 211), (1, "truncated", 211)]
    assert context.compress(df.limit(0)).collect() == [] and context.injection(df.limit(0)).collect() == []


def _learn(lessons):
    kept = []
    for lesson in lessons:
        mine = {c for c in lesson if "一" <= c <= "鿿"}
        for k in kept:
            if k[0] == lesson or (mine and k[1] and len(mine & k[1]) / max(len(mine), len(k[1])) > 0.3):
                k[2] += 1
                break
        else:
            kept.append([lesson, mine, 1])
    return [(f"LSN-{i + 1:03d}", k[0], k[2], k[2] >= 3) for i, k in enumerate(kept)]


def test_learn_equals_loop(spark):
    rnd = random.Random(11)
    signs = "一丁七万丈三上下不与丐丑专且世丘"
    users = {u: ["".join(rnd.choice(signs + "ab ") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 40))] for u in range(60)}
    users[60] = [f"tab {i}" for i in range(1200)]  # more than three digits
    seen = spark.createDataFrame([(u, i, x) for u, xs in users.items() for i, x in enumerate(xs)] + [(99, 0, None)], "user_id long, seq long, lesson string")
    found = {}
    for r in reflection.learn(seen).orderBy("user_id", F.length("lesson_id"), "lesson_id").collect():
        found.setdefault(r.user_id, []).append((r.lesson_id, r.lesson, r["count"], r.promoted))
    assert found == {u: _learn(xs) for u, xs in users.items()}
    assert reflection.learn(seen.limit(0)).collect() == []


def test_lesson_classes_equal_all_pairs(spark):
    rnd = random.Random(3)
    signs = "一丁七万丈三上下不与丐丑专且世丘丙业丛东"
    lessons = [(i, "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 7)))) for i in range(300)]
    lessons += [(1000 + i, "一一丁七") for i in range(2000)] + [(5000, None), (5001, "plain"), (5002, "")]
    df = spark.createDataFrame(lessons, "id long, lesson string")
    sets = {i: frozenset(c for c in x or "" if "一" <= c <= "鿿") for i, x in lessons}
    for least in (0.0, 0.3, 0.75, 0.9):
        reps = {}
        for i, k in sorted(sets.items()):
            if k:
                reps.setdefault(k, i)
        members, close = reflection.lesson_classes(df, least)
        assert {(r.id, r.rep) for r in members.collect()} == {(i, reps[k]) for i, k in sets.items() if k}
        line = sorted(reps.items(), key=lambda x: x[1])
        want = {(a, b): len(x & y) / max(len(x), len(y)) for p, (x, a) in enumerate(line) for y, b in line[p + 1 :] if len(x & y) / max(len(x), len(y)) > least}
        assert {(r.ra, r.rb): r.overlap for r in close.collect()} == want
    few = df.where("id < 60")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if sets[a] and sets[b] and len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) > 0.3}
    assert {(r.a, r.b) for r in reflection.lesson_pairs(few).collect()} == want
    assert reflection.lesson_pairs(df.limit(0)).collect() == []
