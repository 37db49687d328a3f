"""Contradictions against all pairs, with blocks, tries and slices so small that all steps are taken."""

import datetime as dt
import random
import re

import numpy as np
import pytest

from recollex.operators import conflicts, reflection


@pytest.fixture
def notes(spark):
    r = random.Random(5)
    words = ["A", "ab", "b", "Ü", "上海", *[f"w{i:02}" for i in range(40)]]
    rows = [(i, dt.date(2024, 1, 1 + r.randrange(4)), sorted(set(r.choices(words, [1 / (1 + k % 9) for k in range(45)], k=r.randint(0, 9)))), r.choice(["positive", "negative", "neutral"])) for i in r.sample(range(10_000), 500)]
    rows += [(20_000 + i, d, t, m) for i, (_, d, t, m) in enumerate(rows[:40])] + [(30_000, None, ["A"], "positive"), (30_001, dt.date(2024, 1, 1), ["A", "w01"], None)]
    # under `z` no two notes are apart before it
    rows += [(40_000 + i, dt.date(2024, 1, 1 + i % 4), ["y0", "y1" if i % 3 else "y2", f"y3{i}", "z"], ["positive", "negative"][i // 4 % 2]) for i in range(60)]
    return rows, spark.createDataFrame(rows, "id long, day date, topics array<string>, mood string")


def _plain(rows):
    out = {}
    for a, day_a, s, mood_a in rows:
        for b, day_b, t, mood_b in rows:
            if {mood_a, mood_b} == {"positive", "negative"} and day_a and day_b and day_a < day_b and set(s) & set(t):
                key = min(set(s) & set(t), key=str.encode), day_a, day_b
                out[key] = min(out.get(key, (a, b)), (a, b))
    return out


@pytest.mark.parametrize(("rows", "group", "pairs", "tried", "slice_"), [(8192, 50_000, 1 << 18, 1024, 2048), (16, 100, 64, 4, 8), (60, 100, 1000, 1, 3)])
def test_equals_all_pairs(monkeypatch, notes, rows, group, pairs, tried, slice_):
    for k, v in {"ROWS": rows, "GROUP": group, "PAIRS": pairs, "TRIED": tried, "SLICE": slice_}.items():
        monkeypatch.setattr(conflicts, k, v)
    found = reflection.contradictions(notes[1]).collect()
    want = _plain(notes[0])
    assert len(found) == len(want) > 100 and {(x.topic, x.day_a, x.day_b): (x.id_a, x.id_b) for x in found} == want


def test_no_notes(spark):
    none = spark.createDataFrame([], "id long, day date, topics array<string>, mood string")
    assert reflection.contradictions(none).count() == 0


def test_notes_of_a_topic_do_not_meet_in_a_join(notes):
    plan = reflection.contradictions(notes[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not re.search(r"Join Inner", plan)


@pytest.mark.parametrize(("tried", "slice_", "pairs"), [(0, 3, 50), (0, 2048, 50), (5, 3, 7), (1024, 2048, 1 << 18)])
def test_first_sets_apart(monkeypatch, tried, slice_, pairs):
    for k, v in {"PAIRS": pairs, "TRIED": tried, "SLICE": slice_}.items():
        monkeypatch.setattr(conflicts, k, v)
    r = random.Random(tried)
    sets = [set(r.choices(range(30), [20 if i % 40 < 2 else 1 for i in range(30)], k=r.randint(0 if i < 40 else 3, 9))) for i in range(300)]
    s = conflicts._Sets(np.array([x for t in sets for x in sorted(t)]), np.cumsum([0, *map(len, sets)]))
    a0, b0 = np.array([0, 40, 100, 150, 200, 250, 260]), np.array([100, 60, 200, 260, 40, 251, 0])
    na, nb = np.array([40, 20, 50, 40, 70, 1, 40]), np.array([60, 40, 60, 10, 90, 9, 3])
    x, y = conflicts._firsts(s, a0, na, b0, nb)
    want = [min(((a, b) for a in range(p, p + n) for b in range(q, q + m) if not sets[a] & sets[b]), default=(-1, -1)) for p, n, q, m in zip(a0, na, b0, nb, strict=True)]
    assert list(zip(x, y, strict=True)) == want


def test_first_sets_apart_where_none_are(monkeypatch):
    monkeypatch.setattr(conflicts, "TRIED", 0)
    s = conflicts._Sets(np.array([1, 1, 1]), np.array([0, 1, 2, 3, 3]))
    one = lambda *x: [np.array([v]) for v in x]
    assert [v.tolist() for v in conflicts._firsts(s, *one(0, 2, 2, 1))] == [[-1], [-1]]
    assert [v.tolist() for v in conflicts._firsts(s, *one(0, 2, 2, 2))] == [[0], [3]]
    assert [v.tolist() for v in conflicts._firsts(s, *one(3, 1, 3, 1))] == [[3], [3]]
