"""Hard negatives, BPE and periodic runs against brute force and the public library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollex.llm import bpe, hard_negatives, periodic_runs
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


# ---- hard negatives


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """The same by scoring every row with every anchor. rows: (vec_id, label, vector)."""
    out = []
    for i, label, x in rows:
        if not is_anchor(i):
            continue
        scored = sorted(((sum(a * b for a, b in zip(x, y, strict=False)), j, m) for j, m, y in rows), key=lambda r: (-r[0], r[1]))
        for p, j in [(s, j) for s, j, m in scored if m == label and j != i][:positives]:
            fits = [(s, k) for s, k, m in scored if m != label and low * p <= 100 * s <= high * p][:negatives]
            out += [(i, j, r, k, p, s) for r, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, vector array<long>").withColumns({c: F.lit(7) for c in "x ids score anchor leaf salt rank wave n p is_anchor".split()})


def agrees(spark, rows, is_anchor=lambda i: i % 10 == 0, **kw):
    got = hard_negatives.mine_hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **kw)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, is_anchor, **kw)


@pytest.fixture
def tiny(monkeypatch):
    """Many blocks, waves, leaves and rankings on few rows."""
    for name, value in {"BLOCK": 40, "WAVE": 12, "LEAF": 5, "SAMPLE": 100, "PAIRS": 7, "FOUND": 30}.items():
        monkeypatch.setattr(hard_negatives, name, value)


def test_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * x)) for x in r.embedding]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = hard_negatives.op11_hard_negatives(spark, DATA).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("seed", range(3))
def test_negatives_in_small_blocks(spark, tiny, seed):
    rng = random.Random(seed)
    centres = [[rng.randrange(-40, 41) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [c + rng.randrange(-4, 5) for c in rng.choice(centres)]) for i in range(300)]
    agrees(spark, rows)


def test_ties_and_a_hot_vector(spark, tiny):
    """Scores of a few values only, one vector in a third of the rows, labels that are rare, and positives of score 0."""
    rng = random.Random(9)
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(3), [2, 1, 0] if i % 3 == 0 else [rng.randrange(-1, 3) for _ in range(3)]) for i in range(240)]
    rows += [(1000, 77, [1, 1, 1]), (1010, 1, [0, 0, 0]), (1020, 1, [-1, 0, 0])]
    agrees(spark, rows)
    agrees(spark, rows, positives=3, negatives=4, low=50, high=100)


def test_negatives_edges(spark, monkeypatch):
    rows = [(0, 1, [3, 1]), (1, 1, [2]), (2, 2, [2, 0, 5]), (3, 2, []), (10, 2, [2**40, 2**40]), (11, 2, [2**40, -(2**40)]), (12, 1, [1, 2**40])]
    bad = [(None, 1, [1, 1]), (4, None, [1, 1]), (5, 1, None), (6, 1, [1, None])]
    got = hard_negatives.mine_hard_negatives(table(spark, rows + bad), F.col("vec_id") % 10 == 0).collect()
    cut = lambda s: max(min(s, 2**63 - 1), -(2**63))
    pad = [(i, m, x + [0] * (3 - len(x))) for i, m, x in rows]
    assert sorted(tuple(r) for r in got) == [(*r[:4], cut(r[4]), cut(r[5])) for r in mined(pad, lambda i: i % 10 == 0)]
    for none in ([], bad, [(1, 1, [1])]):
        assert hard_negatives.mine_hard_negatives(table(spark, none), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine_hard_negatives(table(spark, [(10, 1, []), (11, 1, []), (12, 2, [])]), F.col("vec_id") % 10 == 0).collect() == [(10, 11, 1, 12, 0, 0)]
    twice = [(10, 1, [4, 4]), (11, 1, [4, 4]), (12, 2, [3, 3]), (12, 2, [3, 3])]
    got = hard_negatives.mine_hard_negatives(table(spark, twice), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(10, 11, 1, 12, 32, 24), (10, 11, 2, 12, 32, 24)]


def test_node_pairs_are_pruned(monkeypatch):
    """Boxes bound all products, and clustered rows leave few pairs of leaves to score."""
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-5, 6, (4000, 8))).astype(np.int64)
    x = x[np.lexsort(x.T)]
    pack = lambda x: (lambda o: (o, o % 3, x[o]))(hard_negatives._in_tree_order(np.arange(len(x)) * 0, x))
    a, c = hard_negatives.Forest([pack(x[::4])]), hard_negatives.Forest([pack(x)])
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(a.first)), np.arange(len(c.first)), indexing="ij"))
    low, high = hard_negatives.intervals(a, c, i, j)
    for k in range(0, len(i), 397):
        s = a.x[a.first[i[k]] : a.end[i[k]]] @ c.x[c.first[j[k]] : c.end[j[k]]].T
        assert low[k] <= s.min() and s.max() <= high[k]
    n = len(a.ids)
    search = hard_negatives.Search(a, np.arange(n), np.full(n, -(2**63)), np.full(n, 2**63 - 1), 5, True)
    search.visit(c)
    assert search.leaf_pairs < 0.25 * (a.left < 0).sum() * (c.left < 0).sum()


# ---- BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


SPELLED = ["", " ", "a", "AbC's DON'T 's'll'", "x<|endoftext|>y <|startoftext|><|endoftext|", "><|endoftext|>\u0338", "\u03a3\u0391\u03a3 \u0130I\u0307", "e\u0301 \u00e9 \u1e9b\u0323", "a\u00a0b\u2003c\u0085d\x1ce\x00f", "12345 \u0663\u00bd 7th", "\U0001f600\u200d\u2764\ufe0f", "...!!!???<<>>", "a" * 5000, "ab" * 3001 + "!", "\u4e2d\u6587" * 500, "\u00c0\u00d7\u00df \u00f7\u00ff"]


def test_bpe(spark, library):
    path, t = library
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rng = random.Random(2)
    letters = "ab eE'tsS1.<|>\u00e9\u00c9\u0301\u03a3\u4e2d\t\n"
    odd = SPELLED + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows += [(-i, x) for i, x in enumerate(odd, 1)] + [(-9999, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(d, path), path).collect()}
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids, x
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, library):
    out = {r.doc_id: r for r in bpe.op12_bpe(spark, DATA).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library[1].encode(r.text or "", add_special_tokens=False).ids
        assert tuple(out[r.doc_id]) == (r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library[1].decode(ids, skip_special_tokens=False)))


def test_bpe_forgets(library, monkeypatch, spark):
    """A full memory of units starts anew."""
    from recollex.llm import packing

    monkeypatch.setattr(packing, "CACHED_UNITS", 5)
    units = bpe._Units(bpe.vocabulary(library[0]))
    for text in ("one two three four", "five six seven one", "eight NINE don't", "one two"):
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, at = units(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library[1].encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


# ---- periodic runs


def all_runs(w, least=12):
    """Runs by trying every period at every place."""
    out, seen = [], set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p) and (s, i + p) not in seen:
                seen.add((s, i + p))
                out.append((s, i + p - s, p))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("small", [False, True])
def test_runs(small, monkeypatch):
    rng = random.Random(4)
    for _ in range(1500):
        if small:
            for name, most in (("POINTS", 60), ("NEAR", 4), ("CHUNK", 4), ("BATCH", 20)):
                monkeypatch.setattr(periodic_runs, name, rng.randrange(1, most))
        n, k = rng.randrange(130), rng.choice([1, 2, 3, 5, 30])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a + p, min(n, a + rng.randrange(1, 70))):
                w[i] = w[i - p]
        least = rng.choice([12, 5, 2])
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64), least).tolist()] == all_runs(w, least), w


def test_long_runs():
    """One repeated word, with and without breaks, and repeated passages stay cheap at any length."""
    assert periodic_runs.runs_of(np.ones(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    broken = np.ones(20_000, np.int64)
    broken[10_000] = 2
    assert [r for r in periodic_runs.runs_of(broken).tolist() if r[2] == 1] == [[0, 10_000, 1], [10_001, 9_999, 1]]
    assert periodic_runs.runs_of(np.tile(np.arange(777), 200)).tolist() == [[0, 155_400, 777]]


def test_runs_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, DATA).collect()}
    assert set(out) == set(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for i, text in rows.items():
        w = brute.words(text)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        if len(w) > 2000:
            continue  # trying everything takes too long
        runs = all_runs(w)
        with_runs += bool(runs)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert tuple(out[i]) == want
    assert with_runs > 10
