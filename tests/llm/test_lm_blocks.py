"""Blocks of the language model: a part's blocks travel together, and a bucket's are looked up together."""

import numpy as np
import pyarrow as pa

from recollex.llm import lm_score


def test_a_part_is_one_batch():
    texts = [" ".join(f"w{(i * 7 + j) % 300}" for j in range(60)) for i in range(20)]
    (b,) = lm_score._blocks(1, 20, 1200, None)([pa.record_batch([pa.array(texts)], ["text"])])
    assert b.num_rows == 20 and b.column(0).to_pylist() == list(range(20))
    tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(2)])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(3)])
    assert len(set(tokens.tolist())) == len(tokens) == 301 and counts.sum() == 20 * 61
    assert [(lm_score._bucket(np.frombuffer(x.as_buffer(), np.uint64), 20) == k).all() for k, x in enumerate(b.column(2))] == [True] * 20
    assert list(lm_score._blocks(1, 20, 0, None)([pa.record_batch([pa.array([], pa.string())], ["text"])])) == []


def test_lookups_of_many_parts_equal_those_of_each(monkeypatch):
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 62, 500, dtype=np.uint64))
    known = pa.table({"bucket": pa.array([0, 0], pa.int32()), "k": [keys[:300].tobytes(), keys[300:].tobytes()], "base": [r.random(300).tobytes(), b""], "score": [r.random(300).tobytes(), r.random(len(keys) - 300).tobytes()]})
    rows = [(p, np.where(r.random(40) < 0.5, r.choice(keys, 40), r.integers(0, 1 << 62, 40, dtype=np.uint64)), np.sort(r.integers(0, 9, 40)).astype(np.uint32)) for p in range(30)] + [(99, np.array([1], np.uint64), np.zeros(1, np.uint32))]
    asked = lambda some: pa.table({"part": [p for p, *_ in some], "keys": [k.tobytes() for _, k, _ in some], "docs": [d.tobytes() for *_, d in some]})
    one_by_one = [x for row in rows for x in lm_score._look(asked([row]), known).to_pylist()]
    assert lm_score._look(asked(rows), known).to_pylist() == one_by_one and len(one_by_one) == 30
    monkeypatch.setattr(lm_score._spans, "__defaults__", (700,))
    assert lm_score._look(asked(rows), known).to_pylist() == one_by_one
    assert lm_score._look(asked([]).cast(pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])), known).num_rows == 0
