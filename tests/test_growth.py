"""Steps whose work has to grow with the input alone: their plans, and their results against plain ones."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from recollex import consts as K
from recollex.functions import pii, text
from recollex.operators import automaton, blockindex, index, kg, retrieval


def _plan(df, which: str = "optimizedPlan") -> str:
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_connectivity_lists_no_neighbours(spark):
    r = random.Random(1)
    sets = {i: set(r.choices("abcdefghij", [9, 9, 5, 3, 2, 1, 1, 1, 1, 1], k=r.randint(1, 9))) for i in range(200)} | {900: {"alone"}}
    rows = spark.createDataFrame([(i, e) for i, s in sets.items() for e in sorted(s)] + [(None, "a"), (7, None)], "memory_id long, entity string")
    found = retrieval.connectivity(rows)
    n = {i: sum(1 for j in sets if j != i and sets[i] & sets[j]) for i in sets}
    assert {(x.memory_id, x.neighbours) for x in found.collect()} == {(i, k) for i, k in n.items() if k}
    assert not re.search(r"NOT \(memory_id#\d+L = memory_id#\d+L\)", _plan(found))  # memories don't meet one by one


def test_sentiment_looks_for_negations_only_in_cjk_texts(spark):
    r = random.Random(2)
    parts = [*K.POSITIVE, *K.NEGATIVE, "不", "没", "别", "不要", "不用", " ", "\n", "x", "unlike", ""]
    texts = ["".join(r.choices(parts, k=r.randint(0, 9))) for _ in range(400)] + ["good", "bad good", "", None]

    def plain(t):
        if t is None:
            return "neutral"
        pos = neg = 0
        for w in K.POSITIVE:
            negated = re.search(f"({K.NEGATION})[ \\t\\n\\r\\f\\v]*{w}", t)
            neg += 2 if negated else 0
            pos += not negated and w in t
        neg += sum(w in t for w in K.NEGATIVE)
        return "positive" if pos > neg else "negative" if neg > pos else "neutral"

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.sentiment(F.col("t")).alias("mood"))
    assert dict(map(tuple, df.collect())) == {i: plain(t) for i, t in enumerate(texts)}
    assert re.search(r"RLIKE\(t#\d+, ([^)]{1,12})", _plan(df)).group(1).startswith("[\\x{4e00}")


def test_redaction_rewrites_only_what_a_rule_matches(spark):
    r = random.Random(3)
    parts = ["1", "12", "139", "0", "021", "1234", "5500005555555559", "78", " ", "-", ".", "+", "(", ")", "@", "a", "x", "X", "no.ra@posts.example", "sk-", "AKID", "ghp_0123456789zyxwvuts", "–", "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + ["", None]
    df = pii.with_redaction(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    both = df.select("i", "t", "redacted", "redacted_types", pii.redact(F.col("t")).alias("plain")).collect()
    assert [x.redacted for x in both] == [x.plain for x in both]
    steps = [F.struct(F.col("t").rlike(pii.RULES[0][0]).alias("0"))]  # each rule's label where it matches what those before left
    c = F.col("t")
    for i in range(1, len(pii.RULES)):
        c = pii._rewrite(c, i - 1)
        steps.append(F.struct(c.rlike(pii.RULES[i][0]).alias("0")))
    hits = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(F.array(*steps).alias("h")).collect()
    want = [list(dict.fromkeys(pii.RULES[i][2] for i, x in enumerate(h.h) if x[0])) for h in hits]
    assert [x.redacted_types for x in both] == want
    assert "contains" in _plan(df).lower().split("regexp_replace")[0]  # what all rules need is asked first


def test_postings_move_once(spark):
    texts = ["b a b", "", None, "a", "ÄB 上海 b上", "b " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "memory_id long, summary string")
    p = index.postings(df)
    want = {(t, i, w.count(t), len(w)) for i, s in enumerate(texts) for w in [re.findall("[一-鿿]|[a-z0-9]+", (s or "").lower())] for t in w}
    assert {tuple(x) for x in p.collect()} == want and p.count() == len(want)
    assert "Exchange" not in _plan(p, "executedPlan")
    assert _plan(blockindex._blocks(p, 2), "executedPlan").count("Exchange") == 1


def test_triples_are_searched_where_the_words_between_are(spark):
    r = random.Random(4)
    parts = ["is", "Is", "a", "an", "works", "at", "for", "uses", "likes", "created", "lives in", "is based in", "own", "manages", "knows", "the", "Bob", "x", "a" * 25, "this", "é", "李娜喜欢绿茶。", "\t", "."]
    texts = [" ".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(1500)] + ["", "x" * 30 + " is an " + "y" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = F.flatten(F.array(*[F.transform(F.arrays_zip(text.find_all(F.col("text"), "(?i)" + p, 1).alias("s"), text.find_all(F.col("text"), "(?i)" + p, 2).alias("t")), kg._triple(i, rel)) for i, (p, rel) in enumerate(K.TRIPLE_PATTERNS)]))
    keep = lambda x: ~F.lower(x["source"]).isin(*K.TRIPLE_SKIP) & ~F.lower(x["target"]).isin(*K.TRIPLE_SKIP)
    want = df.select("id", F.explode(F.filter(plain, keep)).alias("x")).select("id", "x.*").collect()
    found = kg.extract_triples(df)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) > 500
    assert "\\sis\\s+(?:a|an)\\s+)" in _plan(found).replace("(?i)", "")


def test_phrases_are_found_in_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(automaton, "SLAB", 40)
    b = pa.array(["x" * 30, None, "y" * 100, "", "z"])
    assert [p.to_pylist() for p in automaton._parts(b)] == [["x" * 30, None], ["y" * 100], ["", "z"]] and [len(p) for p in automaton._parts(b[:0])] == [0]
    df = spark.createDataFrame([("he said she",), (None,), ("上海",), ("",)], "t string").coalesce(1)
    found = df.select(automaton.held_phrases(F.col("t"), [(3, "she"), (1, "he"), (5, "海")]).alias("p")).collect()
    assert [x.p for x in found] == [[1, 3], [], [5], []]
