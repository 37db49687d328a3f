"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollex.llm import bpe, decontaminate, exact_dedup, language_id, lm_score, near_dedup, packing, periodic_runs, substring_dedup, toxicity
from tests.llm import brute

ROWS = [(1, "a b c d e"), (2, None), (3, ""), (None, "x y"), (None, None), (5, "dup dup"), (5, "dup dup"), (5, "other text"), (6, "long " * 40_000), (7, "a b c d e"), (8, "\u00e9\u0301 \U0001f600")]
CLASH = "kept score n n_words row_key gaps rid h fp fps text_sha256 keep_id rep lab regs held_out length salt maybe sha __row ids decoded runs collapsed".split()

OPERATORS = {
    "exact": lambda d: exact_dedup.exact_duplicates(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "substring": lambda d: substring_dedup.remove_repeats(d),
    "leaks": lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "packing": lambda d: packing.pack_documents(d),
    "language": lambda d: language_id.identify_languages(d, language_id.fit_prototypes(d.withColumn("lang", F.lit("en")))),
    "lm": lambda d: lm_score.score_texts(d, d.where("doc_id > 2")),
    "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d)),
    "runs": lambda d: periodic_runs.periodic_runs(d),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.fit(d, d.select("doc_id", F.lit(0).alias("toxic")))),
}
FILTERS = {
    "exact": exact_dedup.drop_exact_duplicates,
    "near": near_dedup.drop_near_duplicates,
    "leaks": lambda d: decontaminate.drop_contaminated(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")),
    "toxicity": lambda d: toxicity.drop_toxic(d, (toxicity.Lexicon([("dup", False)]), toxicity.np.array([9.0, 0, 0, 0, 0, 0, -1]))),
}


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASH})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows(spark, name):
    out = OPERATORS[name](table(spark)).collect()
    ids = sorted(str(r.doc_id) for r in out)
    if name == "packing":
        assert set(ids) == {str(i) for i, _ in ROWS} and sum(r.piece == 0 for r in out) == len(ROWS)
    else:
        assert ids == sorted(str(i) for i, _ in ROWS)


def _by_id(rows, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in rows), key=str)


def test_values(spark):
    """What the rows above get, in rows' order by id."""
    run = lambda name, *columns: _by_id(OPERATORS[name](table(spark)).collect(), *columns)
    want = {(1, 2): 1, (2, 0): 2, (3, 0): 3, (None, 1): None, (None, 0): None, (5, 1): 5, (6, 1): 6, (7, 2): 1, (8, 1): 8}
    near = run("near", "n_shingles", "component_id", "kept")
    assert len(near) == len(ROWS) and all(want[i, n] == c and kept == (i == c) for i, n, c, kept in near)
    leaks = {(i, n): (hit, bad) for i, n, hit, bad in run("leaks", "n_words", "n_hit", "contaminated")}
    assert leaks == {(1, 5): (5, True), (2, 0): (0, False), (3, 0): (0, False), (None, 2): (2, True), (None, 0): (0, False), (5, 2): (2, True), (6, 40_000): (40_000, True), (7, 5): (5, True), (8, 2): (2, True)}
    letters = {i for i, t in ROWS if t and any(c.isalpha() for c in t)}
    assert all(lang == ("en" if i in letters and (i is not None or s > 0) else "und") for i, lang, s in run("language", "lang_pred", "score"))
    tokens = sorted(((i, len(brute.words(t)) + 1) for i, t in ROWS), key=str)
    lm = run("lm", "n_tokens", "base_score", "score")
    assert [r[:2] for r in lm] == tokens and len({r for r in lm if r[0] == 5}) == 2 and all(r[2] < 0 and r[3] < 0 for r in lm)
    assert all(p == 0 and 0 <= s <= 1 for _, p, s in run("toxicity", "predicted", "score"))
    assert [(i, n, t) for i, n, t in run("runs", "n_words", "collapsed")] == sorted(((i, len(brute.words(t)), "long" if i == 6 else " ".join(brute.words(t))) for i, t in ROWS), key=str)
    assert all(len(ids) == len(t.split()) and (i is None or i in (2, 3) or ids) for i, ids, t in run("bpe", "ids", "decoded"))
    cut = {(i, t): n for i, t, n in run("substring", "kept_text", "n_removed")}
    assert cut[6, "long"] == 39_999 and all(n == 0 for (i, _), n in cut.items() if i != 6)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty(spark, name):
    assert OPERATORS[name](table(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(spark, name):
    d = table(spark)
    out = FILTERS[name](d)
    assert out.columns == d.columns and FILTERS[name](table(spark, [])).count() == 0
    n = out.count()
    assert n == {"exact": 7, "near": 10, "leaks": len(ROWS), "toxicity": len(ROWS) - 2}[name]


def test_exact_ties(spark):
    out = exact_dedup.exact_duplicates(table(spark)).collect()
    pick = lambda t: [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in sorted(out, key=lambda r: (str(r.doc_id), r.kept)) if r.text_sha256 == t]
    sha = lambda s: __import__("hashlib").sha256(s.encode()).hexdigest()
    assert pick(sha("a b c d e")) == [(1, 7, 2, False), (7, 7, 2, True)]
    assert pick(sha("dup dup")) == [(5, 5, 2, False), (5, 5, 2, True)]
    assert pick(sha("")) == [(2, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False)]


def test_pipeline(spark, tmp_path):
    """Each stage on its own input, against brute force."""
    data = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{data}/documents.parquet"), {}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= set(before)
        if name == "toxicity":
            marked = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in before}
            assert not [i for i in set(before) - kept[name] if marked.get(i) == 0]
            assert len([i for i in kept[name] if marked.get(i) == 1]) <= 0.4 * sum(marked.values())
        elif name == "exact_dedup":
            last = {t: max(i for i in before if before[i] == t) for t in before.values()}
            assert kept[name] == set(last.values())
        elif name == "near_dedup":
            assert kept[name] == {i for i, (_, c) in brute.near(before.items(), 5).items() if i == c}
        else:
            assert kept[name] == {i for i, (_, hit, _) in brute.leaks(before.items(), items).items() if not hit}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    assert set(packed.doc_id) == kept["decontamination"] and (packed.groupby("sequence_id").length.sum() <= 2048).all()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_edges(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages, and empty tables."""
    table(spark, [] if empty else ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([] if empty else [(5, 0), (6, 0), (1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, "x y"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", *CLASH]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = lambda rows: sorted({str(r.doc_id) for r in rows})
    assert ids(packed) == ids(docs.collect()) == ([] if empty else sorted(map(str, (3, 5, 6, 7, 8))))
