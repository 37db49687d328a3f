"""The ten operators against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollex.llm import chat_format, decontaminate, exact_dedup, language_id, lm_score, near_dedup, packing, substring_dedup, toxicity, url_filter
from recollex.llm import queries as Q
from recollex.llm._shared import learned_crc
from tests.llm import brute
from tests.oracle import check

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    assert check(spark, DATA, Q.QUERIES[name], Q.ORACLE_SQL[name])


def _url(url):
    """(host, path, rule, verdict by rule) by hand."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(brute.LOW), rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def test_urls(spark):
    extra = [None, "", "no scheme/en/7", "http://", "HTTP://A.Example.COM/en/7?x", "http://example.net/de/88", "http://xnet/de/", "http://a.net/de/#x", "http://B.org?q=/es/", "a://b://c/d", "http://h/" + "p" * 100_000]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame([(-i, u) for i, u in enumerate(extra, 1)], "page_id long, url string"))
    pages = pages.withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    out = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    assert set(out) == set(urls)
    weights, bias = url_filter.fit()
    for i, u in urls.items():
        host, path, rule, verdict = _url(u)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        x = url_filter._example(host, path)
        s = 1 / (1 + np.exp(-(bias + sum(weights[g] * v for g, v in x.items()))))
        assert abs(r.score - s) < 1e-6 and r.verdict == (verdict or ("block" if s >= 0.5 else "allow"))


#: Hosts and paths that the labelled table doesn't have.
BAD_HOSTS = "casinoworld.com slots-palace.net betting-king.org hot-adult-cams.com cheap-pills.org porntubes.com spamlinkfarm.net payday-loan.com freespins.org click-ad-network.com torrentcrack.net pokerjackpot.com xxx-cams.net adtrackers.com".split()
GOOD_HOSTS = "cityhospital.org bakery.com carpentry.net sailing-club.org chemistry-world.com village-hall.net bookshop.org mountain-rescue.com pianos.net teachers.org botanical.com football-league.net photography.org oldtown.net".split()
BAD_PATHS = "/casino /adult/videos /buy/viagra /free/spins /slots /online-casino/free-spins /poker /click/ads".split()
GOOD_PATHS = "/contact /de/55 /people/staff /shop/cart /videos /library /help/faq /photos/2020 /docs/api".split()


def test_url_model_generalises():
    """Held-out accuracy: at least nine in ten unseen hosts, and unseen paths on a neutral host."""
    table = url_filter.labelled_table()
    weights, bias = url_filter.fit(table)
    blocked = lambda h, p: bias + sum(weights[g] * v for g, v in url_filter._example(h, p).items()) >= 0
    assert not {h for h, _, _ in table} & {*BAD_HOSTS, *GOOD_HOSTS} and not {p for _, p, _ in table} & {*BAD_PATHS, *GOOD_PATHS}
    assert all(blocked(h, "/en/5") for h in ("win-casino.example.net", "pills-cheap.example.org", "www.track-ads.example.com"))
    assert not any(blocked(h, "/en/5") for h in ("m.botany.example.net", "blog.painters.example.org", "university-press.example.com"))
    hosts = [blocked(h, "/en/5") == bad for hosts, bad in ((BAD_HOSTS, True), (GOOD_HOSTS, False)) for h in hosts]
    paths = [blocked("chemistry-world.com", p) == bad for paths, bad in ((BAD_PATHS, True), (GOOD_PATHS, False)) for p in paths]
    assert sum(hosts) >= 0.9 * len(hosts) and sum(paths) >= 0.9 * len(paths)


def test_url_edges(spark):
    """Empty tables, repeated rows, nulls and very long urls."""
    long_url = "http://shop.example.com/" + "a/" * 50_000
    rows = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, long_url), (4, long_url), (None, "http://X.com/en/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "score", "r")})
    out = url_filter.judge_urls(pages).collect()
    assert len(out) == len(rows) and len(set(out)) == 5
    by = {r.page_id: r for r in out}
    assert (by[1].host, by[1].path, by[3].host) == ("", "", "") and len(by[4].path) == 100_001 and by[None].rule == "com/en/" and by[None].verdict == "block"
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_chat_edges(spark):
    """Empty tables, repeated rows, nulls, clashing columns and very long texts."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (None, 1, "assistant", "x" * 200_000), (None, 0, "user", "<turn user>\n\\l</turn>\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("turns", "segments", "formatted", "valid", "t")})
    out = {r.conv_id: r for r in chat_format.format_conversations(turns).withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    want = {1: [("user", "a"), ("user", "a")], 2: [("", "")], None: [("user", "<turn user>\n\\l</turn>\n"), ("assistant", "x" * 200_000)]}
    assert {k: [tuple(t) for t in r.back] for k, r in out.items()} == want
    assert [out[k].valid for k in (1, 2, None)] == [False, False, True]
    assert chat_format.format_conversations(turns.limit(0)).collect() == []


def test_bloom_finds_repeats(spark):
    df = spark.range(5000).select(F.pmod("id", F.lit(4000)).alias("v")).select(F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("h"), "v")
    blocks, bits = exact_dedup.repeat_filter(df, "h", 5000)
    out = exact_dedup.with_maybe(df, "h", blocks, bits).groupBy("maybe").agg(F.count("*").alias("n"), F.count_if(F.col("v") < 1000).alias("again")).collect()
    by = {r.maybe: r for r in out}
    assert by[True].again == 2000 and by[False].again == 0 and by[True].n < 2400


def test_exact_with_full_filters(spark, texts, monkeypatch):
    """Filters far too small for the rows: no row that passes straight through is shuffled, and results stay the same."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 1)
    rows = [(10 * k + i % 7, t) for k in range(30) for i, t in texts] + [(10**6 + i, f"only {i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(last)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(last.values())
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((i, t) for t, i in last.items())
    hashes = docs.select(F.xxhash64("text").alias("h"))
    blocks, bits = exact_dedup.repeat_filter(hashes, "h", len(rows))
    plan = exact_dedup.with_maybe(docs.withColumn("h", F.xxhash64("text")), "h", exact_dedup.staged(blocks, "filter"), bits).where("not maybe")._jdf.queryExecution().executedPlan().toString()
    assert bits == exact_dedup.BLOCK and "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


def test_near(spark, texts):
    w = [f"w{i}" for i in range(60)]
    extra = [(10**6, " ".join(w)), (10**6 + 1, " ".join(w[:55] + ["x"] * 5)), (10**6 + 2, " ".join(w).upper()), (10**6 + 3, "one two"), (10**6 + 4, "ONE  two"), (10**6 + 5, None), (10**6 + 6, " \t\n")]
    rows = texts + extra
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("regs", F.lit(1))).collect()
    want = brute.near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert want[10**6 + 4] == (1, 10**6 + 3)


def test_loose_group(spark):
    """Copies that link to their base but seldom to one another, and chains."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        c = list(base)
        for at in rng.choice(150, rng.integers(1, 9), replace=False):
            c[at] = f"e{k}_{at}"
        rows.append((k, " ".join(c)))
    chain = list(base[:100])
    for k in range(12):
        chain[8 * k] = f"c{k}"
        rows.append((1000 + k, " ".join(x + "q" for x in chain)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute.near(rows)


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    err = []
    for j in (0.7, 0.8, 0.9):
        for n in (50, 800):
            both, own = int(n * 2 * j / (1 + j)), n - int(n * 2 * j / (1 + j))
            h = rng.integers(0, 2**63, both + 2 * own, dtype=np.uint64)
            a, b = h[: both + own], np.concatenate([h[:both], h[both + own :]])
            x, y = near_dedup.registers(a), near_dedup.registers(b)
            e = near_dedup.estimated_similarity(*([v] for v in ((x == y).sum(), (x > y).sum(), (x < y).sum(), len(a), len(b))))[0]
            err.append(e - both / (both + 2 * own))
            assert (near_dedup.registers(h) == np.maximum(x, y)).all()  # sketches merge by maximum
    assert max(map(abs, err)) < 0.12 and abs(np.mean(err)) < 0.04


@pytest.mark.parametrize("block", [512, 8])
def test_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        c = [f"b{i}" for i in range(80)]
        for at in rng.choice(80, 5, replace=False):
            c[at] = f"e{k}"
        rows.append((k, " ".join(c)))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute.near(rows)


def test_substrings(spark):
    p = " ".join(f"p{i}" for i in range(30))
    rows = [(1, p), (2, f"a {p} b"), (3, "z " * 50), (4, p + " tail " + p), (5, None), (6, ""), (7, " ".join(p.split()[:19])), (8, "é " + p.replace(" ", "\n\t") + " ü")]
    out = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == brute.substrings(rows)


def test_substrings_without_filter(spark, texts, monkeypatch):
    """A full filter lets every window move; the result is the same."""
    monkeypatch.setattr(substring_dedup, "MAX_FILTER_BITS", 1 << 16)
    monkeypatch.setattr(substring_dedup, "MIN_FILTER_BITS", 1 << 16)
    rows = texts[:80]
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: v[:2] for i, v in brute.substrings(rows).items()}


def test_leaks(spark):
    items = [(1, "the of"), (2, "a"), (3, ""), (4, None), (5, "one two three four five six seven eight nine ten eleven"), (6, "Four five six SEVEN eight"), (7, "ten"), (7, "ten")]
    docs = [(1, "Of the of, the OF a"), (2, None), (3, "x one two three four five six seven eight nine ten eleven twelve one"), (5, ""), (6, "one-two-three four!five six seven eight nine ten"), (7, "één twee")]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(9)), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute.leaks(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in out} == {i: (n, h, hashlib.sha256(s.encode()).hexdigest()) for i, (n, h, s) in want.items()}
    assert all(r.contaminated == (r.n_hit > 0) for r in out)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    special = [(10**6, "<|endoftext|> <|startoftext|>x <|en"), (10**6 + 1, None), (10**6 + 2, "A\u00a0B \u3000 É\u0301 ΑΣ"), (10**6 + 3, "don't 12 34 \U0001f600\x1c x")]
    rows = texts[:60] + special
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x"))).toPandas()
    tok = Tokenizer.from_file(packing._default_path())
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    least = int(np.ceil(got.length.sum() / 2048))
    assert got.sequence_id.nunique() <= least + 2


def test_packing_ranks_in_ranges(spark, texts, monkeypatch):
    """Ranks of a common length over many groups and ranges of groups: each place is taken once."""
    monkeypatch.setattr(packing, "RANK_GROUP", 3)
    monkeypatch.setattr(packing, "RANGE_GROUPS", 2)
    docs = spark.createDataFrame([(i, f"word {i % 5}") for i in range(3000)] + [(10_000 + i, t) for i, t in texts], "doc_id long, text string")
    rows = packing.pack_documents(docs).select("doc_id", "length", "sequence_id", "offset").collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False)) and min(v)[0] == 0 for v in by.values())


def test_plan_fills():
    rng = np.random.default_rng(1)
    for hist in (np.bincount(rng.integers(1, 2049, 3000), minlength=2049), np.bincount(np.minimum(2048, rng.exponential(400, 20000).astype(int) + 1), minlength=2049), np.bincount([2048] * 50, minlength=2049), np.zeros(2049, int)):
        done = np.zeros(2049, int)
        for n, lengths in (p := packing.plan(hist)):
            assert sum(lengths) <= 2048
            np.add.at(done, list(lengths), n)
        assert (done == hist).all()
        used, least = sum(n for n, _ in p), int(np.ceil((hist * np.arange(2049)).sum() / 2048))
        assert used <= max(sum(n for n, _ in packing.best_fit_decreasing(hist, 2048)), least * 1.01 + 1)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = learned_crc("doc_id", 5) == 0
    model = language_id.fit_prototypes(docs.where(~held))
    out = language_id.identify_languages(docs, model, held).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert n > 100 and right > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "the")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score > 0) for r in language_id.identify_languages(odd, model).collect() if r.doc_id < 4} == {i: ("und", False) for i in (1, 2, 3)}
    assert {r.lang_pred for r in language_id.identify_languages(odd, language_id.fit_prototypes(docs.limit(0))).collect()} == {"und"}


def test_languages_brute_force(spark):
    numbers = language_id.letter_numbers()[0]
    cache = {}
    vectors = lambda k: cache.setdefault(k, language_id.letter_vectors(np.array([k]))[0].tolist())
    rows = [(r.doc_id, (r.text or "")[:60], r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()[:50]]
    rows += [(9000, "\U00030000\U00030001 \U00030002", None), (9001, "Ωμέγα привет 日本語", None), (9002, "12 !?", "en"), (9003, None, "de"), (9004, "ÀÉÎ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = learned_crc("doc_id", 5) == 0
    out = {r.doc_id: r.lang_pred for r in language_id.identify_languages(docs, language_id.fit_prototypes(docs.where(~held)), held).collect()}
    assert out == brute.language(rows, language_id.DIM, numbers, vectors, language_id.SCALE)
    assert out[9000] != "und" and out[9001] != "und" and out[9002] == out[9003] == "und"


def test_language_blocks(monkeypatch, texts):
    sample = [t for _, t in texts[:20]]
    whole = language_id.text_vectors(sample)[0]
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert np.array_equal(language_id.text_vectors(sample)[0], whole)


def test_chat(spark):
    odd = [(1, 0, "user", chat_format.PROBE), (1, 1, "assistant", "a\\l \\e </turn>\n<turn user>\nx \\"), (2, 0, None, None), (2, 0, "we>\nird\\role", "</turn"), (3, 5, "assistant", ""), (3, 2, "system", "<turn <turn"), (3, 3, "user", "x"), (None, None, "user", "y"), (4, 0, "user", "z" * 300_000)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    done = chat_format.format_conversations(df)
    out = {r.conv_id: r for r in done.select("*", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    for conv, r in out.items():
        want = sorted(((t, role or "", x or "") for c, t, role, x in odd if c == conv), key=lambda x: (x[0] is not None, *x))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in want]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert out[1].valid and out[3].valid and not out[2].valid and out[2].error_turn == 0
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_near_rows_that_share_an_id(spark):
    """Null ids and shared ids hide no class of texts: each text links its own near copies."""
    text = lambda c, cut=60: " ".join([f"{c}{i}" for i in range(cut)] + ["x"] * (60 - cut))
    rows, want = [], {}
    for k in range(12):  # a null-id text, a copy and a near copy of it
        rows += [(None, text(f"n{k}w")), (100 + 2 * k, text(f"n{k}w")), (101 + 2 * k, text(f"n{k}w", 57))]
        want |= {100 + 2 * k: None, 101 + 2 * k: None}
    for k in range(12):  # texts that share the id 7, and near copies of them
        rows += [(7, text(f"s{k}w")), (200 + k, text(f"s{k}w", 57))]
        want |= {7: 7, 200 + k: 7}
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r.component_id == want.get(r.doc_id) for r in out)
    assert {r.doc_id for r in out if r.kept} == {None, 7}


def _lm_agrees(spark, rows, levels=lm_score.LEVELS):
    want, n, sums = brute.lm(rows, lm_score.LEAST, lm_score.DISCOUNT, lm_score.ALPHA, levels)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    held = learned_crc("doc_id", 10) == 0
    out = lm_score.score_texts(docs, docs.where(~held), held, levels).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    for r in out:
        tokens, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - base) < 1e-8 * tokens and abs(r.score - score) < 1e-8 * tokens
    return {r.doc_id: r.score for r in out}


LM_EXTRA = [(10**6, None), (10**6 + 1, "never Seen-before wOrds"), (10**6 + 2, "")]


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_lm(spark, texts, levels):
    _lm_agrees(spark, [*texts[:120], *LM_EXTRA], levels)


@pytest.mark.parametrize("levels", [2, 3])
def test_lm_lookups(spark, texts, monkeypatch, levels):
    """With a small hot part nearly all words, pairs and triples are looked up, in many buckets, and none is lost."""
    monkeypatch.setattr(lm_score, "HOT_WORDS", 10)
    monkeypatch.setattr(lm_score, "HOT_ARCS", 10)
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 20_000)
    _lm_agrees(spark, [*texts[:120], *LM_EXTRA], levels)


def test_lm_keeps_pairs_at_every_size(spark, monkeypatch):
    """A pair seen twice counts in a corpus of 3.2 million tokens too; half of all pairs have one history."""
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 100_000)
    ids = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 10][:3]
    _lm_agrees(spark, [(ids[0], "x y " * 1_600_000), (ids[1], "rare pair of"), (ids[2], "rare pair of")])


def test_lm_tells_repeats(spark, texts):
    """A text that occurs twice in training is likelier than one of the same words that occurs once."""
    words = " ".join(t or "" for _, t in texts[:40]).split()
    rng = random.Random(5)
    made = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(30)]
    ids = [i for i in range(2000, 2200) if zlib.crc32(str(i).encode()) % 10]
    rows = [*texts[:40], *[(ids[k], made[k % 30]) for k in range(45)]]
    score = _lm_agrees(spark, rows)
    assert min(score[ids[k]] for k in range(15)) > max(score[ids[k]] for k in range(15, 30))


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_collide_in_powers_of_two(spark):
    """Two words of 1,024 and more bytes whose polynomials are equal modulo 2**64 at any odd base are told apart."""
    rows, ids = [], [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10]
    for k, n in enumerate((1024, 2048, 4096)):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        tail = " ".join(f"t{k}x{j}" for j in range(25))
        rows += [(ids[2 * k], f"{a} {tail}"), (ids[2 * k + 1], f"{b} {tail}")]
    _lm_agrees(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert found == {i: r[1] for i, r in brute.substrings(rows).items()}
    want = brute.near(rows, 4, 97)
    for r in near_dedup.near_duplicates(docs, 4, 97).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    lex = toxicity.Lexicon([("stupid", False), ("moron", False), ("scum", False), ("lowei", True)])
    rng = np.random.default_rng(0)
    for term in ("stupid", "moron", "scum"):
        for _ in range(300):
            w = list(term)
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(0, len(w) + 1))
                [lambda: w.insert(k, "x"), lambda: w.__delitem__(slice(k, k + 1)), lambda: w.__setitem__(slice(k, k + 1), ["z"])][int(rng.integers(0, 3))]()
            s = "".join(w)
            best = min(((_distance(s, t), -len(t), t) for t in ("stupid", "moron", "scum") if _distance(s, t) <= (1 if len(t) >= toxicity.FUZZY else 0)), default=None)
            m = lex._walk(s)
            if s and not (m and m[0] == "lowei"):
                assert (m[1::-1] if m else None) == ((best[0], best[2]) if best else None), s
    assert lex.match("loweischaft")[:2] == ("lowei", 0) and lex.match("lowei") == ("lowei", 1, "lowe") and lex.match("st0pid") is not None and lex.match("") is None


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, toxicity.training_labels(labels), 4000)
    out = toxicity.score_toxicity(docs.repartition(8), model, learned_crc("doc_id", 3) == 1).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.005
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "you stupid worthless idiot, you moron"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit(1))
    r = {x.doc_id: x for x in toxicity.score_toxicity(odd, model).collect()}
    assert r[3].predicted == 1 and r[1].predicted == r[2].predicted == r[4].predicted == 0 and all(0 <= x.score <= 1 for x in r.values())
    assert {x.doc_id for x in toxicity.drop_toxic(odd, model).collect()} == {1, 2, 4}
    # quotation isn't abuse
    quoted, bare, aimed = toxicity._score(['he wrote "idiot" in the report', "that idiot in the report went home again", "you idiot in the report went home again"], model)
    assert quoted < 0.7 and quoted < bare < aimed


def test_toxicity_brute_force():
    """Counts of a text and its score, with every word compared with every term."""
    rng = random.Random(11)
    terms = [("idiot", False), ("scum", False), ("glurb", True), ("mor", True), ("vermin", False)]
    lex = toxicity.Lexicon(terms, frozenset({"idiom"}))
    weights = np.array([1.5, 1.0, 0.7, -1.1, 0.9, 0.4, -2.0])
    base = ["idiot", "idiots", "idiom", "idot", "scum", "scun", "glurbish", "glurb", "glrbface", "more", "mor", "vermin", "vermim", "you", "said", "the", "a", '"', "house", "1d10t", "words"]
    for _ in range(200):
        text = " ".join(rng.choice(base) for _ in range(rng.randrange(0, 30)))
        words = [m.group() for m in toxicity._WORD.finditer(text)]
        hits = brute.toxic_hits(terms, {"idiom"}, {toxicity.plain(w) for w in words}, toxicity.FUZZY)
        found = {w: hits[toxicity.plain(w)] for w in words if toxicity.plain(w) in hits}
        exact = fuzzy = aimed = quoted = 0
        spans = [(m.start(), m.end()) for m in toxicity._WORD.finditer(text)]
        for k, w in enumerate(words):
            if w in found:
                errors = found[w][1]
                exact, fuzzy = exact + (not errors), fuzzy + errors
                lo, hi = max(0, k - toxicity.WINDOW), min(len(words) - 1, k + toxicity.WINDOW)
                around = set(words[lo:k] + words[k + 1 : hi + 1])
                marks = ('"' in text[spans[lo][0] : spans[k][0]]) and ('"' in text[spans[k][1] : spans[hi][1]])
                if marks or around & toxicity.REPORTING:
                    quoted += 1
                elif around & toxicity.ADDRESS:
                    aimed += 1
        n, kinds = exact + fuzzy, len({t for t, _ in found.values()})
        want = np.zeros(6) if not n else np.array([np.log1p(exact), np.log1p(fuzzy), np.log1p(aimed), np.log1p(quoted), np.log1p(kinds), min(1.0, 20 * n / len(words))])
        got, count = toxicity.features(lex, text)
        assert count == n and np.allclose(got, want), text
        assert abs(toxicity._score([text], (lex, weights))[0] - 1 / (1 + np.exp(-(want @ weights[:-1] + weights[-1])))) < 1e-12


def test_mining_brute_force():
    """Documents and contexts of every term, counted plainly."""
    texts = ["red hen runs", "a red hen sits", "red", "hens red hen"]
    out = {(r["term"], r["stem"]): (r["n"], len(r["contexts"])) for b in toxicity._count_terms(None)([pa.record_batch([pa.array(texts)], ["text"])]) for r in b.to_pylist()}
    docs, contexts = {}, {}
    for i, t in enumerate(texts):
        w = t.split()
        for k, x in enumerate(w):
            for term in [(x, False), *((x[:j], True) for j in toxicity.STEMS if j < len(x))]:
                docs.setdefault(term, set()).add(i)
                contexts.setdefault(term, set()).add((w[k - 1] if k else "", w[k + 1] if k + 1 < len(w) else ""))
    assert out == {t: (len(d), len(contexts[t])) for t, d in docs.items()}


def test_context_windows():
    lex = toxicity.Lexicon([("idiot", False)])
    quoted, _ = toxicity.features(lex, 'he wrote "idiot" in the report')
    aimed, _ = toxicity.features(lex, "you are an idiot")
    assert quoted[3] > 0 == quoted[2] and aimed[2] > 0 == aimed[3]


def test_unlearnt_quotation_takes_hits_back():
    w = np.array([2.0, 1.0, 1.0, 0.0, 1.5, 4.0, -5.0])
    x = np.zeros((3, 6))
    assert toxicity.discounted(w, x).tolist() == [2.0, 1.0, 1.0, -3.5, 1.5, 4.0, -5.0] and w[3] == 0
    x[1, 3] = 0.7  # learnt: as it is
    assert toxicity.discounted(w, x) is w


def test_copies_do_not_hide_a_term(spark):
    """A term of 20 different toxic texts is found though one more text with it has 40 copies."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    text = lambda term: " ".join([*(word() for _ in range(5)), *term, *(word() for _ in range(5))])
    toxic = [text(["glurbface"]) for _ in range(20)] + [text(["glurbface"])] * 40
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + [text([]) for _ in range(200)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon, _ = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert lexicon.match("glurbface") is not None


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot idiot moron scum"), (2, "fine")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {1: 1, 2: 0}
