"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every run of W neighbouring K-word grams the least hash is kept. Documents and items that share WINDOW = K + W - 1
words share at least one kept hash, so the join of the kept hashes misses no shared window. Hits are extended: the
windows around a shared gram are compared word by word with the items' windows. Items of fewer words than a window are
one window each; for the lengths that occur, every gram of that length is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.llm._shared import ascii_lower, keyed, same_row, small, staged, text_or_empty

WINDOW, K = 10, 5
#: Letters, digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The ASCII characters between words, once A-Z are lower-cased.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])).translate({c: None for c in range(0x41, 0x5B)})
#: Buckets that a document's fingerprints are dealt to at most, for lookups.
BUCKETS = 1024


def words_of(text: Column) -> Column:
    """The words (WORD), A-Z lower-cased. What is between words becomes blanks and the text is split at these: a tenth of
    the time of a regular expression's matches."""
    return F.filter(F.split(F.translate(ascii_lower(text), BETWEEN, " " * len(BETWEEN)), " "), lambda w: w != "")


def _dealt(values: Column) -> Column:
    """The values by their rest modulo the number of buckets, about four in each."""
    n = F.least(F.lit(BUCKETS), F.shiftright(F.size(values), 2) + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(values, lambda v: F.pmod(v, n) == b))


def _among(value: Column, dealt: Column) -> Column:
    return F.array_contains(F.get(dealt, F.pmod(value, F.size(dealt)).cast("int")), value)


def _places(array: Column, k: int) -> Column:
    """0-based starts of the runs of k elements."""
    return F.when(F.size(array) >= k, F.sequence(F.lit(0), F.size(array) - k)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, k: int) -> Column:
    return F.transform(_places(hashes, k), lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def _winnowed(grams: Column, w: int) -> Column:
    if w == 1:
        return grams
    return F.transform(_places(grams, w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)]))


def _with_fingerprints(rows: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """rows (with words) and fps_<n>: the kept hashes, window for windows and n for short items of n words. Every step
    is a column of its own, used more than once by the next, so that it is computed once a row."""
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns({f"grams_{n}": _grams(F.col("hashes"), k if n == window else n) for n in [window, *short]})
    return rows.withColumns({f"fps_{n}": F.array_distinct(_winnowed(F.col(f"grams_{n}"), window - k + 1 if n == window else 1)) for n in [window, *short]})


def _windows(words: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("window")))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, window): the windows of each item, words joined by a space; an item without words has none."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(text_or_empty(items)).alias("words")).where(F.size("words") > 0)
    full = w.where(F.size("words") >= window).select("item_id", F.explode(_windows(F.col("words"), _places(F.col("words"), window), window)).alias("x")).select("item_id", "x.n", "x.window")
    return full.unionByName(w.where(F.size("words") < window).select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("window"))).distinct()


def overlap_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, row_key, start, n, window) of every place in keyed docs where a window of an item occurs."""
    targets = staged(item_windows(items, window), "windows")
    short = sorted(r[0] for r in targets.where(F.col("n") < window).select("n").distinct().collect())  # window - 1 numbers at most
    iw = _with_fingerprints(items.select(words_of(text_or_empty(items)).alias("words")), window, k, short)
    kept = F.when(F.size("words") >= window, F.col(f"fps_{window}"))
    for n in short:
        kept = kept.when(F.size("words") == n, F.col(f"fps_{n}"))
    marks = staged(iw.select(F.explode(kept).alias("fp")).distinct(), "fingerprints")

    every = _with_fingerprints(docs.select("doc_id", "row_key", words_of(F.col("text")).alias("words")), window, k, short)
    fps = every.select("doc_id", "row_key", F.explode(F.concat(*[F.col(f"fps_{n}") for n in [window, *short]])).alias("fp"))
    met = fps.join(small(marks, marks.count()), "fp", "left_semi").groupBy("doc_id", "row_key").agg(F.collect_set("fp").alias("fps"))
    met = staged(met, "met")

    near = small(met, met.agg(F.coalesce(F.sum(F.size("fps") + 2), F.lit(0))).head()[0])
    cand = docs.join(near, same_row(docs, near)).select(docs["doc_id"], docs["row_key"], words_of(docs["text"]).alias("words"), near["fps"])
    cand = cand.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "dealt": _dealt(F.col("fps"))})
    cand = cand.withColumns({f"grams_{n}": _grams(F.col("hashes"), k if n == window else n) for n in [window, *short]})
    found = F.array().cast("array<struct<start:int,n:int,window:string>>")
    for n in [window, *short]:
        grams = F.col(f"grams_{n}")
        own = F.filter(_places(grams, 1), lambda i: _among(F.get(grams, i), F.col("dealt")))
        cand = cand.withColumn(f"at_{n}", own)
        if n == window:
            spans = F.transform(F.col(f"at_{n}"), lambda i: F.sequence(F.greatest(F.lit(0), i - (window - k)), F.least(i, F.size("words") - window)))
            around = F.when((F.size("words") >= window) & (F.size(f"at_{n}") > 0), F.array_distinct(F.flatten(spans))).otherwise(F.array().cast("array<int>"))
        else:
            around = F.col(f"at_{n}")
        cand = cand.withColumn(f"near_{n}", around)
        found = F.concat(found, _windows(F.col("words"), F.col(f"near_{n}"), n))
    tried = cand.select("doc_id", "row_key", F.explode(found).alias("x")).select("doc_id", "row_key", "x.start", "x.n", "x.window")
    known = targets.select("window").distinct()
    return tried.join(small(known, targets.count()), "window", "left_semi").select("doc_id", "row_key", "start", "n", "window")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text).

    A word is hit if it lies in an occurrence of an item's window; n_items counts the items with an occurring window.
    Null and empty texts have no words; documents shorter than a window can only meet short items; rows that repeat
    doc_id and text get equal results; repeated items count once per item_id; extra columns are ignored; empty tables
    give no hits or no rows.
    """
    return _summed(keyed(docs), items, window, k)


def _summed(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    hits = staged(overlap_hits(docs, items, window, k).distinct(), "hits")
    spans = hits.select("doc_id", "row_key", "start", "n").distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    owners = item_windows(items, window).select("item_id", "window")
    met = hits.select("doc_id", "row_key", "window").distinct()
    named = met.join(small(owners, owners.count()), "window").select("doc_id", "row_key", "item_id").distinct().groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    s = spans.select("doc_id", "row_key", covered.cast("long").alias("n_hit"))
    found = staged(s.join(named, same_row(s, named)).select(s["doc_id"], s["row_key"], "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "found")
    found = small(found, found.count())
    joined = docs.join(found, same_row(docs, found), "left")
    return joined.select(
        docs["doc_id"],
        F.size(words_of(docs["text"])).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


#: SHA-256 of the empty string.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of docs without a hit, with all their columns: null and empty texts stay, repeated rows stay or go
    together, and so do rows that share only a doc_id each by its own text."""
    hits = staged(overlap_hits(keyed(docs), items, window, k).select("doc_id", "row_key").distinct(), "contaminated")
    hits = small(hits, hits.count())
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["doc_id"]) & (F.xxhash64(text_or_empty(docs)) == hits["row_key"]), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
