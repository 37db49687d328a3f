"""Gate, PII and ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.functions import pii, text
from recollex.operators import gate as G
from recollex.operators import index as I
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.rules import built_in_rules
from recollex.tables import MEMORIES_SQL, memories, quoted, table, texts, texts_sql

QUERIES, ORACLE_SQL, query = register()


def _labels_sql(c: str) -> str:
    """Labels in the order of their first matching rule, joined."""
    parts = []
    for i, (p, regex, label) in enumerate(built_in_rules()):
        hit = f"regexp_matches(l, {quoted(p)})" if regex else f"contains(l, {quoted(p)})"
        parts.append(f"CASE WHEN {hit} THEN {{'at': {i}, 'label': {quoted(label)}}} END")
    return f"(SELECT list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) FROM (SELECT lower({c}) AS l))"


_FIRST = "array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(list_transform(x, lambda y: y.label), x[i].label) = i), lambda i: x[i].label), '|')"


@query("injection_scan_labels", f"WITH {texts_sql('documents')}, m AS (SELECT src, id, {_labels_sql('text')} AS x FROM texts) SELECT src, id, {_FIRST} AS labels FROM m WHERE len(x) > 0")
def injection_scan_labels(spark, sf_dir):
    t = G.quarantine(texts(spark, sf_dir, "documents"))
    return t.select("src", "id", F.array_join("labels", "|").alias("labels"))


_B, _E = "(^|[^0-9])", "($|[^0-9])"
#: The rules without lookaround: a neighbour that is no digit, or an end of the text, is matched and put back. A rewrite
#: is made twice, since a neighbour that one match took hides the next match.
_SCAN = (
    (rf"{_B}(1[3-9]\d)\s?[-–—]?\s?\d{{4}}\s?[-–—]?\s?(\d{{4}}){_E}", r"\1\2****\3\4", "phone_cn"),
    (rf"{_B}(\d{{4}})\d{{10}}(\d{{4}}){_E}", r"\1\2**********\3\4", "id_card_cn"),
    (rf"{_B}(\d{{4}})\d{{9}}(\d{{4}}[\dXx]){_E}", r"\1\2*********\3\4", "id_card_cn"),
    (rf"{_B}(\d{{4}})\d{{8,11}}(\d{{4}}){_E}", r"\1\2***********\3\4", "bank_card_cn"),
    (rf"{_B}(0\d{{2,3}})[-–—\s]?(\d{{4}})\d{{4}}{_E}", r"\1\2-\3****\4", "landline_cn"),
    (r"([\w.+-])[\w.+-]*@([\w-]+\.[\w.]+)", r"\1***@\2", "email"),
    (rf"{_B}(\+\d{{1,3}})[-.\s]?\d{{2,4}}[-.\s]?\d{{2,4}}[-.\s]?\d{{3,10}}{_E}", r"\1\2-***-\3", "phone_intl"),
    (r"\(\d{3}\)\s?\d{3}[-.\s]?(\d{4})", r"(***) ***-\1", "phone_intl"),
    (rf"{_B}(\d{{4}})[-–—\s]?(\d{{4}})[-–—\s]?(\d{{4}})[-–—\s]?(\d)\d{{3}}{_E}", r"\1\2-\3-\4-\5***\6", "credit_card"),
    (rf"{_B}(\d{{1,3}})\.(\d{{1,3}})\.\d{{1,3}}\.\d{{1,3}}{_E}", r"\1\2.\3.***.***\4", "ip_address"),
    (rf"{_B}\d{{3}}[-–—]\d{{2}}[-–—](\d{{4}}){_E}", r"\1***-**-\2\3", "ssn"),
    (r"(^|[^a-zA-Z0-9])(?:sk-|ark-|AKID|AKTP|ghp_|gho_|ghu_)[a-zA-Z0-9_-]{16,}($|[^a-zA-Z0-9_-])", r"\1\2", "api_key"),
)


def _scan_sql() -> str:
    """CTEs s0 to s12 with the text (c and e for the two lists) and the labels so far."""
    out = ["s0 AS (SELECT src, id, text AS c, text AS e, CAST([] AS VARCHAR[]) AS x FROM texts)"]
    for i, (p, to, label) in enumerate(_SCAN):
        t, other = ("c", "e") if i < 5 else ("e", "c")
        again = f"regexp_replace({t}, {quoted(p)}, {quoted(to)}, 'g')"
        if label != "email":
            again = f"regexp_replace({again}, {quoted(p)}, {quoted(to)}, 'g')"
        out.append(f"s{i + 1} AS (SELECT src, id, {other}, {again} AS {t}, CASE WHEN regexp_matches({t}, {quoted(p)}) AND NOT list_contains(x, '{label}') THEN list_append(x, '{label}') ELSE x END AS x FROM s{i})")
    return ", ".join(out)


@query("pii_scan_types", f"WITH {texts_sql('documents', 'pages')}, {_scan_sql()} SELECT src, id, array_to_string(x, '|') AS types FROM s{len(_SCAN)} WHERE len(x) > 0")
def pii_scan_types(spark, sf_dir):
    t = pii.with_scan(texts(spark, sf_dir, "documents", "pages"))
    return t.where(F.size("types") > 0).select("src", "id", F.array_join("types", "|").alias("types"))


_ID = rf"{_B}(\d{{4}})\d{{9}}(\d{{4}})"
_MAIL = r"([\w-]+\.[\w.]+)"
_KEY = "[a-zA-Z0-9_-]"
#: The rewrites of redaction without lookaround, by the rule's place: each as often as listed.
_REDACT = {
    2: [(_ID + rf"[xX]{_E}", r"\1\2*********\3X\4"), (rf"{_B}(\d{{4}})\d{{9}}(\d{{5}}){_E}", r"\1\2*********\3\4")],
    5: [(rf"(^|[^\w.+-])[\w.+-]@{_MAIL}", r"\1*@\2"), (rf"([\w.+-])[\w.+-]+@{_MAIL}", r"\1***@\2")],
    6: [(rf"{_B}(\+\d{{1,3}})[-.\s]?\d{{2,4}}[-.\s]?\d{{2,4}}(?:[-.\s]?\d{{0,6}}?)(\d{{4}}|[-.\s]\d{{3}}){_E}", r"\1\2-***-\3\4")],
    9: [(rf"{_B}(25[0-5]|2[0-4]\d|1\d\d|0?\d?\d)\.(\d{{1,3}})\.\d{{1,3}}\.\d{{1,3}}{_E}", r"\1\2.\3.***.***\4")],
    11: [(rf"(^|[^a-zA-Z0-9])(sk-{_KEY}|ark-|AKID|AKTP|ghp_|gho_|ghu_){_KEY}{{11,}}({_KEY}{{4}})($|[^a-zA-Z0-9_-])", r"\1\2***\3\4")],
}


def _redact_sql(source: str) -> str:
    """CTEs r0 to r12 over source (its columns and text): the text so far as c and the labels so far as x."""
    out = [f"r0 AS (SELECT *, text AS c, CAST([] AS VARCHAR[]) AS x FROM {source})"]
    for i, (p, to, label) in enumerate(_SCAN):
        c = "c"
        for pattern, new in _REDACT.get(i, [(p, to)]):
            for _ in range(2):
                c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(new)}, 'g')"
        out.append(f"r{i + 1} AS (SELECT * EXCLUDE (c, x), {c} AS c, CASE WHEN regexp_matches(c, {quoted(p)}) AND NOT list_contains(x, '{label}') THEN list_append(x, '{label}') ELSE x END AS x FROM r{i})")
    return ", ".join(out)


@query("pii_redact", f"WITH {texts_sql('documents', 'pages')}, {_redact_sql('texts')} SELECT src, id, c AS redacted, array_to_string(x, '|') AS types FROM r{len(_SCAN)} WHERE c <> text")
def pii_redact(spark, sf_dir):
    """Texts that redaction changes."""
    t = pii.with_redaction(texts(spark, sf_dir, "documents", "pages"))
    return t.where("redacted <> text").select("src", "id", "redacted", F.array_join("redacted_types", "|").alias("types"))


@query("md5_dedup", "SELECT substr(md5(text), 1, 16) AS content_hash, min(doc_id) AS memory_id, count(*) AS copies FROM documents GROUP BY 1")
def md5_dedup(spark, sf_dir):
    m = memories(spark, sf_dir).select("memory_id", text.content_hash(F.col("text")).alias("content_hash"))
    return m.groupBy("content_hash").agg(F.min("memory_id").alias("memory_id"), F.count("*").alias("copies"))


@query("ingest_anti_join", f"WITH {MEMORIES_SQL}, h AS (SELECT memory_id, scene, substr(md5(text), 1, 16) AS h FROM memories) SELECT min(memory_id) AS memory_id, h AS content_hash FROM h WHERE scene = 'en' AND h NOT IN (SELECT h FROM h WHERE scene <> 'en') GROUP BY h")
def ingest_anti_join(spark, sf_dir):
    """English rows arrive, the others are there: what is new, once per hash."""
    h = memories(spark, sf_dir).select("memory_id", "scene", text.content_hash(F.col("text")).alias("content_hash"))
    known = h.where("scene <> 'en'").select("content_hash").distinct()
    return h.where("scene = 'en'").join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("memory_id").alias("memory_id"))


_INGEST = f"""WITH {MEMORIES_SQL}, {texts_sql()}, n AS (SELECT memory_id, ts, source, text FROM memories UNION ALL SELECT id, TIMESTAMP '2024-01-01', 'user', text FROM texts),
l AS (SELECT *, {_labels_sql('text')} AS found FROM n), g AS (SELECT memory_id, ts, source, text FROM l WHERE len(found) = 0), {_redact_sql('g')},
h AS (SELECT memory_id, ts, source, c, substr(md5(c), 1, 16) AS content_hash FROM r{len(_SCAN)}), k AS (SELECT substr(md5(text), 1, 16) AS h FROM memories WHERE scene = 'de'),
o AS (SELECT content_hash, min(memory_id) AS memory_id FROM h GROUP BY 1)
SELECT content_hash, memory_id, ts, source, substr(c, 1, 500) AS summary, {S.joined(S.entities('c'))} AS entities FROM o JOIN h USING (content_hash, memory_id) WHERE content_hash NOT IN (SELECT h FROM k)"""


@query("ingest_pipeline", _INGEST)
def ingest_pipeline(spark, sf_dir):
    """The gate, redaction, hashes, what is known and entities: new memories as they would be stored."""
    new = memories(spark, sf_dir).select("memory_id", "ts", "source", "text")
    fixed = texts(spark, sf_dir).select(F.col("id").alias("memory_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("user").alias("source"), "text")
    known = memories(spark, sf_dir).where("scene = 'de'").select(text.content_hash(F.col("text")).alias("content_hash"))
    return G.ingest(new.unionByName(fixed), known).withColumn("entities", F.array_join(F.array_sort("entities"), "|"))


@query("ingest_effects", _INGEST.replace("SELECT content_hash, memory_id, ts, source, substr(c, 1, 500) AS summary", "SELECT 'memory' AS kind, content_hash AS key, CAST(memory_id AS VARCHAR) AS value FROM o WHERE content_hash NOT IN (SELECT h FROM k) UNION ALL SELECT 'posting', term, CAST(count(*) AS VARCHAR) FROM (SELECT unnest(list_distinct(" + S.tokens("substr(c, 1, 500)") + ")) AS term FROM o JOIN h USING (content_hash, memory_id) WHERE content_hash NOT IN (SELECT h FROM k)) GROUP BY term --"))
def ingest_effects(spark, sf_dir):
    """What an ingest adds to the store: memories, and postings (terms with their numbers of memories) of the index."""
    rows = ingest_pipeline(spark, sf_dir)
    memory = rows.select(F.lit("memory").alias("kind"), F.col("content_hash").alias("key"), F.col("memory_id").cast("string").alias("value"))
    index = I.postings(rows).groupBy("term").agg(F.count("*").cast("string").alias("value"))
    return memory.unionByName(index.select(F.lit("posting").alias("kind"), F.col("term").alias("key"), "value"))


@query("benchmark_contains_join", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def benchmark_contains_join(spark, sf_dir):
    """Documents that hold an item's whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    return G.containing(d, table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("passage")))


@query("truncation_projection", f"WITH {MEMORIES_SQL} SELECT memory_id, length(summary) AS n500, length(substr(summary, 1, 80)) AS n80, md5(substr(summary, 1, 60)) AS m60, coalesce(nullif(trim(substr(summary, 1, 1)), ''), substr(text, 1, 10)) AS fallback FROM memories")
def truncation_projection(spark, sf_dir):
    m = memories(spark, sf_dir)
    cut = lambda n: F.substring("summary", 1, n)
    return m.select("memory_id", F.length("summary").cast("long").alias("n500"), F.length(cut(80)).cast("long").alias("n80"), F.md5(cut(60).cast("binary")).alias("m60"), F.coalesce(F.nullif(F.trim(cut(1)), F.lit("")), F.substring("text", 1, 10)).alias("fallback"))


_PARTS = "list_transform(string_split(ltrim({0}, 'v'), '.'), lambda x: CAST(x AS INTEGER))"
_VERSIONS = "SELECT o_orderkey, 'v' || CAST(o_orderkey % 3 AS VARCHAR) || '.' || CAST(o_custkey % 20 AS VARCHAR) || '.' || CAST(day(o_orderdate) AS VARCHAR) AS v, CAST(o_custkey % 3 AS VARCHAR) || '.' || CAST(o_orderkey % 20 AS VARCHAR) AS w FROM orders"


@query("version_compare", f"SELECT o_orderkey, v, w, {_PARTS.format('v')} < {_PARTS.format('w')} AS older FROM ({_VERSIONS})")
def version_compare(spark, sf_dir):
    """Orders stand for installed and offered versions, of three and of two numbers."""
    o, t = table(spark, sf_dir, "orders"), lambda c: c.cast("string")
    v = F.concat(F.lit("v"), t(F.col("o_orderkey") % 3), F.lit("."), t(F.col("o_custkey") % 20), F.lit("."), t(F.dayofmonth("o_orderdate")))
    w = F.concat(t(F.col("o_custkey") % 3), F.lit("."), t(F.col("o_orderkey") % 20))
    return o.select("o_orderkey", v.alias("v"), w.alias("w")).withColumn("older", text.version_parts(F.col("v")) < text.version_parts(F.col("w")))
