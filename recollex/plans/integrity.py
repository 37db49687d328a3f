"""Integrity, forensic and isolation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.operators import context as C
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.tables import table

QUERIES, ORACLE_SQL, query = register()
_DELTA = "octet_length(encode(html)) - octet_length(encode(CASE WHEN page_id % 3 = 0 THEN substr(html, 1, 100) WHEN page_id % 3 = 1 THEN html || repeat('x', 600) ELSE html END))"


@query("forensic_delta", f"WITH d AS (SELECT CAST(page_id AS VARCHAR) AS path, {_DELTA} AS delta, coalesce(json_valid(html), false) AS json FROM pages) SELECT path, delta, CASE WHEN delta > 500 THEN 'possible injection' WHEN delta < -500 THEN 'possible deletion' ELSE 'none' END AS finding, json FROM d")
def forensic_delta(spark, sf_dir):
    """Pages against a backup in which a third is cut, a third padded and a third equal."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"), (F.col("page_id") % 3).alias("k"))
    was = F.when(F.col("k") == 0, F.substring("content", 1, 100)).when(F.col("k") == 1, F.concat("content", F.repeat(F.lit("x"), 600))).otherwise(F.col("content"))
    return C.forensic_deltas(p.select("path", "content"), p.select("path", was.alias("content")))


_VERIFY = """m AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang, sha256(text) AS want, sha256(CASE WHEN lang IN ('de', 'fr') THEN text || ' ' ELSE text END) AS have FROM documents),
v AS (SELECT path, CASE WHEN lang = 'es' THEN 'missing' WHEN want = have THEN 'ok' WHEN path IN ('1', '2', '3') THEN 'data_changed' ELSE 'tampered' END AS status FROM m)"""


def _verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "text")
    expected = d.select("path", F.sha2("text", 256).alias("sha256"))
    actual = d.where("lang <> 'es'").select("path", F.sha2(F.when(F.col("lang").isin("de", "fr"), F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"))
    days = F.array(*[F.lit(x) for x in ("2024-01-01", "2024-01-03", "2024-01-02")])
    copies = d.select("path", F.explode(days).alias("day")).select("path", "day", F.concat(F.lit("daily_"), "day", F.lit("/"), "path").alias("copy"))
    return C.integrity_verdicts(expected, actual, ["1", "2", "3"], copies)


@query("integrity_verify", f"WITH {_VERIFY} SELECT path, status, CASE WHEN status = 'tampered' THEN 'daily_2024-01-03/' || path END AS recover_from FROM v")
def integrity_verify(spark, sf_dir):
    """Spanish files are missing, German and French ones changed; three paths are data files, which may change."""
    return _verdicts(spark, sf_dir)


@query("integrity_alert", f"WITH {_VERIFY}, b AS (SELECT path || ': ' || status AS l, path FROM v WHERE status IN ('missing', 'tampered')), f AS (SELECT * FROM b ORDER BY path LIMIT 20) SELECT 'integrity: ' || CAST((SELECT count(*) FROM b) AS VARCHAR) || ' critical' AS title, string_agg(l, chr(10) ORDER BY l) AS body FROM f")
def integrity_alert(spark, sf_dir):
    return C.alerts(_verdicts(spark, sf_dir))


@query("hash_change_log", "WITH d AS (SELECT doc_id, source, substr(sha256(text), 1, 16) AS old, substr(sha256(CASE WHEN lang <> 'en' THEN text || '!' ELSE text END), 1, 16) AS new FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM d WHERE old <> new) SELECT source, doc_id, old, new FROM r WHERE k <= 200")
def hash_change_log(spark, sf_dir):
    """Files whose hash differs from the snapshot's, the newest 200 of each source: versions meet by a join on the id."""
    d = table(spark, sf_dir, "documents")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    old = d.select("doc_id", short(F.col("text")).alias("old"))
    new = d.select("doc_id", "source", short(F.when(F.col("lang") != "en", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("new"))
    changed = new.join(old, "doc_id").where("old <> new")
    return C.bounded_log(changed, [F.desc("doc_id")], 200, "source").select("source", "doc_id", "old", "new")


@query("json_unescape_scan", "SELECT page_id, contains(html, 'and') AS found, length(html) AS chars FROM pages WHERE html IS NOT NULL")
def json_unescape_scan(spark, sf_dir):
    """Pages as JSON in which `and` is written with an escape: the scan sees the letters."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    raw = p.select("page_id", F.replace(F.to_json(F.struct("html")), F.lit("and"), F.lit("\\u0061nd")).alias("raw"))
    clean = raw.select("page_id", F.contains("raw", F.lit("and")).alias("before"), F.from_json(C.unescaped(F.col("raw")), "html string")["html"].alias("t"))
    return clean.where("not before").select("page_id", F.contains("t", F.lit("and")).alias("found"), F.length("t").cast("long").alias("chars"))


@query("base64_rules", "SELECT item_id, md5(text) AS rule_md5, length(text) AS chars FROM benchmark WHERE text IS NOT NULL")
def base64_rules(spark, sf_dir):
    """Rule phrases that are kept in base64, decoded."""
    b = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.base64(F.col("text").cast("binary")).alias("rule"))
    rule = F.unbase64("rule").cast("string")
    return b.select("item_id", F.md5(rule.cast("binary")).alias("rule_md5"), F.length(rule).cast("long").alias("chars"))


_TERMS = ["a.b", "(x)", "e.", "?", "[", "+1"]


@query("dynamic_pattern_counts", f"SELECT t AS term, CAST(sum(length(text) - length(replace(text, t, ''))) AS BIGINT) // length(t) AS n FROM documents, (SELECT unnest({S.sql_list(_TERMS)}) AS t) GROUP BY t")
def dynamic_pattern_counts(spark, sf_dir):
    """Occurrences of terms that become patterns at run time, quoted."""
    d = table(spark, sf_dir, "documents").select("text", F.explode(F.array(*[F.lit(t) for t in _TERMS])).alias("term"))
    pattern = F.concat(F.lit("\\Q"), "term", F.lit("\\E"))
    return d.groupBy("term").agg(F.sum(F.size(F.split("text", pattern, -1)) - 1).cast("long").alias("n"))


@query("padded_report", "SELECT rpad(source, 16, '.') || lpad(CAST(count(*) AS VARCHAR), 8, ' ') AS line FROM documents GROUP BY source")
def padded_report(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.rpad("source", 16, "."), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


@query("user_isolation", "SELECT user_id, 'base/' || CAST(user_id AS VARCHAR) AS path, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def user_isolation(spark, sf_dir):
    """Each user's rows lie under the user's own path and are read through a filter on it."""
    e = C.user_partition(table(spark, sf_dir, "events"), "base")
    return e.groupBy("user_id", "path").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))
