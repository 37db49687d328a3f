"""Knowledge-file queries; documents stand for files' titles and bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.operators import knowledge as N
from recollex.plans import sqltext as S
from recollex.plans.register import register
from recollex.tables import table

QUERIES, ORACLE_SQL, query = register()

_CONTENT = """'---' || chr(10) || 'Title: "Note ' || CAST(doc_id AS VARCHAR) || '"' || chr(10) || 'triggers: ["' || source || '", ' || lang || ']' || chr(10) || 'tags: [' || upper(lang) || ', Memo]' || chr(10) || '---' || chr(10) || chr(10)
 || '# ' || replace(substr(text, 1, 60), chr(10), ' ') || chr(10) || '- ' || replace(substr(text, 61, 80), chr(10), ' ') || chr(10) || 'plain **' || replace(replace(substr(text, 141, 30), chr(10), ' '), '*', ' ') || '** end' || chr(10) || '```Rust' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '```bash' || chr(10) || '```' || chr(10) || substr(text, 171)"""
_FILES = f"files AS (SELECT doc_id, 'note-' || CAST(doc_id AS VARCHAR) || '.md' AS filename, {_CONTENT} AS content FROM documents WHERE text IS NOT NULL)"


def _files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    line = lambda a, n: F.replace(F.substring("text", a, n), F.lit("\n"), F.lit(" "))
    content = F.concat(
        F.lit('---\nTitle: "Note '), F.col("doc_id").cast("string"), F.lit('"\ntriggers: ["'), "source", F.lit('", '), "lang", F.lit("]\ntags: ["), F.upper("lang"), F.lit(", Memo]\n---\n\n# "), line(1, 60), F.lit("\n- "), line(61, 80),
        F.lit("\nplain **"), F.replace(line(141, 30), F.lit("*"), F.lit(" ")), F.lit("** end\n```Rust\nx\n```\n```bash\n```\n"), F.expr("substring(text, 171)"),
    )
    return d.select("doc_id", F.concat(F.lit("note-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), content.alias("content"))


_HEAD = r"regexp_extract(content, '(?s)^---\n(.*?)\n---', 1)"
_VALUE = r"regexp_extract(" + _HEAD + r", '(?i)(?:^|\n)\s*{0}\s*:\s*([^\n]*)', 1)"
_ITEMS = r"list_filter(list_transform(string_split(regexp_extract(" + _VALUE + r", '^\[(.*)\]$', 1), ','), lambda x: trim(trim(x), chr(34) || chr(39))), lambda x: x <> '')"
_BODY = r"trim(regexp_replace(content, '(?s)^---\n.*?\n---', ''), chr(10) || chr(9) || ' ')"
_WORDS = rf"list_transform(regexp_extract_all(x, '{S.CJK}{{2,}}|[A-Za-z]{{3,}}'), lambda w: lower(w))"
_KEYS = rf"""list_concat(list_concat(flatten(list_transform(list_concat(regexp_extract_all(b, '(?m)^#{{1,4}}\s+(.+)$', 1), regexp_extract_all(b, '\*\*(.+?)\*\*', 1)), lambda x: {_WORDS})),
 flatten(list_transform(regexp_extract_all(b, '(?m)^[*-]\s+(.+)$', 1), lambda x: {_WORDS}[1:3]))),
 list_filter(list_transform(regexp_extract_all(b, '```(\w+)', 1), lambda x: lower(x)), lambda x: NOT list_contains({S.sql_list(N.PLAIN_LABELS)}, x)))"""


@query("kb_frontmatter", f"WITH {_FILES} SELECT filename, trim({_VALUE.format('title')}, '\"') AS title, {_VALUE.format('triggers')} AS triggers, array_to_string({_ITEMS.format('triggers')}, '|') AS items FROM files")
def kb_frontmatter(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("f", N.fields(F.col("content")))
    return f.select("filename", F.col("f")["title"].alias("title"), F.col("f")["triggers"].alias("triggers"), F.array_join(N.items(F.col("f")["triggers"]), "|").alias("items"))


@query("kb_markdown_index", f"WITH {_FILES}, p AS (SELECT filename, trim({_VALUE.format('title')}, '\"') AS title, list_transform(list_concat({_ITEMS.format('triggers')}, {_ITEMS.format('tags')}), lambda x: lower(x)) AS listed, {_BODY} AS b, length(content) AS size FROM files) SELECT filename, title, {S.joined(f'list_distinct(list_concat(listed, {_KEYS}))')} AS triggers, size FROM p")
def kb_markdown_index(spark, sf_dir):
    return N.index(_files(spark, sf_dir)).withColumn("triggers", F.array_join("triggers", "|"))


_SAFE = r"coalesce(nullif(lower(regexp_replace(substr(regexp_replace(title, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 30), '^_+|_+$', '', 'g')), ''), 'workflow')"
_NOTES = f"n AS (SELECT doc_id, substr(text, 1, 12) AS title, source, lang, text FROM documents WHERE text IS NOT NULL), s AS (SELECT *, {_SAFE} AS safe FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY doc_id) - 1 AS k FROM s)"
#: Every note takes the first name of its title that is neither another title's plain name nor given: the k-th that is free.
_NAMED = f"""{_NOTES}, plain AS (SELECT list(DISTINCT safe) AS names FROM s),
m AS (SELECT r.*, list_filter(list_transform(range(0, k + 1 + len(names)), lambda i: safe || CASE WHEN i = 0 THEN '' ELSE printf('_%02d', i) END), lambda v: v = safe OR NOT list_contains(names, v)) AS free FROM r, (SELECT safe AS base, list_filter(any_value(names), lambda v: starts_with(v, safe || '_')) AS names FROM s, plain GROUP BY safe) o WHERE r.safe = o.base)"""
_NAME = "free[k + 1] || '.md'"


def _records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return N.record(d.select(F.col("doc_id").alias("note_id"), F.substring("text", 1, 12).alias("title"), F.array("source", "lang").alias("triggers"), F.col("text").alias("body")))


@query("kb_record", f"WITH {_NAMED} SELECT doc_id AS note_id, {_NAME} AS filename, md5('---' || chr(10) || 'title: ' || title || chr(10) || 'triggers: [\"' || source || '\",\"' || lang || '\"]' || chr(10) || '---' || chr(10) || chr(10) || trim(text) || chr(10)) AS content_md5 FROM m")
def kb_record(spark, sf_dir):
    return _records(spark, sf_dir).select("note_id", "filename", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("kb_read", f"WITH {_FILES} SELECT filename, md5({_BODY}) AS body_md5 FROM files WHERE contains(filename, 'ote-1') ORDER BY filename LIMIT 1")
def kb_read(spark, sf_dir):
    """A file by a part of its name."""
    return N.read(_files(spark, sf_dir), "ote-1").select("filename", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("kb_list", f"WITH {_FILES} SELECT filename, trim({_VALUE.format('title')}, '\"') AS title, len({_ITEMS.format('triggers')}) AS n FROM files")
def kb_list(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("f", N.fields(F.col("content")))
    return f.select("filename", F.col("f")["title"].alias("title"), F.size(N.items(F.col("f")["triggers"])).alias("n"))
