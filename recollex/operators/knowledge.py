"""Knowledge files: front matter, keyword index, records under safe names, reading and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import text

HEAD = r"(?s)\A---[ \t]*\n(.*?)\n---"
WORDS = f"{text.CJK}{{2,}}|[A-Za-z]{{3,}}"
#: Labels of code blocks that say nothing.
PLAIN_LABELS = ("text", "bash", "sh", "shell", "python", "yaml", "json", "md", "markdown")


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")


def body(c: Column) -> Column:
    """The text without its front matter."""
    return F.trim(F.regexp_replace(c, HEAD, ""), F.lit(" \n\t"))


def fields(c: Column) -> Column:
    """Map of the `key: value` lines of the front matter: lower-cased keys, values without quotes."""
    lines = F.filter(F.transform(F.split(F.regexp_extract(c, HEAD, 1), "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), _unquoted(F.regexp_replace(x, "^[^:]*:", ""))))
    return F.map_from_entries(pairs)


def items(value: Column) -> Column:
    """The items of a value `[a, b]`, without quotes; of any other value none."""
    inner = F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), _unquoted), lambda x: x != "")


def _words(c: Column) -> Column:
    return F.transform(text.find_all(c, WORDS), lambda w: F.lower(w))


def content_keywords(c: Column) -> Column:
    """Distinct lower-cased words of headings and bold text, the first three of list items, and labels of code blocks."""
    b = body(c)
    found = F.flatten(F.transform(F.concat(text.find_all(b, r"(?m)^#{1,4}\s+(.+)$", 1), text.find_all(b, r"\*\*(.+?)\*\*", 1)), _words))
    listed = F.flatten(F.transform(text.find_all(b, r"(?m)^[*-]\s+(.+)$", 1), lambda x: F.slice(_words(x), 1, 3)))
    labels = F.filter(F.transform(text.find_all(b, r"```(\w+)", 1), lambda x: F.lower(x)), lambda x: ~x.isin(*PLAIN_LABELS))
    return F.array_distinct(F.concat(found, listed, labels))


def index(files: DataFrame) -> DataFrame:
    """filename, title, triggers (sorted), size of files (filename, content): triggers and tags of the front matter and the
    content's keywords; without a title the name without its ending."""
    f = files.withColumn("f", fields(F.col("content")))
    listed = F.transform(F.concat(F.coalesce(items(F.col("f")["triggers"]), F.array().cast("array<string>")), F.coalesce(items(F.col("f")["tags"]), F.array().cast("array<string>"))), lambda x: F.lower(x))
    title = F.coalesce(F.col("f")["title"], F.regexp_replace("filename", r"\.md$", ""))
    return f.select("filename", title.alias("title"), F.array_sort(F.array_distinct(F.concat(listed, content_keywords(F.col("content"))))).alias("triggers"), F.length("content").alias("size"))


def safe_name(title: Column) -> Column:
    """A title as a file name without its ending: what is no letter, digit, `_` or `-` becomes `_`, at most 30
    characters; `workflow` if nothing is left."""
    name = F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_-]", "_"), 1, 30)
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(name, "^_+|_+$", "")), F.lit("")), F.lit("workflow"))


def _number(c: Column) -> Column:
    """A file's number as its name has it: two digits at least; 0 has none."""
    digits = c.cast("string")
    return F.when(c == 0, "").otherwise(F.concat(F.lit("_"), F.when(c < 10, F.concat(F.lit("0"), digits)).otherwise(digits)))


def record(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """note_id, filename, content of notes (note_id, title, triggers, body) as Markdown with front matter. In order of
    note_id every note takes its title's name if that is free, else the least free number behind it. Taken are known files
    (filename), names given before, and the plain names of all titles, which stay with their own notes."""
    n = notes.withColumn("safe", safe_name(F.col("title"))).withColumn("place", F.row_number().over(Window.partitionBy("safe").orderBy("note_id")) - 1)
    taken = n.where("place = 0").select(F.col("safe").alias("name"))
    if known is not None:
        taken = taken.union(known.where(F.col("filename").endswith(".md")).select(F.regexp_replace("filename", r"\.md$", "")))
        plain = known.select(F.regexp_replace("filename", r"\.md$", "").alias("safe"), F.lit(0).cast("long").alias("t"))
    else:
        plain = n.limit(0).select("safe", F.lit(0).cast("long").alias("t"))
    numbered = r"^(.*)_(0[1-9]|[1-9]\d{1,17})$"
    taken = taken.where(F.col("name").rlike(numbered)).select(F.regexp_extract("name", numbered, 1).alias("safe"), F.regexp_extract("name", numbered, 2).cast("long").alias("t"))
    # below the i-th taken number t of a name, t - i are free: the k-th free one has as many taken before it as have t - i <= k
    taken = taken.union(plain).distinct().withColumn("k", F.col("t") - F.row_number().over(Window.partitionBy("safe").orderBy("t")) + 1)
    names = taken.select("safe").distinct()
    some = n.join(names, "safe", "left_semi").select("safe", F.col("place").cast("long").alias("k"), "note_id", F.lit(0).alias("taken"))
    both = some.unionByName(taken.select("safe", "k", F.lit(None).cast(n.schema["note_id"].dataType).alias("note_id"), F.lit(1).alias("taken")))
    before = F.sum("taken").over(Window.partitionBy("safe").orderBy("k", F.desc("taken")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moved = both.withColumn("before", before).where("taken = 0").select("safe", F.col("k").alias("place"), "before")
    n = n.join(moved, ["safe", "place"], "left").withColumn("number", F.col("place") + F.coalesce("before", F.lit(0)))
    content = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntriggers: "), F.to_json("triggers"), F.lit("\n---\n\n"), F.trim("body"), F.lit("\n"))
    return n.select("note_id", F.concat("safe", _number(F.col("number")), F.lit(".md")).alias("filename"), content.alias("content"))


def read(files: DataFrame, name: str) -> DataFrame:
    """filename, body of the file of that name, else of the first one whose name holds it."""
    exact = (F.col("filename") == name).cast("int")
    hits = files.where(F.contains("filename", F.lit(name))).orderBy(F.desc(exact), "filename").limit(1)
    return hits.select("filename", body(F.col("content")).alias("body"))
