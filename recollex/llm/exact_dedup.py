"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 sets, for every text hash, one bit in each of two filters and keeps the bits that were set at least twice
(Spark's bitmap aggregates build them; only 8-byte positions move). Pass 2 probes: a row whose bits weren't both set
twice has no equal and passes straight through without a shuffle. Only possibly repeated hashes are grouped, exactly,
by SHA-256. The filters have a bounded size and are always broadcast: with more rows than they are made for, more bits
are set and more hashes are grouped, but the way stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.llm._shared import small, staged, text_or_empty

#: Filters have BITS_PER_ROW bits for each row, up to so many bits (32 MB).
FILTER_BITS = 1 << 28
BITS_PER_ROW = 16
FILTERS = 2
#: Bits in one bitmap of Spark's bitmap functions.
BLOCK = 8 * 4096


def _position(column: Column, which: int, bits: int) -> Column:
    """1-based position in the concatenated filters."""
    return F.pmod(F.xxhash64(column, F.lit(which)), F.lit(bits)) + F.lit(which * bits + 1)


def _bit(bitmap: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.get(F.array(*[byte.bitwiseAND(F.lit(1 << k)) != 0 for k in range(8)]), F.pmod(at, F.lit(8)).cast("int")), F.lit(False))


def repeat_filter(hashes: DataFrame, column: str, rows: int, least: int = 2) -> tuple[DataFrame, int]:
    """The blocks (block, bits) of the filters with the bits that at least so many rows set, and the bits of one filter."""
    bits = min(max(FILTER_BITS, BLOCK), max(BLOCK, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length()))
    positions = hashes.select(F.explode(F.array(*[_position(F.col(column), j, bits) for j in range(FILTERS)])).alias("p"))
    often = positions.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")), bits


def with_maybe(hashes: DataFrame, column: str, blocks: DataFrame, bits: int) -> DataFrame:
    """Adds maybe: whether the filters hold the hash. Both are broadcast, 64 MB at most in blocks of 4 KB."""
    out = hashes
    for j in range(FILTERS):
        b = blocks.select(F.col("block").alias(f"__b{j}"), F.col("bits").alias(f"__bits{j}"))
        p = _position(F.col(column), j, bits)
        out = out.join(F.broadcast(b), F.bitmap_bucket_number(p) == F.col(f"__b{j}"), "left")
        out = out.withColumn(f"__hit{j}", _bit(F.col(f"__bits{j}"), p)).drop(f"__b{j}", f"__bits{j}")
    hits = [F.col(f"__hit{j}") for j in range(FILTERS)]
    return out.withColumn("maybe", hits[0] & hits[1]).drop(*[f"__hit{j}" for j in range(FILTERS)])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared unchanged; null is empty. Of equal texts the row with the largest doc_id stays (a null doc_id is
    smallest); of rows that repeat that doc_id and text too, exactly one. Empty texts form a group of their own. Other
    columns are ignored; an empty table gives an empty result. Only hash, id and row number move, never the text.
    """
    hashes = docs.select(F.col("doc_id"), F.unhex(F.sha2(text_or_empty(docs), 256)).alias("sha")).withColumn("rid", F.monotonically_increasing_id())
    hashes = staged(hashes, "hashes")
    blocks, bits = repeat_filter(hashes, "sha", hashes.count())
    probed = with_maybe(hashes, "sha", staged(blocks, "filter"), bits)
    alone = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = probed.where("maybe").drop("maybe")
    groups = staged(again.groupBy(F.col("sha").alias("g")).agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size")), "groups")
    # written, so that beyond the broadcast bound both sides are plain exchanges, which Spark splits at a hot hash
    met = again.join(small(groups, groups.count()), F.col("sha") == F.col("g")).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "sha")
    return alone.unionByName(met).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Which texts repeat is found on hashes alone; a filter of the
    repeated ones then lets all other rows pass straight through, so a text moves only if it repeats (or by a filter's
    error). Of equal texts one row is picked by a mergeable max, so a group of any size never meets in one task: the
    largest doc_id's (null is smallest), and of several rows with it the one whose other columns have the largest hash."""
    sha = F.unhex(F.sha2(text_or_empty(docs), 256))
    hashes = staged(docs.select(sha.alias("__sha")), "hashes")
    blocks, bits = repeat_filter(hashes, "__sha", hashes.count())
    repeated = with_maybe(hashes, "__sha", staged(blocks, "filter"), bits).where("maybe").groupBy("__sha").agg(F.count("*").alias("n")).where("n >= 2")
    repeated = staged(repeated.select("__sha"), "repeated")
    blocks, bits = repeat_filter(repeated, "__sha", repeated.count(), least=1)
    probed = with_maybe(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["doc_id"].alias("__id"), sha.alias("__sha")), "__sha", staged(blocks, "filter"), bits)
    alone = probed.where("not maybe").select("__row")
    again = probed.where("maybe").groupBy("__sha").agg(F.max_by("__row", F.struct(F.coalesce("__id", F.lit(-(2**63))), F.xxhash64(F.to_json("__row")))).alias("__row")).select("__row")
    return alone.unionByName(again).select("__row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
