"""What the operators share: staged tables, size-checked broadcasts and column guards."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.staging import BROADCAST_ROWS, discard, shared_dir, small, staged

__all__ = ["BROADCAST_ROWS", "discard", "shared_dir", "small", "staged"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    """The text column as a string; null counts as empty, and so does a column that is missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def learned_crc(column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text) of documents. row_key is a hash of the text: rows that agree on doc_id and text get the
    same results, rows that share only the doc_id are told apart."""
    text = text_or_empty(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, row_key) under which null doc_ids meet."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])


def give_back() -> None:
    """Memory that the allocators of C and Arrow hold on to goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A function for mapInArrow that gives memory back when a partition is done: Spark keeps Python workers for later
    tasks, and what they hold would add up over stages."""

    def freed(batches):
        yield from run(batches)
        give_back()

    return freed
