"""A training corpus from documents: toxicity, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return rows of docs
with all their columns, extra ones too, whatever their names; the last returns the packed pieces. Null texts count as
empty; empty tables pass through all stages and give no pieces; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollex.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from recollex.llm._shared import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the model that the labels of docs teach. Null and empty texts stay; equal texts
    stay or go together; without labels of both kinds a fixed list of insults decides."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, toxicity.training_labels(labels)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id (a null one is smallest); of rows that repeat both, one. Null
    and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document with the least doc_id.
    Texts without words are near nothing and stay; rows that share a doc_id are one document; a null doc_id is least."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark, nor hold a shorter item's words in a row. Texts and
    items without words share nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their places in sequences; a null or empty text is one piece of the end id."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL can't express the trained stage and the packing; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
