"""The index that the retrieval queries share: written once for a session's tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from recollex.operators import blockindex
from recollex.sources.commits import _path
from recollex.staging import shared_dir
from recollex.tables import memories

_written: dict[tuple[str, str], str] = {}


def new_table(spark: SparkSession, name: str) -> str:
    """A place for a table that goes when the driver ends."""
    path = f"{shared_dir(spark)}/recollex-{uuid.uuid4().hex}-{name}"
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    return path


def index_of(spark: SparkSession, sf_dir: str) -> str:
    """The keyword index of the memories' summaries."""
    return _table(spark, sf_dir, "index", lambda path: blockindex.build(memories(spark, sf_dir), path))


def features_of(spark: SparkSession, sf_dir: str) -> str:
    """Trigram buckets and entities of the memories' summaries."""
    return _table(spark, sf_dir, "features", lambda path: blockindex.build_features(memories(spark, sf_dir), path))


def _table(spark, sf_dir, name, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_table(spark, name)
        write(path)
        _written[key] = path
    return _written[key]
