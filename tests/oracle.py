"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6f}".rstrip("0").rstrip(".")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names: list[str], values) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def check(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    found = rows(df.columns, df.collect())
    rel = connect(sf_dir).sql(sql)
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    assert found == rows(names, rel.fetchall())
    return len(found)
