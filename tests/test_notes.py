"""Notes are read to their ends: what stands behind a long beginning counts."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from recollex.operators import reflection
from recollex.plans import reflection as plans
from tests.oracle import check


@pytest.fixture
def long_texts(spark, tmp_path):
    rows = [(3, "a b c " * 200 + "Alpha"), (4, "a b c " * 200 + "Alpha"), (5, "a b c " * 200 + "it is bad Beta"), (6, "Beta"), (7, None)]
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_contradictions_of_whole_texts(spark, long_texts):
    assert {r.topic for r in plans.contradictions(spark, long_texts).collect()} == {"Alpha", "Beta"}
    check(spark, long_texts, plans.QUERIES["contradictions"], plans.ORACLE_SQL["contradictions"])


def test_report_of_whole_texts(spark, long_texts):
    assert {r.line.split(":")[0] for r in plans.reflection_report(spark, long_texts).where("kind = 'conflict'").collect()} == {"Alpha", "Beta"}
    check(spark, long_texts, plans.QUERIES["reflection_report"], plans.ORACLE_SQL["reflection_report"])


def test_report_computes_notes_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(reflection, "staged", lambda df, name, f=reflection.staged: names.append(name) or f(df, name))
    notes = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 4), ["A", "B"], ["positive", "negative"][i % 2]) for i in range(9)], "id long, day date, topics array<string>, mood string")
    lines = reflection.report(notes)
    assert names[0] == "notes" and ("summary", "4 conflicts, 2 links") in {(r.kind, r.line) for r in lines.collect()}
