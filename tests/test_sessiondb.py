"""Session databases made from events give what the queries over Parquet give."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from recollex.operators import context
from recollex.plans.catalogue import QUERIES
from recollex.sources.sessiondb import read_session_databases

DATA = "/root/testdata/sf0.001"
SCHEMA = "file string, provider string, session_id long, input_tokens long, api_calls long, started_at double"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three databases, two of them in folders, beside a file that is none and one without the table."""
    at = tmp_path_factory.mktemp("sessions")
    rows = duckdb.sql(f"SELECT event_type, event_id, CAST(floor(value * 1000) AS BIGINT), event_id % 50, epoch_us(ts) / 1e6 FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall()
    for i in range(3):
        sub = at / f"part {i}%"
        sub.mkdir()
        with sqlite3.connect(sub / "state.db") as db:
            db.execute("CREATE TABLE sessions (provider TEXT, session_id INTEGER, input_tokens INTEGER, api_calls INTEGER, started_at REAL)")
            db.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?)", rows[i::3])
    (at / "broken.db").write_bytes(b"not a database, but long enough to be read as one" * 50)
    sqlite3.connect(at / "empty.db").close()
    return str(at), len(rows)


def test_latest_session_as_over_parquet(spark, folder):
    s = read_session_databases(spark, folder[0], schema=SCHEMA, rows=100)
    assert s.count() == folder[1] and s.rdd.getNumPartitions() > 3 and s.select("file").distinct().count() == 3
    found = context.latest_session(s, 200_000)
    want = QUERIES["provider_latest_session"](spark, DATA)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select(*found.columns).collect()))


def test_recent_messages_are_found_in_the_database(spark, folder):
    since = 1706486400.0  # 2024-01-29
    recent = read_session_databases(spark, folder[0], schema=SCHEMA, tests=[("started_at", ">", since)])
    assert recent.count() == QUERIES["provider_recent_messages"](spark, DATA).head().messages < folder[1]


def test_tests_equal_sparks_filters(spark, folder):
    s = read_session_databases(spark, folder[0], schema=SCHEMA, rows=70)
    plain = spark.createDataFrame(s.collect(), SCHEMA)
    order = lambda d: sorted(map(tuple, d.collect()))
    for tests, same in (
        ([("provider", "=", "click")], "provider = 'click'"),
        ([("session_id", "in", [3, 5, 900])], "session_id IN (3, 5, 900)"),
        ([("session_id", "in", [])], "false"),
        ([("api_calls", ">=", 48), ("input_tokens", "<", 60000)], "api_calls >= 48 AND input_tokens < 60000"),
        ([("provider", "startswith", "p"), ("provider", "<=", "purchase")], "provider LIKE 'p%' AND provider <= 'purchase'"),
    ):
        found = read_session_databases(spark, folder[0], schema=SCHEMA, tests=tests, rows=200)
        assert order(found) == order(plain.where(same)), tests
    for same in ("startswith(provider, 'p')", "provider > 'e' OR api_calls = 1", "length(provider) = 4", "file LIKE '%1%'"):  # one DataFrame, many queries
        assert order(s.where(same)) == order(plain.where(same)), same
    assert s.where("api_calls = 1").unionByName(s.where("api_calls = 2")).count() == plain.where("api_calls IN (1, 2)").count()


def test_kinds_and_lacking_columns(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute('CREATE TABLE "odd ""name" (n, t TEXT COLLATE NOCASE, d)')
        db.executemany('INSERT INTO "odd ""name" VALUES (?, ?, ?)', [(1, "A", 2), ("x", "a", 2.5), (None, None, b"z"), (2**40, "é", None)])
    read = lambda *tests: read_session_databases(spark, str(tmp_path), 'odd "name', "n long, t string, d double, gone long", tests)
    assert sorted(map(tuple, read().collect()), key=str) == sorted([(1, "A", 2.0, None), (None, "a", 2.5, None), (None, None, None, None), (2**40, "é", None, None)], key=str)
    assert [r.n for r in read(("t", "=", "A")).collect()] == [1] and read(("n", ">", 0)).count() == 2 and read(("gone", "=", 1)).count() == 0
    assert read(("t", ">=", "a")).count() == 2 and read(("d", "<", 3)).count() == 2 and read().where("n IS NULL").count() == 2


def test_nothing_there(spark, tmp_path):
    assert read_session_databases(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="strings, longs and doubles"):
        read_session_databases(spark, str(tmp_path), schema="a array<long>").collect()
    for bad in (("nothing", "=", 1), ("started_at", "like", 1.0), ("input_tokens", "=", "1"), ("started_at", "startswith", 1)):
        with pytest.raises(Exception, match="column|kind|test"):
            read_session_databases(spark, str(tmp_path), tests=[bad]).collect()
