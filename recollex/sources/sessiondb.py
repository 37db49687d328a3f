"""A data source of session databases: SQLite files that assistants leave, one table of each, read in ranges of rows."""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

#: What a session table has if the reader is given no schema. `file` is the path of the database.
SESSIONS = "file string, session_id string, started_at double, input_tokens long, api_call_count long"
#: Storage classes of SQLite whose values a column of the type can hold; others are null.
_STORED = {LongType: ("integer",), DoubleType: ("integer", "real"), StringType: ("text",)}
_ARROW = {LongType: pa.int64(), DoubleType: pa.float64(), StringType: pa.string()}
_BATCH = 8192


@dataclass
class Rows(InputPartition):
    """Rows of one database with first <= rowid <= last."""

    path: str
    first: int
    last: int


def _named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


class SessionReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        for f in schema.fields:
            if type(f.dataType) not in _STORED:
                raise ValueError(f"{f.name}: a session table has strings, longs and doubles, not {f.dataType.simpleString()}")
        self.schema, self.path = schema, options["path"]
        self.table, self.step = options.get("table", "sessions"), int(options.get("rowspertask", 1_000_000))
        self.where: list[str] = []
        self.values: list = []
        self.tested: set[str] = set()
        for column, op, value in json.loads(options.get("tests", "[]")):
            self._test(column, op, value)

    def _test(self, column: str, op: str, value) -> None:
        """Adds a test that SQLite decides as Spark does: values of another kind than the column's fail it, and text
        compares by its bytes, whatever the table declares."""
        if column not in self.schema.names or column == "file":
            raise ValueError(f"no test of {column}: it is no column of the table")
        kind = type(self.schema[column].dataType)
        values = value if op == "in" else [value]
        if not all(isinstance(v, str if kind is StringType else int if kind is LongType else (int, float)) and not isinstance(v, bool) for v in values):
            raise ValueError(f"{column}: {value!r} is of another kind")
        name = _named(column)
        if op in ("=", ">", ">=", "<", "<="):
            test = f"{name} {op} ? COLLATE BINARY"
        elif op == "in":
            test = f"{name} COLLATE BINARY IN ({', '.join('?' * len(values))})"
        elif op == "startswith" and kind is StringType:
            test, values = f"substr({name}, 1, length(?)) = ? COLLATE BINARY", [value, value]
        else:
            raise ValueError(f"{op} is no test of {column}")
        self.where.append(f"(typeof({name}) IN ({', '.join(repr(s) for s in _STORED[kind])}) AND {test})")
        self.tested.add(column)
        self.values.extend(values)

    def partitions(self) -> list[Rows]:
        """Ranges of rowids, found by the ends of the table's tree; what is no database or has no such table has none."""
        out = []
        for path in sorted(glob.glob(os.path.join(self.path, "**", "*"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path)):
            if not os.path.isfile(path):
                continue
            try:
                db = _opened(path)
                try:
                    low = db.execute(f"SELECT min(rowid) FROM {_named(self.table)}").fetchone()[0]
                    high = db.execute(f"SELECT max(rowid) FROM {_named(self.table)}").fetchone()[0]
                finally:
                    db.close()
            except sqlite3.DatabaseError:
                continue
            if low is not None:
                out.extend(Rows(path, a, min(a + self.step - 1, high)) for a in range(low, high + 1, self.step))
        return out or [Rows("", 0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = [type(f.dataType) for f in self.schema.fields]
        shape = pa.schema([(f.name, _ARROW[k]) for f, k in zip(self.schema.fields, kinds)])
        db = _opened(partition.path)
        try:
            held = {r[1] for r in db.execute(f"PRAGMA table_info({_named(self.table)})")}
            columns, values = [], []
            for f, k in zip(self.schema.fields, kinds):
                if f.name == "file":
                    columns.append("?")
                    values.append(partition.path)
                elif f.name not in held:
                    columns.append("NULL")
                else:
                    c = _named(f.name)
                    value = f"CAST({c} AS REAL)" if k is DoubleType else c
                    columns.append(f"CASE WHEN typeof({c}) IN ({', '.join(repr(s) for s in _STORED[k])}) THEN {value} END")
            if self.tested - held:  # null here, so no row passes
                return
            where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
            rows = db.execute(f"SELECT {', '.join(columns)} FROM {_named(self.table)} WHERE {where}", [*values, partition.first, partition.last, *self.values])
            while block := rows.fetchmany(_BATCH):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*block), shape.types)], schema=shape)
        finally:
            db.close()


class SessionDatabases(DataSource):
    """Options: path (a folder, searched whole, or a glob), table (sessions), rowsPerTask (1,000,000), tests (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "sessiondb"

    def schema(self) -> str:
        return SESSIONS

    def reader(self, schema: StructType) -> SessionReader:
        return SessionReader(schema, {k.lower(): v for k, v in self.options.items()})


def read_session_databases(spark: SparkSession, path: str, table: str = "sessions", schema: str = SESSIONS, tests: Sequence[tuple] = (), rows: int = 1_000_000) -> DataFrame:
    """Rows of a table of all databases at path, which the driver and all executors must see, that pass all tests.

    A test is (column, operator, value) with =, <, <=, >, >=, in or startswith, and is decided in SQLite, before rows
    become Arrow batches. The tests are arguments, not filters that Spark hands down: Spark 4.1 keeps what was handed to
    such a reader for later queries over the same DataFrame, which then lose rows. Later filters are Spark's.
    Files that are no databases, or lack the table, have no rows; a column that a file lacks is null there, as is a value
    of another kind than the column's. Tables without rowids can't be read in ranges and have no rows."""
    spark.dataSource.register(SessionDatabases)
    r = spark.read.format("sessiondb").schema(schema).option("table", table).option("rowsPerTask", rows)
    return r.option("tests", json.dumps([list(t) for t in tests])).load(path)
