"""The queries of the library and their DuckDB SQL."""

from recollex.plans import context, gate, guards, integrity, kg, knowledge, lifecycle, reflection, reports, retrieval, store, wakes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (retrieval, store, gate, kg, lifecycle, reflection, guards, context, knowledge, integrity, reports, wakes):
    QUERIES.update(_part.QUERIES)
    ORACLE_SQL.update(_part.ORACLE_SQL)
