"""A pair of registries for a module of queries."""

from __future__ import annotations


def register():
    queries, sqls = {}, {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return keep

    return queries, sqls, query
