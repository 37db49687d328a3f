"""Every query of the library runs on the smallest tables; those with SQL agree with DuckDB."""

import pytest

from recollex.plans.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import check

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        check(spark, DATA, QUERIES[name], ORACLE_SQL[name])
    else:
        QUERIES[name](spark, DATA).collect()


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
