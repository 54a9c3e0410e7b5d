"""Every registered flood query against its SQL in DuckDB; those without SQL must give rows."""

import pytest

from compare import connection, differs
from conftest import SF
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert differs(spark, name, QUERIES[name], ORACLES[name], SF, con) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0
