"""Every query of the reference's operators against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from sparkaudit.queries import registry

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in registry()}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.difference(spark, con, QUERIES[name], SQL[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
