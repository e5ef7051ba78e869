import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same
from tracewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
