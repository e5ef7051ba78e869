import pytest

from tests.oracle import connect, same
from tracewright.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_all_are_there():
    assert {q.split("_")[0] for q in catalog.QUERIES if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
