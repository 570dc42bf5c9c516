import pytest

from oracle import connect, same
from sievework.plans import registry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, data, con, name):
    same(registry.QUERIES[name](spark, data), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
