import pytest

from pagequarry.llm import registry
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(registry.queries()[name](spark, sf), con, registry.oracle_sql()[name])


def test_registered():
    import __spark_entry__ as e

    assert set(registry.queries()) | {"pipeline"} <= set(e.queries())
