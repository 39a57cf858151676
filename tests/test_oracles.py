"""Every query that has SQL, on the smallest tables."""
import oracle
import pytest

from graphloom.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connect(tiny)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tiny, con, name):
    assert oracle.differences(QUERIES[name](spark, tiny), con, ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
