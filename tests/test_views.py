"""The views leave out no row of the tables that they stand for."""
import pytest

from graphloom.plans.bench_views import Views


@pytest.mark.parametrize("view, table, key", [("calls", "lineitem", "call_id"), ("assignments", "events", "ordinal")])
def test_views_are_whole(spark, tiny, view, table, key):
    v = Views(spark, tiny)
    got = getattr(v, view)
    assert got.count() == got.select(key).distinct().count() == getattr(v, table).count()


def test_exported_types_has_its_default_limit():
    from graphloom.plans.queries import ORACLES

    assert "k <= 500 " in ORACLES["r23_exported_types"]
