import pytest

from rasterloom.plans import catalogue
from tests.parity import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_range_join_has_no_nested_loop(spark):
    plan = catalogue.QUERIES["bbox_intersect_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["catalog_filter_desc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan or "StringStartsWith(event_type,c)" in plan


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
