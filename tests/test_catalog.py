import pytest

from sparvane import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, agree, name):
    agree(catalog.QUERIES[name](spark, DATA), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - {"weight_grid"}))
def test_models_give_rows(spark, name):
    """weight_grid is in test_search.py."""
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25 * 5  # of 500 rows, those with ids divisible by 100 are queries
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_is_pushed_down(spark):
    plan = catalog.QUERIES["isin_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan or "PushedFilters: [In" in plan
    assert "l_extendedprice" not in plan
