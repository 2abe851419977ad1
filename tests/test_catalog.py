"""Every catalogued query against its SQL, and plans without nested loops over facts."""

import pytest

from extentlake.plans import catalog, catalog_files, catalog_more, catalog_state  # noqa: F401

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["agg04_disk_stats", "agg17_disk_load", "agg03_pool_stats"])
def test_rollups_read_only_their_columns(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan
