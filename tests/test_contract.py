from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_point
from contract.catalog import ALL as CATALOG
from contract.check import difference, sql_frame

SMALL = "/root/testdata/sf0.001"
SAMPLE = (
    "quarterly_to_forecast", "seasonal_forecast", "backtest_seasonal", "grid_search", "capacity_plan", "rescue_plan",
    "two_level_header", "facts_upsert", "weekly_features", "outliers_auto", "asof_last_year", "resample_weekly",
)


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    without = (set(entry_point.queries()) - set(entry_point.oracle_sql())) & set(CATALOG)
    assert without == {
        "gbt_forecast", "boundary_forecast", "backtest_gbt", "backtest_boundary_trees", "gbt_grid_search", "roll_plan", "limits_plan", "production_plan",
    }


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["product_id", "week_end", "step", "forecast"] and df.count() == 25 * 13


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    got = entry_point.queries()[name](spark, SMALL).toPandas()
    assert difference(got, sql_frame(SMALL, entry_point.oracle_sql()[name])) is None
