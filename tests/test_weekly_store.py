from __future__ import annotations

import pytest

from demandflow.plans import seasonal
from demandflow.sources.weekly_store import read_weekly_store, write_weekly_store
from tests.conftest import make_series
from tests.test_windows_outliers import noisy


def exchanges(df):
    """Shuffles by product in the plan, the rest of their keys whatever it is."""
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return plan.count("hashpartitioning(product_id")


def test_forecast_of_a_stored_series_needs_no_shuffle_by_product(spark, tmp_path):
    line = make_series(spark, **{f"P{i}": noisy(80 + i, i) for i in range(12)})
    write_weekly_store(line, "weekly", str(tmp_path), 4)
    stored = read_weekly_store(spark, "weekly")
    assert stored.columns == line.columns and sorted(stored.collect()) == sorted(line.collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, fast = seasonal.seasonal_forecast(line, 4), seasonal.seasonal_forecast(stored, 4)
        assert exchanges(plain) > 0 and exchanges(fast) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    key = lambda r: (r["product_id"], r["step"])
    for a, b in zip(sorted(plain.collect(), key=key), sorted(fast.collect(), key=key)):
        assert key(a) == key(b) and a["forecast"] == pytest.approx(b["forecast"])
    # Written again from itself, and refused when a week comes twice.
    write_weekly_store(stored.where("product_id <> 'P0'"), "weekly", str(tmp_path), 4)
    assert read_weekly_store(spark, "weekly").select("product_id").distinct().count() == 11
    with pytest.raises(ValueError, match="several rows"):
        write_weekly_store(line.union(line.limit(1)), "weekly", str(tmp_path), 4)
    assert read_weekly_store(spark, "weekly").select("product_id").distinct().count() == 11
    spark.sql("DROP TABLE weekly")
