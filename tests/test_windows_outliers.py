from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandflow.functions.numeric import blend_weight
from demandflow.operators import inventory, lookups, outliers, stats, windows
from tests.conftest import by_product, make_series


def noisy(n, seed, gaps=0.0, spikes=0.0):
    rng = random.Random(seed)
    values = []
    for i in range(n):
        v = 100 + 30 * math.sin(i / 8) + rng.gauss(0, 10)
        if rng.random() < spikes:
            v *= rng.choice([0.05, 4])
        values.append(None if rng.random() < gaps else round(v, 3))
    return values


SERIES = {
    "long": noisy(140, 1), "gappy": noisy(120, 2, gaps=0.2), "spiky": noisy(110, 3, spikes=0.1),
    "wild": noisy(90, 4, spikes=0.5), "holed": noisy(60, 5, gaps=0.3, spikes=0.2), "short": noisy(9, 6),
}


def close(got, want):
    assert len(got) == len(want)
    for i, (a, b) in enumerate(zip(got, want)):
        missing = b is None or (isinstance(b, float) and math.isnan(b))
        assert (a is None) if missing else a == pytest.approx(b, rel=1e-9, abs=1e-7), (i, a, b)


def test_rolling_and_weighted_features_match_pandas(spark):
    line = make_series(spark, **SERIES)
    feats = windows.with_ewm(line).withColumns(
        {"med": windows.rolling_median(4), "std": windows.rolling_std(8), "lag": F.lag("demand", 4).over(windows.in_time())}
    )
    boundary = windows.with_ewm(line, min_points_std=4)
    for name, values in SERIES.items():
        s = pd.Series(values, dtype=float)
        mine = feats.where(F.col("product_id") == name)
        close(by_product(mine, "med")[name], s.rolling(4, min_periods=1).median().tolist())
        close(by_product(mine, "std")[name], s.rolling(8, min_periods=4).std().tolist())
        close(by_product(mine, "lag")[name], s.shift(4).tolist())
        close(by_product(mine, "ewm_mean")[name], s.ewm(span=8, min_periods=1).mean().tolist())
        close(by_product(mine, "ewm_std")[name], s.ewm(span=8, min_periods=1).std().tolist())
        close(
            by_product(boundary.where(F.col("product_id") == name), "ewm_std")[name],
            s.ewm(span=8, min_periods=4).std().tolist(),
        )


def test_weighted_features_do_not_depend_on_the_block(spark):
    line = make_series(spark, long=noisy(400, 7, gaps=0.1), late=[None] * 90 + noisy(60, 8), early=[1.0, *[None] * 300])
    columns = ["product_id", "week_end", "ewm_mean", "ewm_std"]
    want = windows.with_ewm(line, block=10_000).select(columns).orderBy(columns[:2]).collect()
    for block in (7, 128):
        got = windows.with_ewm(line, block=block).select(columns).orderBy(columns[:2]).collect()
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2]
            close(a[2:], b[2:])
    assert want[-1]["ewm_mean"] is not None and by_product(windows.with_ewm(line), "ewm_mean")["early"][-1] == 1.0


def test_features_absent_for_short_series(spark):
    row = windows.weekly_features(make_series(spark, A=[1, 2, 3, 4, 5])).orderBy("week_end").collect()[-1]
    assert row["lag_4"] == 1 and row["rolling_median_4"] == 3.5
    assert all(row[c] is None for c in ("lag_13", "lag_52", "q_q_change", "direction", "ewm_mean", "volatility"))


def filled(values):
    """Gaps take the value before them; those at the front the first value there is."""
    out, last = [], next((v for v in values if v is not None), None)
    for v in values:
        last = last if v is None else v
        out.append(last)
    return out


def around(values, i):
    """Median of the known values at most two weeks off, if there are two."""
    known = [v for v in values[max(0, i - 2) : i + 3] if v is not None]
    return statistics.median(known) if len(known) >= 2 else None


def spread(values):
    """Median of the known values and of their distances to it."""
    known = [v for v in values if v is not None]
    middle = statistics.median(known)
    return middle, statistics.median([abs(v - middle) for v in known])


def local_rule(values, t):
    """A value whose distance to its neighbourhood's median is more than `t` of the usual goes to that limit."""
    weeks = range(len(values))
    middle = filled([around(values, i) for i in weeks])
    distances = [None if v is None else abs(v - m) for v, m in zip(values, middle)]
    usual = filled([around(distances, i) for i in weeks])
    if len(values) < 12 or any(u is None or u <= 0 for u in usual):
        return list(values)
    out = []
    for v, m, u, d in zip(values, middle, usual, distances):
        beyond = v is not None and 0.6745 * d / u > t
        out.append((m + t * u if v > m else m - t * u) if beyond else v)
    return out


def cap_rule(values, t):
    """A value far from the median on either side becomes the upper limit; a series with a gap stays."""
    if len(values) < 12 or None in values:
        return list(values)
    middle, usual = spread(values)
    return [middle + t * usual * 3 if usual > 0 and 3 * abs(v - middle) / usual > t else v for v in values]


def clip_rule(values, t):
    """Values are limited to the median and `t` normal deviations estimated by the usual distance."""
    if len(values) < 12:
        return list(values)
    middle, usual = spread(values)
    reach = t * 1.4826 * usual
    if usual <= 1e-6:
        return list(values)
    return [None if v is None else max(middle - reach, min(middle + reach, v)) for v in values]


def active_series(count):
    """Series whose rolling MAD never is 0, so that the local rule acts on them."""
    found = {}
    for seed in range(20000):
        rng = random.Random(seed)
        values = [round(rng.gauss(100, 10), 2) for _ in range(14)]
        if local_rule(values, 1.0) != values:
            found[f"active{len(found)}"] = values
        if len(found) == count:
            return found
    raise AssertionError("no such series")


def test_outlier_rules(spark):
    cases = {**SERIES, **active_series(3), "flat": [5.0] * 20}
    line = make_series(spark, **cases)
    capped = by_product(outliers.outliers_cap(line, 2.5), "adjusted")
    clipped = by_product(outliers.outliers_clip(line, 1.5), "adjusted")
    local = by_product(outliers.outliers_rolling(line, 1.0), "adjusted")
    auto = by_product(outliers.outliers_auto(line, F.col("product_id") == "gappy", 2.5), "adjusted")
    changed = 0
    for name, values in cases.items():
        close(capped[name], cap_rule(values, 2.5))
        close(clipped[name], clip_rule(values, 1.5))
        close(local[name], local_rule(values, 1.0))
        s = pd.Series(values, dtype=float)
        rolling = s.std() / s.mean() > 0.5 or name == "gappy"
        close(auto[name], (local_rule if rolling else cap_rule)(values, 2.5))
        changed += local[name] != values
    assert changed >= 3


def test_low_outlier_becomes_the_upper_bound(spark):
    values = [100, 101, 99, 100, 102, 98, 100, 101, 99, 100, 100, 1]
    got = by_product(outliers.outliers_cap(make_series(spark, A=values)), "adjusted")["A"]
    assert got[-1] == 100 + 2.5 * 1 * 3
    with_gap = by_product(outliers.outliers_cap(make_series(spark, A=[*values, None])), "adjusted")["A"]
    assert with_gap[-2] == 1


def test_profiles_and_trends(spark):
    year = [10.0] * 26 + [20.0] * 26
    line = make_series(spark, up=[10] * 10 + [13] * 10, down=[10] * 10 + [7] * 10, flat=[5] * 20, tiny=[1, 9], zero=[0] * 6 + [3] * 6)
    assert {r["product_id"]: r["trend"] for r in stats.detect_trend(line).collect()} == {
        "up": "up", "down": "down", "flat": "none", "tiny": "none", "zero": "none"
    }
    factors = stats.weekly_seasonal_factors(make_series(spark, two=year * 2, short=year)).collect()
    two = [r["factor"] for r in factors if r["product_id"] == "two"]
    assert len(two) == 53 and sum(two) == pytest.approx(53)
    assert {r["factor"] for r in factors if r["product_id"] == "short"} == {1.0}
    trend = {r["product_id"]: r["trend"] for r in stats.trend_factor(make_series(spark, a=year, b=[1] * 25)).collect()}
    assert trend == {"a": pytest.approx(20 / 15), "b": 1.0}
    spikes = {r["product_id"]: (r["previous_median"], r["is_spike"]) for r in windows.recent_spike(
        make_series(spark, a=[1, 2, None, 3, 10], b=[4], c=[2, 2, 2, 2])).collect()}
    assert spikes == {"a": (2.0, True), "b": (None, False), "c": (2.0, False)}


def test_weighted_quarter_trend(spark):
    values = noisy(120, 9)
    s = pd.Series(values, index=pd.date_range("1995-01-01", periods=120, freq="W"))
    q = s.groupby(pd.Grouper(freq="QE")).mean()
    w = np.exp(np.linspace(-2, 0, min(8, len(q))))
    want = (q.iloc[-len(w):].values * w).sum() / (w.sum() * s.mean())
    short = noisy(30, 10)
    got = {r["product_id"]: r["trend"] for r in stats.weighted_quarter_trend(make_series(spark, a=values, b=short)).collect()}
    assert got["a"] == pytest.approx(want)
    assert got["b"] == pytest.approx(np.mean(short[-13:]) / np.mean(short))


def test_accuracy_leaves_zero_actuals_out_of_percentages(spark):
    df = spark.createDataFrame([("A", 0.0, 1.0), ("A", 10.0, 8.0), ("A", None, 5.0), ("Z", 0.0, 2.0)], "k string, actual double, predicted double")
    got = {r["k"]: tuple(r)[1:] for r in stats.forecast_accuracy(df, "k").collect()}
    assert got["A"] == (1.5, pytest.approx(math.sqrt(2.5)), 20.0, 20.0)
    assert got["Z"] == (2.0, 2.0, None, None)


def test_best_params_first_grid_point_wins_ties(spark):
    df = spark.createDataFrame([("A", 0, "x", None), ("A", 1, "y", 5.0), ("A", 2, "z", 5.0), ("B", 0, "x", None)], "product_id string, grid_idx int, params string, mape double")
    assert {r["product_id"]: r["params"] for r in stats.best_params(df).collect()} == {"A": "y", "B": None}


def test_blend_weights(spark):
    df = spark.createDataFrame([(0, 60, 0.1), (9, 60, 0.1), (0, 40, 0.1), (3, 60, 0.6), (9, 60, 0.6), (0, 60, None)], "i int, n int, cv double")
    got = [r[0] for r in df.select(blend_weight(F.col("i"), F.col("n"), F.col("cv"), F.lit(False))).collect()]
    assert got == pytest.approx([0.8, 0.4, 0.7, 0.3, 0.35, 0.8])


def test_asof_prefers_exact_then_nearest_then_later(spark):
    import datetime as dt

    day = dt.date(2000, 6, 4)
    back = day - dt.timedelta(days=364)
    rows = [("exact", back, 1.0), ("exact", back + dt.timedelta(days=1), 2.0), ("tie", back - dt.timedelta(days=2), 3.0),
            ("tie", back + dt.timedelta(days=2), 4.0), ("far", back + dt.timedelta(days=4), 5.0)]
    history = spark.createDataFrame(rows, "product_id string, obs_date date, value double")
    asked = spark.createDataFrame([(p, day) for p in ("exact", "tie", "far")], "product_id string, request_date date")
    got = {r["product_id"]: r["last_year_value"] for r in lookups.asof_last_year(history, asked).collect()}
    assert got == {"exact": 1.0, "tie": 4.0, "far": None}


def test_inventory(spark):
    rows = [("A", 1, 130.0, 100.0, 10.0, 2.0), ("A", 2, 260.0, 300.0, 10.0, 2.0)]
    df = spark.createDataFrame(rows, "product_id string, quarter_index int, demand double, supply double, opening double, wos double")
    out = inventory.inventory_balance(inventory.safety_stock(df)).orderBy("quarter_index").collect()
    assert [(r["safety_stock"], r["balance"], r["excess"]) for r in out] == [(40.0, -20.0, -60.0), (40.0, 20.0, -20.0)]


def test_previous_balance_needs_the_adjacent_quarter(spark):
    df = spark.createDataFrame([("A", 4, 1.0), ("A", 5, 2.0), ("A", 7, 3.0)], "product_id string, quarter_index int, balance double")
    got = [r["opening"] for r in lookups.previous_quarter_balance(df).orderBy("quarter_index").collect()]
    assert got == [None, 1.0, None]
