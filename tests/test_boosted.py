"""Boosted forecasts: filling, groups, backtests and the staged search."""

from __future__ import annotations

import datetime as dt
import math
import statistics
from dataclasses import replace

import pytest
from pyspark.ml.linalg import Vectors

from demandflow.operators.stats import forecast_accuracy
from demandflow.plans import boosted
from demandflow.plans.boosted import CALM, FLAGGED, TreeParams
from tests.conftest import SUNDAY, by_product, make_series
from tests.test_windows_outliers import clip_rule, noisy

SMALL = TreeParams(trees=4, depth=2, learning_rate=0.3)
DECAY = 7 / 9


def capacity_features(values, day):
    """Features of a week from the scaled values before it; None where unknown."""

    def lag(k):
        return values[-k] if len(values) >= k else None

    def known(w):
        return [v for v in values[-w:] if v is not None]

    rolled = []
    for w in (4, 8):
        seen = known(w)
        rolled += [statistics.median(seen) if seen else None, statistics.stdev(seen) if len(seen) >= max(2, w // 2) else None]
    weights = [(DECAY ** (len(values) - 1 - i), v) for i, v in enumerate(values) if v is not None]
    mean = std = None
    if weights:
        total, squares = sum(w for w, _ in weights), sum(w * w for w, _ in weights)
        mean = sum(w * v for w, v in weights) / total
        if len(weights) >= 4:
            std = math.sqrt(sum(w * (v - mean) ** 2 for w, v in weights) * total / (total * total - squares))
    dates = [(day.month - 1) // 3 + 1, day.month, day.isocalendar()[1], day.timetuple().tm_yday, day.day, day.weekday(), day.year]
    return [*(lag(k) for k in (1, 2, 4, 8, 13)), *rolled, mean, std, *dates]


def plain_capacity(values, horizon, model):
    """The capacity forecast of one series with the model's own predictions."""
    cleaned = clip_rule(values, 2.5)
    observed = [v for v in cleaned if v is not None]
    level = statistics.fmean(observed)
    scale = level if level > 0 else 1.0
    scaled = [None if v is None else v / scale for v in cleaned]
    days = [SUNDAY + dt.timedelta(days=7 * i) for i in range(len(values) + horizon)]
    rows = [capacity_features(scaled[:t], days[t]) for t in range(len(values)) if scaled[t] is not None]
    rows = [r for r in rows if None not in r]
    if len(rows) < 5:
        return [max(0.0, level)] * horizon
    fills = [statistics.fmean(c) for c in zip(*rows)]
    quarters = {}
    for day, v in zip(days, cleaned):
        if v is not None:
            quarters.setdefault((day.month - 1) // 3, []).append(v)
    spread = statistics.pstdev(observed)
    out = []
    for step in range(horizon):
        day = days[len(values) + step]
        x = [f if v is None else v for v, f in zip(capacity_features(scaled, day), fills)]
        tree = model.predict(Vectors.dense(x)) * scale
        own = quarters.get((day.month - 1) // 3)
        seasonal = level * (statistics.fmean(own) / level if own else 1.0)
        weight = max(0.6 - step * 0.08, 0.2) if len(observed) < 26 else max(0.8 - step * 0.05, 0.3)
        mixed = weight * tree + (1 - weight) * seasonal
        if spread >= 1e-6:
            mixed = level + (mixed - level) * (1 - 0.3 * math.tanh(abs(mixed - level) / spread / 2))
        out.append(max(0.0, mixed))
        scaled.append(out[-1] / scale)
    return out


def test_missing_features_are_filled_and_few_rows_give_the_mean(spark):
    gappy = noisy(60, 5)
    for t in (-1, -2, -8, -13):
        gappy[t] = None
    cases = {"a": noisy(70, 1), "gappy": gappy, "late": [None] * 30 + noisy(25, 7), "few": noisy(16, 3), "short": [4.0, 6.0]}
    line = make_series(spark, **cases)
    setup = boosted._boundary_setup(line, 2.5)
    params = replace(SMALL, min_rows=1)
    model = boosted._fit(setup, {CALM: params})[CALM]
    got = by_product(boosted.boundary_forecast(line, 6, params=params), "forecast")
    for name, values in cases.items():
        assert got[name] == pytest.approx(plain_capacity(values, 6, model), rel=1e-6), name
    assert len(set(got["gappy"])) > 1 and len(set(got["few"])) == 1


def test_flagged_products_have_a_model_of_their_own(spark):
    line = make_series(spark, a=noisy(130, 1), b=noisy(120, 2), c=[3 * v for v in noisy(125, 3)])
    setup = boosted._demand_setup(line, ["c"], 2.5)
    models = boosted._fit(setup, {CALM: SMALL, FLAGGED: SMALL.slower()})
    assert models[CALM].getNumTrees == 4 and models[FLAGGED].getNumTrees == 6
    assert models[FLAGGED].getStepSize() == SMALL.learning_rate / 2
    assert {m.getFeatureSubsetStrategy() for m in models.values()} == {"0.8"}
    own = {r["product_id"]: r["group"] for r in setup.state.select("product_id", "group").collect()}
    assert own == {"a": CALM, "b": CALM, "c": FLAGGED}
    # A product's forecast follows its own model: without the other group nothing changes.
    both = by_product(boosted._weeks_ahead(boosted._walk(setup, models, 3)), "forecast")
    calm = by_product(boosted._weeks_ahead(boosted._walk(setup, {CALM: models[CALM]}, 3)), "forecast")
    seasonal_only = by_product(boosted._weeks_ahead(boosted._walk(setup, {}, 3)), "forecast")
    assert both["a"] == calm["a"] and both["b"] == calm["b"] and calm["c"] == seasonal_only["c"] != both["c"]


@pytest.mark.parametrize("kind", ["demand", "capacity"])
def test_backtests_see_no_held_out_week(spark, kind):
    cases = {"a": noisy(120, 1), "b": noisy(110, 2), "short": noisy(4, 3), "blank": [*noisy(90, 4), *[None] * 13]}
    k = 13 if kind == "demand" else 4
    pairs = boosted.gbt_backtest_pairs if kind == "demand" else boosted.boundary_backtest_pairs
    other = {n: v[:-k] + [7 * (x or 1) for x in v[-k:]] if len(v) > k else v for n, v in cases.items()}
    seen = []
    for c in (cases, other):
        found = pairs(make_series(spark, **c), params=SMALL)
        seen.append({(r["product_id"], r["week_end"]): (r["predicted"], r["actual"]) for r in found.collect()})
    assert seen[0].keys() == seen[1].keys()
    assert {key: p for key, (p, _) in seen[0].items()} == pytest.approx({key: p for key, (p, _) in seen[1].items()})
    for name in ("a", "b"):
        mine = [(p, a) for (n, _), (p, a) in sorted(seen[0].items(), key=lambda x: str(x[0][1])) if n == name]
        assert [a for _, a in mine] == cases[name][-k:] and all(p > 0 for p, _ in mine)
    # The same forecast as that of the shortened series.
    cut = make_series(spark, **{n: v[:-k] for n, v in cases.items() if len(v) > k + 5})
    if kind == "demand":
        plain = boosted.gbt_blend_forecast(cut, k, params=SMALL)
        want = {(r["product_id"], r["week_end"]): r["forecast"] for r in plain.collect()}
        assert {key: p for key, (p, _) in seen[0].items() if key[0] != "short"} == pytest.approx(want)
    scored = (boosted.gbt_backtest if kind == "demand" else boosted.boundary_backtest)(make_series(spark, **cases), params=SMALL)
    errors = {r["product_id"]: (r["error"], r["mae"]) for r in scored.collect()}
    assert errors["short"] == ("Not enough data", None)
    assert errors["blank"] == ("No valid actual values", None)
    assert errors["a"][0] is None and errors["a"][1] > 0


def test_search_equals_separate_fits(spark):
    grid = {"trees": (2, 5), "learning_rate": (0.1, 0.4), "depth": (1, 2), "min_rows": (1, 9)}
    line = make_series(spark, a=noisy(110, 1), b=noisy(100, 2), short=noisy(40, 3))
    scores = {(r["product_id"], r["grid_idx"]): (tuple(r["params"]), r["mape"]) for r in boosted.tree_grid_scores(line, grid).collect()}
    assert len(scores) == 3 * 16
    points = [(t, rate, d, m) for t in grid["trees"] for rate in grid["learning_rate"] for d in grid["depth"] for m in grid["min_rows"]]
    assert all(p == points[i] for (_, i), (p, _) in scores.items())
    for i in (0, 3, 9, 14):
        t, rate, depth, least = points[i]
        params = TreeParams(trees=t, learning_rate=rate, depth=depth, min_rows=least)
        alone = forecast_accuracy(boosted.gbt_backtest_pairs(line, params=params), "product_id")
        for r in alone.collect():
            assert scores[r["product_id"], i][1] == pytest.approx(r["mape"]), (i, r["product_id"])
    best = {r["product_id"]: r for r in boosted.tree_grid_search(line, grid).collect()}
    for name in ("a", "b"):
        mape, i = min((m, i) for (n, i), (_, m) in scores.items() if n == name)
        r = best[name]
        assert (r["trees"], r["learning_rate"], r["depth"], r["min_rows"]) == points[i] and r["mape"] == pytest.approx(mape)
    assert (best["short"]["trees"], best["short"]["depth"], best["short"]["mape"]) == (200, 5, None)
