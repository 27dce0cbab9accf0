from __future__ import annotations

import csv
import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from demandflow.operators import series as S
from demandflow.operators.stats import forecast_accuracy
from demandflow.plans import boosted, boundary, seasonal, smoothing
from demandflow.sources import readers
from tests.conftest import SUNDAY, by_product, make_series
from tests.test_windows_outliers import SERIES, cap_rule, clip_rule, local_rule, noisy


def test_seasonal_forecast_gives_the_published_values(spark, fixtures):
    """Quarter table in, 13 weeks of three products out, as published."""
    facts = readers.read_quarterly_facts(spark, f"{fixtures}/quarterly_facts.csv")
    weekly = S.weekly_demand(facts, readers.default_week_ratio(spark))
    line = S.weekly_series(weekly, tiebreak=("year", "quarter_num", "demand"))
    assert {r[0] for r in line.groupBy("product_id").count().select("count").collect()} == {444}
    got = {(r["product_id"], f"F{r['step']}"): r["forecast"] for r in seasonal.seasonal_forecast(line, 13, ["22B"]).collect()}
    with open(f"{fixtures}/expected_forecast.csv", encoding="utf-8") as f:
        want = {(r["Product ID"], r["Periodo"]): float(r["Valor Demanda"]) for r in csv.DictReader(f)}
    assert len(want) == 39 and got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9), key


def week_parts(day):
    return (day.month - 1) // 3 + 1, (day.isocalendar()[1] - 1) % 13 + 1


def mean(values):
    known = [v for v in values if v is not None and not math.isnan(v)]
    return sum(known) / len(known) if known else None


def plain_seasonal(values, horizon, flagged=False, spike=2.5):
    """Straightforward seasonal forecast of one series starting on SUNDAY."""
    n = len(values)
    usable = any(
        values[t] is not None and all(n <= k or (t >= k and values[t - k] is not None) for k in (1, 2, 4, 13, 52))
        for t in range(n)
    )
    days = [SUNDAY + dt.timedelta(days=7 * i) for i in range(n + horizon)]
    if not usable:
        return [0.0] * horizon
    known = [v for v in values if v is not None]
    cv = statistics.stdev(known) / mean(known) if len(known) > 1 else 0
    rule = local_rule if cv > 0.5 or flagged else cap_rule
    v = rule(values, 2.0 if flagged else spike)
    overall = mean(v)
    cells, qs, ws = {}, {}, {}
    for day, x in zip(days, v):
        q, w = week_parts(day)
        cells.setdefault((q, w), []).append(x)
        qs.setdefault(q, []).append(x)
        ws.setdefault(w, []).append(x)
    if flagged:
        size = min(13, n // 2)
        trend = mean(v[-size:] if size else v) / overall
        if n >= 52:
            by_quarter = {}
            for day, x in zip(days, v):
                by_quarter.setdefault((day.year, (day.month - 1) // 3), []).append(x)
            means = [mean(x) for x in by_quarter.values()][-8:]
            weights = [math.exp(-2 + 2 * i / max(len(means) - 1, 1)) for i in range(len(means))]
            trend = sum(a * b for a, b in zip(means, weights)) / (sum(weights) * overall)
    else:
        trend = mean(v[-26:]) / overall if n >= 26 else 1.0
    out = []
    for day in days[n:]:
        q, w = week_parts(day)
        if (q, w) in cells:
            base = mean(cells[(q, w)])
        else:
            factor = lambda groups, key: mean(groups[key]) / overall if key in groups else 1.0
            base = overall * factor(qs, q) * factor(ws, w)
        out.append(0.0 if base is None else max(0.0, base * trend))
    return out


def test_seasonal_forecast_against_a_plain_one(spark):
    cases = {**SERIES, "one": [7.0], "third": noisy(30, 20), "young": noisy(20, 21), "falling": [-5.0] * 30, "flagged": noisy(130, 22, spikes=0.1), "flagshort": noisy(31, 23), "sparse": [5.0, None] * 40}
    flagged = ["flagged", "flagshort"]
    got = by_product(seasonal.seasonal_forecast(make_series(spark, **cases), 20, flagged), "forecast")
    for name, values in cases.items():
        assert got[name] == pytest.approx(plain_seasonal(values, 20, name in flagged)), name
    assert got["sparse"] == [0.0] * 20  # no week with all lags known


def plain_smoothing(values, horizon, n_recent=26, alpha=0.6, spike=2.5):
    """Straightforward smoothing forecast of one series starting on SUNDAY."""
    days = [SUNDAY + dt.timedelta(days=7 * i) for i in range(len(values) + horizon)]
    known = {d: v for d, v in zip(days, values) if v is not None}
    if not known:
        return [0.0] * horizon
    raw = list(known.values())
    v = cap_rule(raw, spike)
    n = len(v)
    half = n // 2
    trend = "none"
    if n >= 12 and mean(v[:half]) != 0:
        change = (mean(v[half:]) - mean(v[:half])) / mean(v[:half]) * 100
        trend = "up" if change > 20 else "down" if change < -20 else "none"
    factors = {w: 1.0 for w in range(1, 54)}
    if n >= 104 and statistics.median(v) != 0:
        weeks = {}
        for d, x in zip(known, v):
            weeks.setdefault(d.isocalendar()[1], []).append(x)
        med = statistics.median(v)
        f = {w: min(max(statistics.median(weeks.get(w, [med])) / med, 0.6), 1.8) for w in range(1, 54)}
        factors = {w: x * 53 / sum(f.values()) for w, x in f.items()}
    if trend == "down":
        n_recent, alpha = min(n_recent, 13), 0.8
    elif trend == "up":
        n_recent, alpha = min(n_recent, 52), 0.6
    m = min(n_recent, n)
    weights = [math.exp(-1.5 + (1.5 * i / (m - 1) if m > 1 else 0)) for i in range(m)]
    level = sum(a * b for a, b in zip(v[-m:], weights)) / sum(weights)
    before = v[-4:-1] if n >= 4 else v[:-1]
    previous = statistics.median(before) if before else None
    spiked = previous is not None and v[-1] > previous * (1 + spike / 5)
    out = []
    for i, day in enumerate(days[len(values):]):
        f = factors[day.isocalendar()[1]]
        x = level * f
        year_ago = known.get(day - dt.timedelta(days=364))
        if year_ago is not None:
            x = alpha * x + (1 - alpha) * year_ago
        if spiked and i < 2:
            x = x * 0.4 + previous * f * 0.6
        out.append(max(0.0, x))
    return out


CASES = {
    **SERIES, "jump": [*noisy(70, 30), 400.0], "rising": [50 + 3 * i for i in range(115)], "sinking": [500 - 4 * i for i in range(110)],
    "two": [3.0, 9.0], "none": [None, None], "exact104": noisy(104, 31), "tail": [*noisy(80, 32), None, None],
}


def test_smoothing_forecast_against_a_plain_one(spark):
    got = by_product(smoothing.smoothing_forecast(make_series(spark, **CASES), 60), "forecast")
    for name, values in CASES.items():
        assert got[name] == pytest.approx(plain_smoothing(values, 60)), name


def test_grid_search_against_every_point(spark):
    cases = {k: CASES[k] for k in ("long", "spiky", "jump", "rising", "sinking", "short", "holed")}
    got = {r["product_id"]: r for r in smoothing.grid_search(make_series(spark, **cases)).collect()}
    assert set(got) == set(cases)
    for name, values in cases.items():
        best = (None, (26, 0.6, 2.5))
        if len(values) >= 65:
            actual = values[-13:]
            for n in (13, 26, 52):
                for a in (0.4, 0.6, 0.8):
                    for s in (2.0, 2.5, 3.0):
                        if n >= len(values) - 13:
                            continue
                        errors = [abs((x - y) / x) for x, y in zip(actual, plain_smoothing(values[:-13], 13, n, a, s)) if x]
                        mape = sum(errors) / len(errors) * 100
                        if best[0] is None or mape < best[0] - 1e-9:
                            best = (mape, (n, a, s))
        row = got[name]
        assert (row["n_recent"], row["alpha"], row["spike"]) == best[1], name
        assert row["mape"] == (None if best[0] is None else pytest.approx(best[0]))


def test_backtests_and_their_errors(spark):
    cases = {"long": SERIES["long"], "gappy": SERIES["gappy"], "short": SERIES["short"], "blank": [*noisy(30, 40), *[None] * 13]}
    line = make_series(spark, **cases)
    pairs = {"seasonal": plain_seasonal, "smoothing": plain_smoothing}
    for kind, table in (("seasonal", seasonal.seasonal_backtest(line)), ("smoothing", smoothing.smoothing_backtest(line))):
        got = {r["product_id"]: r for r in table.collect()}
        assert got["short"]["error"] == "Not enough data" and got["short"]["mae"] is None
        assert got["blank"]["error"] == "No valid actual values"
        for name in ("long", "gappy"):
            values = cases[name]
            forecast = pairs[kind](values[:-13], 13)
            errors = [abs(a - f) for a, f in zip(values[-13:], forecast) if a is not None]
            assert got[name]["mae"] == pytest.approx(sum(errors) / len(errors)) and got[name]["error"] is None


def test_missing_products_and_result_rows(spark):
    line = make_series(spark, A=noisy(60, 50))
    asked = spark.createDataFrame([("A",), ("Z",)], "product_id string")
    full = seasonal.with_missing_products(seasonal.seasonal_forecast(line, 3), asked, 3)
    params = spark.createDataFrame([("A", "p")], "product_id string, parameters string")
    rows = {r["product_id"]: r for r in seasonal.format_results(full, params, seasonal.seasonal_backtest(line)).collect()}
    assert rows["Z"]["forecast"] == [0.0] * 3 and rows["Z"]["forecast_dates"] == ["N/A"] * 3
    assert len(rows["A"]["forecast"]) == 3 and rows["A"]["parameters"] == "p" and rows["A"]["mape"] > 0


def test_boundary_baseline(spark):
    cases = {"long": SERIES["spiky"], "few": [4.0, 6.0, None, 8.0], "flat": [9.0] * 20}
    line = make_series(spark, **cases)
    got = by_product(boundary.boundary_baseline(line, 15), "forecast")
    assert got["few"] == pytest.approx([6.0] * 15) and got["flat"] == pytest.approx([9.0] * 15)
    v = clip_rule(cases["long"], 2.5)
    days = [SUNDAY + dt.timedelta(days=7 * i) for i in range(len(v) + 15)]
    m, sd = mean(v), statistics.pstdev(v)
    for day, x in zip(days[len(v):], got["long"]):
        base = mean([y for d, y in zip(days, v) if week_parts(d)[0] == week_parts(day)[0]])
        assert x == pytest.approx(m + (base - m) * (1 - 0.3 * math.tanh(abs((base - m) / sd) / 2)))
    both = boundary.boundary_combine(line, boundary.boundary_baseline(line, 2))
    assert by_product(both, "capacity")["few"] == [4, 6, 0, 8, 6, 6]
    metrics = {r["product_id"]: r["mae"] for r in forecast_accuracy(boundary.boundary_baseline_pairs(line), "product_id").collect()}
    assert metrics["flat"] == 0.0 and metrics["few"] is None


def test_boosted_forecasts(spark):
    trees = boosted.TreeParams(trees=3, depth=2, learning_rate=0.3)
    line = make_series(spark, a=noisy(150, 60), b=noisy(140, 61), young=noisy(20, 62))
    got = by_product(boosted.gbt_blend_forecast(line, 5, params=trees), "forecast")
    plain = by_product(seasonal.seasonal_forecast(line, 5), "forecast")
    assert all(len(v) == 5 and min(v) >= 0 for v in got.values())
    assert got["young"] == pytest.approx(plain["young"])  # lag 52 is unknown
    assert got["a"] != pytest.approx(plain["a"]) and all(20 < v < 400 for v in got["a"])
    capacity = by_product(boosted.boundary_forecast(line, 5, params=trees), "forecast")
    assert all(len(v) == 5 and min(v) >= 0 for v in capacity.values())
    tiny = make_series(spark, x=[1.0, 2.0, 3.0])
    assert by_product(boosted.boundary_forecast(tiny, 2, params=trees), "forecast") == {"x": [2.0, 2.0]}


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    line = make_series(spark, **SERIES).repartition(5)
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = seasonal.seasonal_forecast(line, 4).unionByName(smoothing.smoothing_forecast(line, 4))
            seen.append(sorted((r["product_id"], r["step"], round(r["forecast"], 9)) for r in rows.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_future_weeks(spark):
    got = S.future_weeks(make_series(spark, A=[1, 2]), 2)
    assert by_product(got, "week_end") == {"A": [SUNDAY + dt.timedelta(days=14), SUNDAY + dt.timedelta(days=21)]}
    assert got.where(F.dayofweek("week_end") != 1).count() == 0
