"""Forecasts, backtests, parameter search and production plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contract import views as V
from contract.sql_parts import FACTS, PI, QU, SR, SRN, big, day, plan_ctes, r
from contract.stats_queries import FLAG5, KEY, LEVEL, ROLLED, capped, rolled
from contract.views import publish
from demandflow.operators import inventory, series as S, stats
from demandflow.plans import boosted, boundary, capacity, seasonal, smoothing, writeback
from demandflow.session import shared_folder
from demandflow.sources import readers, writers
from demandflow.sources.weekly_store import read_weekly_store, write_weekly_store

FLAGGED = ["Brand#5", "Brand#10", "Brand#15", "Brand#20", "Brand#25"]


def quarterly_to_forecast(spark, d):
    """Wide quarter table to weekly series to 13-week forecast, end to end."""
    facts = readers.quarterly_facts(V.wide_text(spark, d))
    weekly = S.weekly_demand(facts, readers.default_week_ratio(spark))
    line = S.weekly_series(weekly, tiebreak=("year", "quarter_num", "demand"))
    return publish(seasonal.seasonal_forecast(line, 13, FLAGGED), 2)


def seasonal_forecast(spark, d):
    return publish(seasonal.seasonal_forecast(V.series(spark, d), 26, FLAGGED))


def stored_forecast(spark, d):
    """The same forecast of a series kept in buckets by product."""
    name = f"weekly_{uuid.uuid4().hex[:12]}"
    write_weekly_store(V.series(spark, d), name, f"{shared_folder(spark).rstrip('/')}/{name}", 8)
    return publish(seasonal.seasonal_forecast(read_weekly_store(spark, name), 26, FLAGGED))


def smoothing_forecast(spark, d):
    return publish(smoothing.smoothing_forecast(V.series(spark, d), 60))


def bi_export(spark, d):
    line = V.series(spark, d)
    history = line.select("product_id", F.date_format("week_end", "yyyy-MM-dd").alias("period"), "demand")
    return publish(writers.export_bi(history, seasonal.seasonal_forecast(line, 13, FLAGGED)))


def quarter_buckets(spark, d):
    return publish(S.weeks_to_quarter_buckets(seasonal.seasonal_forecast(V.series(spark, d), 26, FLAGGED)))


def net_balance(spark, d):
    coming = seasonal.seasonal_forecast(V.series(spark, d), 13, FLAGGED)
    stock = V.quarters(spark, d).groupBy("product_id").agg(
        F.min("units").alias("initial"), F.max("units").alias("receipts"), F.avg("wos").alias("safety_stock")
    )
    return publish(inventory.net_balance(stats.horizon_demand(coming), stock))


def gbt_forecast(spark, d):
    return publish(boosted.gbt_blend_forecast(V.series(spark, d), 13, FLAGGED))


def backtest_gbt(spark, d):
    return publish(boosted.gbt_backtest(V.series(spark, d)).drop("error"))


#: A grid that a test run can afford; the library's own has 27 fits of 300 trees.
SMALL_TREE_GRID = {"trees": (5, 10), "learning_rate": (0.1, 0.3), "depth": (3,), "min_rows": (1, 3)}


def gbt_grid_search(spark, d):
    return publish(boosted.tree_grid_search(V.series(spark, d), SMALL_TREE_GRID))


def backtest_boundary_trees(spark, d):
    return publish(boosted.boundary_backtest(capacity_series(spark, d)).drop("error"))


def capacity_series(spark, d):
    return V.series(spark, d).withColumn("demand", F.col("demand") * V.WAFERS_PER_UNIT)


def boundary_forecast(spark, d):
    return publish(boosted.boundary_forecast(capacity_series(spark, d), 13))


def boundary_baseline(spark, d):
    return publish(boundary.boundary_baseline(capacity_series(spark, d), 26))


def boundary_combine(spark, d):
    line = capacity_series(spark, d)
    return publish(boundary.boundary_combine(line, boundary.boundary_baseline(line, 13)))


def backtest_boundary(spark, d):
    from demandflow.operators.stats import forecast_accuracy

    return publish(forecast_accuracy(boundary.boundary_baseline_pairs(capacity_series(spark, d)), "product_id"))


def backtest_seasonal(spark, d):
    return publish(seasonal.seasonal_backtest(V.series(spark, d)).drop("error"))


def backtest_smoothing(spark, d):
    return publish(smoothing.smoothing_backtest(V.series(spark, d)).drop("error"))


def grid_search(spark, d):
    return publish(smoothing.grid_search(V.series(spark, d)))


def format_results(spark, d):
    line = V.series(spark, d)
    forecast = seasonal.seasonal_forecast(line, 13, FLAGGED)
    params = line.select("product_id").distinct().withColumn("parameters", F.lit("spike=2.5"))
    metrics = seasonal.seasonal_backtest(line).select("product_id", "mape")
    rows = seasonal.format_results(forecast, params, metrics)
    return publish(
        rows.withColumns(
            {
                "forecast": F.array_join(F.transform("forecast", lambda v: F.round(v * 100).cast("bigint").cast("string")), ","),
                "forecast_dates": F.array_join("forecast_dates", ","),
            }
        )
    )


def capacity_plan(spark, d):
    plan = capacity.capacity_plan(V.planning(spark, d), V.LIMITS)
    return publish(plan.select("product_id", "quarter", "week_seq", "week_label", "wafers", "feasible", "band_too_narrow"))


def plan_kpis(spark, d):
    return publish(capacity.plan_kpis(capacity.capacity_plan(V.planning(spark, d), V.LIMITS)), 1)


def plan_to_facts(spark, d):
    kpis = capacity.plan_kpis(capacity.capacity_plan(V.planning(spark, d), V.LIMITS))
    return publish(writeback.plan_to_facts(V.facts(spark, d), kpis), 1)


def forecast_to_facts(spark, d):
    coming = seasonal.seasonal_forecast(V.series(spark, d), 26, FLAGGED)
    scaled = coming.withColumn("forecast", F.col("forecast") * V.DEMAND_PER_UNIT)
    wos = V.quarters(spark, d).select("product_id", "wos").distinct()
    return publish(writeback.forecast_to_facts(V.facts(spark, d), scaled, wos), 1)


def rescue_plan(spark, d):
    plan = capacity.rescue_plan(V.planning(spark, d), V.priorities(spark, d), V.LIMITS)
    return publish(plan.select("product_id", "quarter", "week_seq", "wafers", "feasible", "rescued"))


def roll_plan(spark, d):
    rolled_ = capacity.roll_plan(V.planning(spark, d), V.LIMITS)
    return publish(rolled_.select("product_id", "quarter", "feasible", "opening", "supply", "balance", "excess"), 1)


def limits_plan(spark, d):
    """Rolling plan in larger lots and a narrower band from the middle of each product's quarters on."""
    inputs = V.planning(spark, d)
    spans = inputs.groupBy("product_id").agg(F.min("quarter_index").alias("first"), F.max("quarter_index").alias("last"))
    half = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
    limits = V.LIMITS

    def interval(start, end, lot, hi):
        values = {"lot": lot, "min_week": limits.min_week, "max_decrease": limits.max_decrease, "lo": limits.lo, "hi": hi}
        fields = [F.lit(v).cast("int" if n == "lot" else "double").alias(n) for n, v in values.items()]
        return F.struct(start.cast("int").alias("from_index"), end.cast("int").alias("until_index"), *fields)

    early = interval(F.col("first"), half, limits.lot, limits.hi)
    late = interval(half, F.lit(None), 2 * limits.lot, (limits.lo + limits.hi) / 2)
    table = spans.select("product_id", F.inline(F.array(early, late)))
    rolled_ = capacity.roll_plan(inputs, table)
    return publish(rolled_.select("product_id", "quarter", "feasible", "opening", "supply", "balance", "excess"), 1)


def production_plan(spark, d):
    """Lines of three brands each; the second and third may use what the one before leaves."""
    brands = V.table(spark, d, "part").select(F.col("p_brand").alias("product_id")).distinct()
    number = V.brand_number() - 1
    order = brands.select("product_id", F.floor(number / 3).cast("int").alias("line"), (number % 3 + 1).alias("priority"))
    plan = capacity.production_plan(V.planning(spark, d), order, V.LIMITS)
    return publish(plan.select("product_id", "line", "quarter", "feasible", "rescued", "opening", "supply", "balance", "excess"), 1)


def seasonal_ctes(src: str, flag: str = FLAG5) -> str:
    """Seasonal model of the series in `src`: ad, cel, qm, wm, tot."""
    return (
        LEVEL.replace("FROM sr ", f"FROM {src} ")
        + ROLLED
        + f""", ad AS (
  SELECT product_id, week_end, quarter(week_end) AS q, (week(week_end) - 1) % 13 + 1 AS w, n,
         row_number() OVER (PARTITION BY product_id ORDER BY week_end DESC) AS k,
         CASE WHEN {flag} THEN {rolled('2.0')} WHEN cv > 0.5 THEN {rolled()} ELSE {capped()} END AS v FROM ro),
ul AS (SELECT product_id, demand IS NOT NULL AND """
        + " AND ".join(
            f"(count(*) OVER p <= {k} OR lag(demand, {k}) OVER (PARTITION BY product_id ORDER BY week_end) IS NOT NULL)"
            for k in (1, 2, 4, 13, 52)
        )
        + f""" AS ok FROM {src} WINDOW p AS (PARTITION BY product_id)),
us AS (SELECT product_id, bool_or(ok) AS usable FROM ul GROUP BY 1),
cel AS (SELECT product_id, q, w, avg(v) AS m FROM ad GROUP BY 1, 2, 3),
qm AS (SELECT product_id, q, avg(v) AS m FROM ad GROUP BY 1, 2),
wm AS (SELECT product_id, w, avg(v) AS m FROM ad GROUP BY 1, 2),
yq AS (SELECT product_id, date_trunc('quarter', week_end) AS yq, avg(v) AS m FROM ad GROUP BY 1, 2),
yr AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY yq DESC) AS age, least(8, count(*) OVER (PARTITION BY product_id)) AS used FROM yq),
wt AS (SELECT product_id, CASE WHEN count(*) = count(m) THEN sum(exp(-2.0 * (age - 1) / greatest(used - 1, 1)) * m) / sum(exp(-2.0 * (age - 1) / greatest(used - 1, 1))) END AS lvl FROM yr WHERE age <= used GROUP BY 1),
tot AS (SELECT product_id, avg(v) AS overall,
          CASE WHEN NOT avg(v) > 0 THEN 1 WHEN {flag} THEN any_value(lvl) / avg(v) WHEN max(n) >= 26 THEN avg(v) FILTER (k <= 26) / avg(v) ELSE 1 END AS trend
        FROM ad JOIN wt USING (product_id) GROUP BY product_id),
tou AS (SELECT tot.*, usable FROM tot JOIN us USING (product_id))"""
    )


def seasonal_predict(targets: str) -> str:
    """CTE `pr` with column `fc` for the rows (product_id, week_end, ...) of `targets`."""
    return f""", pr AS (
  SELECT t.*, CASE WHEN usable THEN greatest(coalesce(trend * CASE WHEN cel.product_id IS NOT NULL THEN cel.m
      ELSE overall * CASE WHEN qm.product_id IS NULL OR NOT overall > 0 THEN 1 ELSE qm.m / overall END
                   * CASE WHEN wm.product_id IS NULL OR NOT overall > 0 THEN 1 ELSE wm.m / overall END END, 0), 0) ELSE 0 END AS fc
  FROM {targets} t JOIN tou USING (product_id)
  LEFT JOIN cel ON cel.product_id = t.product_id AND cel.q = quarter(t.week_end) AND cel.w = (week(t.week_end) - 1) % 13 + 1
  LEFT JOIN qm ON qm.product_id = t.product_id AND qm.q = quarter(t.week_end)
  LEFT JOIN wm ON wm.product_id = t.product_id AND wm.w = (week(t.week_end) - 1) % 13 + 1)"""


def future(h: int, src: str = "sr") -> str:
    return f""", fu AS (SELECT product_id, last + CAST(7 * step AS INTEGER) AS week_end, step FROM (
  SELECT product_id, max(week_end) AS last, unnest(generate_series(1, {h})) AS step FROM {src} GROUP BY 1))"""


SPLIT = """, tr AS (SELECT product_id, week_end, demand FROM srn WHERE rk > 13 AND n > 13),
te AS (SELECT product_id, week_end, demand AS actual, 14 - rk AS step, n AS all_rows FROM srn WHERE rk <= 13 AND n > 13)"""

METRICS = f"""{r('avg(abs(actual - fc))')} AS mae, {r('sqrt(avg((actual - fc) * (actual - fc)))')} AS rmse,
  {r('avg(abs((actual - fc) / nullif(actual, 0))) * 100')} AS mape, {r('avg((actual - fc) / nullif(actual, 0)) * 100')} AS mpe"""


def smoothing_ctes(src: str, targets: str, grid: str) -> str:
    """CTE `pr`: every grid point (grid_idx, n_recent, alpha, spike) for every target row."""
    return f""", g AS ({grid}),
ob AS (SELECT product_id, week_end, demand, row_number() OVER (PARTITION BY product_id ORDER BY week_end) AS pos,
         row_number() OVER (PARTITION BY product_id ORDER BY week_end DESC) AS k, count(*) OVER (PARTITION BY product_id) AS n,
         quantile_cont(demand, 0.5) OVER (PARTITION BY product_id) AS med FROM {src} WHERE demand IS NOT NULL),
om AS (SELECT *, quantile_cont(abs(demand - med), 0.5) OVER (PARTITION BY product_id) AS mad FROM ob),
ax AS (SELECT om.*, s.spike, CASE WHEN n >= 12 AND mad > 0 AND 3 * abs(demand - med) / mad > s.spike THEN med + s.spike * mad * 3 ELSE demand END AS v
       FROM om CROSS JOIN (SELECT DISTINCT spike FROM g) s),
st AS (SELECT product_id, spike, max(n) AS n, avg(v) FILTER (pos <= n // 2) AS f, avg(v) FILTER (pos > n // 2) AS s, quantile_cont(v, 0.5) AS omed,
         max(v) FILTER (k = 1) AS last, quantile_cont(v, 0.5) FILTER (k BETWEEN 2 AND 4) AS pm FROM ax GROUP BY 1, 2),
sx AS (SELECT *, CASE WHEN n >= 12 AND (s - f) / nullif(f, 0) * 100 > 20 THEN 'up' WHEN n >= 12 AND (s - f) / nullif(f, 0) * 100 < -20 THEN 'down' ELSE 'none' END AS trend FROM st),
wmd AS (SELECT product_id, spike, week(week_end) AS w, quantile_cont(v, 0.5) AS m FROM ax GROUP BY 1, 2, 3),
fr AS (SELECT x.product_id, x.spike, x.w, x.n, x.omed, least(greatest(coalesce(m, omed) / nullif(omed, 0), 0.6), 1.8) AS f
       FROM (SELECT *, unnest(generate_series(1, 53)) AS w FROM sx) x LEFT JOIN wmd ON wmd.product_id = x.product_id AND wmd.spike = x.spike AND wmd.w = x.w),
fa AS (SELECT product_id, spike, w, CASE WHEN n < 104 OR omed = 0 THEN 1 ELSE f * 53 / sum(f) OVER (PARTITION BY product_id, spike) END AS f FROM fr),
gp AS (SELECT sx.*, grid_idx, n_recent, alpha, CASE trend WHEN 'down' THEN least(n_recent, 13) WHEN 'up' THEN least(n_recent, 52) ELSE n_recent END AS ne,
         CASE trend WHEN 'down' THEN 0.8 WHEN 'up' THEN 0.6 ELSE alpha END AS ae FROM sx JOIN g USING (spike)),
lv AS (SELECT gp.product_id, gp.grid_idx, sum(exp(-1.5 * (k - 1) / greatest(least(ne, gp.n) - 1, 1)) * v) / sum(exp(-1.5 * (k - 1) / greatest(least(ne, gp.n) - 1, 1))) AS lvl
       FROM gp JOIN ax ON ax.product_id = gp.product_id AND ax.spike = gp.spike AND ax.k <= least(ne, gp.n) GROUP BY 1, 2),
bl AS (SELECT t.*, gp.grid_idx, gp.n_recent, gp.alpha, gp.spike, fa.f, gp.pm, gp.last > gp.pm * (1 + gp.spike / 5) AS spiked,
         CASE WHEN ly.demand IS NULL THEN lvl * fa.f ELSE ae * lvl * fa.f + (1 - ae) * ly.demand END AS b
       FROM {targets} t JOIN gp ON gp.product_id = t.product_id JOIN lv ON lv.product_id = gp.product_id AND lv.grid_idx = gp.grid_idx
       JOIN fa ON fa.product_id = gp.product_id AND fa.spike = gp.spike AND fa.w = week(t.week_end)
       LEFT JOIN ob ly ON ly.product_id = t.product_id AND ly.week_end = t.week_end - 364),
pr AS (SELECT *, greatest(CASE WHEN spiked AND step <= 2 AND pm IS NOT NULL THEN b * 0.4 + pm * f * 0.6 ELSE b END, 0) AS fc FROM bl)"""


ONE_POINT = "SELECT 0 AS grid_idx, 26 AS n_recent, CAST(0.6 AS DOUBLE) AS alpha, CAST(2.5 AS DOUBLE) AS spike"
ALL_POINTS = """SELECT (row_number() OVER (ORDER BY n_recent, alpha, spike)) - 1 AS grid_idx, * FROM
  (SELECT unnest([13, 26, 52]) AS n_recent) CROSS JOIN (SELECT unnest([0.4::DOUBLE, 0.6, 0.8]) AS alpha) CROSS JOIN (SELECT unnest([2.0::DOUBLE, 2.5, 3.0]) AS spike)"""

CAPACITY = SR + ", cs AS (SELECT product_id, week_end, demand * 5 AS demand FROM sr)"
SMALL_CAPACITY = SRN + ", cs AS (SELECT product_id, week_end, demand * 5 AS demand, rk, n FROM srn)"


def boundary_ctes(src: str, targets: str) -> str:
    return (
        LEVEL.replace("FROM sr ", f"FROM {src} ")
        + f""", bc AS (SELECT product_id, week_end, CASE WHEN n >= 12 AND mad > 1e-6 AND demand IS NOT NULL
    THEN least(greatest(demand, med - 2.5 * 1.4826 * mad), med + 2.5 * 1.4826 * mad) ELSE demand END AS v FROM ls),
bm AS (SELECT product_id, avg(v) AS level, stddev_pop(v) AS sp, count(v) AS o FROM bc GROUP BY 1),
bq AS (SELECT product_id, quarter(week_end) AS q, avg(v) AS m FROM bc GROUP BY 1, 2),
bp AS (SELECT t.*, level, sp, o, level * CASE WHEN level > 1e-6 THEN coalesce(bq.m / level, 1) ELSE 1 END AS x
       FROM {targets} t JOIN bm USING (product_id) LEFT JOIN bq ON bq.product_id = t.product_id AND bq.q = quarter(t.week_end)),
pr AS (SELECT *, greatest(coalesce(CASE WHEN o < 5 THEN level WHEN o >= 2 AND sp >= 1e-6
    THEN level + (x - level) * (1 - 0.3 * tanh(abs((x - level) / sp) / 2)) ELSE x END, 0), 0) AS fc FROM bp)"""
    )


PLAN = PI + plan_ctes("pi", "cp")
NARROW = "900000 - 200000 < max(b) OVER (PARTITION BY product_id, quarter) * 5"

RESCUE = (
    PLAN
    + """, pri AS (SELECT *, CAST(split_part(product_id, '#', 2) AS INTEGER) AS pr FROM cp),
p2 AS (SELECT a.product_id, a.quarter, a.qi, a.week_seq, a.week_label, a.b, a.cap + coalesce(d.cap - d.wafers, 0) AS cap, a.safety_stock, a.demand, a.opening
       FROM pri a LEFT JOIN pri d ON d.pr = a.pr - 1 AND d.quarter = a.quarter AND d.week_seq = a.week_seq WHERE NOT a.feasible)"""
    + plan_ctes("p2", "c2")
)

E2E = (
    QU
    + """, ratio AS (SELECT unnest(generate_series(1, 13)) AS week, unnest([0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.06, 0.1, 0.1, 0.15, 0.15]) AS ratio),
wd AS (SELECT product_id, qi, make_date(qi // 4, (qi % 4) * 3 + 1, 1) + CAST(7 * (week - 1) AS INTEGER) AS d, demand * CAST(ratio AS DOUBLE) AS v FROM qs CROSS JOIN ratio WHERE demand <> 0),
wl AS (SELECT product_id, d + CAST(7 - isodow(d) AS INTEGER) AS week_end, v FROM wd
       QUALIFY row_number() OVER (PARTITION BY product_id, d + CAST(7 - isodow(d) AS INTEGER) ORDER BY wd.d DESC, qi DESC, v DESC) = 1),
gg AS (SELECT product_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM wl GROUP BY 1),
e0 AS (SELECT gg.product_id, gg.week_end, wl.v AS demand FROM gg LEFT JOIN wl USING (product_id, week_end))"""
)

QUERIES = {
    "quarterly_to_forecast": (
        quarterly_to_forecast,
        f"WITH {E2E}{seasonal_ctes('e0')}{future(13, 'e0')}{seasonal_predict('fu')} SELECT {KEY}, {big('step')} AS step, {r('fc', 2)} AS forecast FROM pr",
    ),
    "seasonal_forecast": (
        seasonal_forecast,
        f"WITH {SR}{seasonal_ctes('sr')}{future(26)}{seasonal_predict('fu')} SELECT {KEY}, {big('step')} AS step, {r('fc')} AS forecast FROM pr",
    ),
    "smoothing_forecast": (
        smoothing_forecast,
        f"WITH {SR}{future(60)}{smoothing_ctes('sr', 'fu', ONE_POINT)} SELECT {KEY}, {big('step')} AS step, {r('fc')} AS forecast FROM pr",
    ),
    "bi_export": (
        bi_export,
        f"""WITH {SR}{seasonal_ctes('sr')}{future(13)}{seasonal_predict('fu')}
SELECT product_id, {day()} AS period, 'Histórico' AS kind, {r('demand')} AS demand FROM sr
UNION ALL SELECT product_id, 'F' || step, 'Pronóstico', {r('fc')} FROM pr""",
    ),
    "quarter_buckets": (
        quarter_buckets,
        f"""WITH {SR}{seasonal_ctes('sr')}{future(26)}{seasonal_predict('fu')}
SELECT product_id, {big('(step - 1) // 13 + 1')} AS bucket, {r('sum(fc)')} AS demand FROM pr GROUP BY 1, 2""",
    ),
    "net_balance": (
        net_balance,
        f"""WITH {QU}{', grid' + SR.split(', grid')[1]}{seasonal_ctes('sr')}{future(13)}{seasonal_predict('fu')},
f AS (SELECT product_id, sum(fc) AS dem FROM pr GROUP BY 1)
SELECT product_id, {r('min(units) + max(units) - max(dem) - avg(wos)')} AS net FROM qs JOIN f USING (product_id) GROUP BY 1""",
    ),
    "gbt_forecast": (gbt_forecast, None),
    "boundary_forecast": (boundary_forecast, None),
    "backtest_gbt": (backtest_gbt, None),
    "gbt_grid_search": (gbt_grid_search, None),
    "backtest_boundary_trees": (backtest_boundary_trees, None),
    "boundary_baseline": (
        boundary_baseline,
        f"WITH {CAPACITY}{future(26)}{boundary_ctes('cs', 'fu')} SELECT {KEY}, {big('step')} AS step, {r('fc')} AS forecast FROM pr",
    ),
    "boundary_combine": (
        boundary_combine,
        f"""WITH {CAPACITY}{future(13)}{boundary_ctes('cs', 'fu')} SELECT {KEY}, FALSE AS is_forecast, {big('floor(greatest(coalesce(demand, 0), 0))')} AS capacity FROM cs
UNION ALL SELECT product_id, {day()}, TRUE, {big('floor(fc)')} FROM pr""",
    ),
    "backtest_boundary": (
        backtest_boundary,
        f"""WITH {SMALL_CAPACITY}, ct AS (SELECT product_id, week_end, demand FROM cs WHERE rk > 4), ce AS (SELECT product_id, week_end, demand AS actual FROM cs WHERE rk <= 4){boundary_ctes('ct', 'ce')}
SELECT product_id, {METRICS} FROM pr GROUP BY 1""",
    ),
    "backtest_seasonal": (
        backtest_seasonal,
        f"WITH {SRN}{SPLIT}{seasonal_ctes('tr', 'FALSE')}{seasonal_predict('te')} SELECT product_id, {METRICS} FROM pr GROUP BY 1",
    ),
    "backtest_smoothing": (
        backtest_smoothing,
        f"WITH {SRN}{SPLIT}{smoothing_ctes('tr', 'te', ONE_POINT)} SELECT product_id, {METRICS} FROM pr GROUP BY 1",
    ),
    "grid_search": (
        grid_search,
        f"""WITH {SRN}{SPLIT}{smoothing_ctes('tr', 'te', ALL_POINTS)}, sc AS (
  SELECT product_id, grid_idx, n_recent, alpha, spike, avg(abs((actual - fc) / nullif(actual, 0))) * 100 AS mape FROM pr WHERE n_recent < all_rows - 13 GROUP BY 1, 2, 3, 4, 5)
SELECT product_id, {big('n_recent')} AS n_recent, {r('alpha')} AS alpha, {r('spike')} AS spike, {r('mape')} AS mape FROM sc
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sc.mape, grid_idx) = 1""",
    ),
    "format_results": (
        format_results,
        f"""WITH {SRN}{seasonal_ctes('sr')}{future(13)}{seasonal_predict('fu')}
SELECT product_id, string_agg(CAST(CAST(round(fc * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY step) AS forecast,
  string_agg({day()}, ',' ORDER BY step) AS forecast_dates, 'spike=2.5' AS parameters, any_value(mape) AS mape FROM pr JOIN (
  WITH {SRN}{SPLIT}{seasonal_ctes('tr', 'FALSE')}{seasonal_predict('te')} SELECT product_id, {r('avg(abs((actual - fc) / nullif(actual, 0))) * 100')} AS mape FROM pr GROUP BY 1) USING (product_id) GROUP BY 1""",
    ),
    "capacity_plan": (
        capacity_plan,
        f"WITH {PLAN} SELECT product_id, quarter, {big('week_seq')} AS week_seq, week_label, {r('wafers')} AS wafers, feasible, {NARROW} AS band_too_narrow FROM cp",
    ),
    "plan_kpis": (
        plan_kpis,
        f"""WITH {PLAN} SELECT product_id, quarter, {r('sum(wafers * b)', 1)} AS yielded_supply, {r('sum(wafers * b) + max(opening) - max(demand)', 1)} AS tpib,
  {r('sum(wafers * b) + max(opening) - max(demand) - max(safety_stock)', 1)} AS ibesst FROM cp GROUP BY 1, 2""",
    ),
    "plan_to_facts": (
        plan_to_facts,
        f"""WITH {PLAN}, kp AS (SELECT product_id, quarter, sum(wafers * b) AS s, sum(wafers * b) + max(opening) - max(demand) AS t, max(safety_stock) AS st FROM cp GROUP BY 1, 2),
fresh AS (SELECT product_id, 'Yielded Supply' AS attribute, quarter, s AS value FROM kp
  UNION ALL SELECT product_id, 'Total Projected Inventory Balance', quarter, t FROM kp
  UNION ALL SELECT product_id, 'Inventory Balance in excess of SST', quarter, t - st FROM kp)
SELECT product_id, attribute, quarter, {r('coalesce(n.value, o.value)', 1)} AS value
FROM facts o FULL OUTER JOIN fresh n USING (product_id, attribute, quarter)""",
    ),
    "forecast_to_facts": (
        forecast_to_facts,
        f"""WITH {FACTS}{', grid' + SR.split(', grid')[1]}{seasonal_ctes('sr')}{future(26)}{seasonal_predict('fu')},
fb AS (SELECT product_id, (step - 1) // 13 + 1 AS bucket, sum(fc * 3400.0) AS dem FROM pr GROUP BY 1, 2),
la AS (SELECT product_id, max(qi) AS lqi, arg_max(demand, qi) AS dem, any_value(wos) AS wos FROM qs GROUP BY 1),
nq AS (SELECT product_id, 0 AS bucket, lqi AS qi, dem, wos FROM la
  UNION ALL SELECT product_id, fb.bucket, lqi + fb.bucket, fb.dem, wos FROM fb JOIN la USING (product_id)),
ns AS (SELECT *, 'Q' || (qi % 4 + 1) || ' ' || lpad(CAST((qi // 4) % 100 AS VARCHAR), 2, '0') AS quarter,
         coalesce(lead(dem) OVER (PARTITION BY product_id ORDER BY qi), dem) / 13 * wos AS stock FROM nq),
fresh AS (SELECT product_id, 'EffectiveDemand' AS attribute, quarter, dem AS value FROM ns WHERE bucket > 0
  UNION ALL SELECT product_id, 'Safety Stock Target (WOS)', quarter, wos FROM ns WHERE bucket > 0
  UNION ALL SELECT product_id, 'Safety Stock Target', quarter, stock FROM ns)
SELECT product_id, attribute, quarter, {r('coalesce(n.value, o.value)', 1)} AS value
FROM facts o FULL OUTER JOIN fresh n USING (product_id, attribute, quarter)""",
    ),
    "rescue_plan": (
        rescue_plan,
        f"""WITH {RESCUE} SELECT product_id, quarter, {big('week_seq')} AS week_seq, {r('wafers')} AS wafers, feasible, FALSE AS rescued FROM cp WHERE feasible
UNION ALL SELECT product_id, quarter, {big('week_seq')}, {r('wafers')}, feasible, feasible FROM c2""",
    ),
    "roll_plan": (roll_plan, None),
    "limits_plan": (limits_plan, None),
    "production_plan": (production_plan, None),
}

QUERIES["stored_forecast"] = (stored_forecast, QUERIES["seasonal_forecast"][1])
