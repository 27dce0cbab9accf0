"""Lookups, aggregates, windows, outliers and inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import views as V
from contract.sql_parts import FACTS, PI, QU, SR, SRN, WQ, big, day, r
from contract.views import publish
from demandflow.functions.numeric import blend_weight, boundary_blend_weight, shrink_to_mean
from demandflow.operators import inventory, lookups, outliers, stats, windows
from demandflow.operators import series as S
from demandflow.plans import capacity as C
from demandflow.sources import writers

KEY = f"product_id, {day()} AS week_end"


def fact_lookup(spark, d):
    table = V.facts(spark, d)
    asked = table.where((F.col("quarter_num") == 1) & F.col("attribute").endswith("Target")).select(
        "product_id", "attribute", F.explode(F.array("quarter", F.lower("quarter"))).alias("quarter")
    )
    return publish(lookups.fact_lookup(table, asked), 1)


def prev_balance(spark, d):
    table = V.facts(spark, d).where((F.col("year") * 4 + F.col("quarter_num")) % 5 != 0)
    by_quarter = lookups.facts_by_quarter(table, ["balance"])
    return publish(lookups.previous_quarter_balance(by_quarter), 1)


def asof_last_year(spark, d):
    daily = V.shipments(spark, d).groupBy("product_id", F.col("ship_date").alias("obs_date")).agg(
        F.sum("l_quantity").alias("value")
    )
    asked = S.tail_k(V.series(spark, d), 52).select("product_id", F.col("week_end").alias("request_date"))
    return publish(lookups.asof_last_year(daily, asked))


def donor_leftover(spark, d):
    weeks = V.capacity(V.weekly_quarters(spark, d)).withColumn("priority", V.brand_number())
    plans = weeks.withColumn("wafers", F.floor(F.col("capacity") * 0.8 / 5) * 5.0)
    out = lookups.donor_leftover(plans)
    return publish(out.select("product_id", "quarter", "week_seq", "leftover", "raised_capacity"))


def yield_x_capacity(spark, d):
    weeks = V.weekly_quarters(spark, d)
    return publish(lookups.yield_x_capacity(V.yields(weeks), V.capacity(weeks)), 2, yield_value=9)


def plan_inputs(spark, d):
    return publish(V.planning(spark, d), 2, bytes_per_wafer=6)


def yielded_supply(spark, d):
    return publish(C.yielded_supply(V.planning(spark, d).withColumn("wafers", F.col("capacity"))), 1)


def product_stats(spark, d):
    return publish(stats.product_stats(V.series(spark, d)))


def _keyed(df):
    """Missing grouping keys read `all`."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("quarter_num", "week_of_quarter")})


def seasonal_means(spark, d):
    return publish(_keyed(stats.seasonal_means(V.series(spark, d))))


def seasonal_factors(spark, d):
    return publish(_keyed(stats.seasonal_factors(stats.seasonal_means(V.series(spark, d)))), 6)


def trend_factor(spark, d):
    return publish(stats.trend_factor(V.series(spark, d)), 6)


def weighted_trend(spark, d):
    return publish(stats.weighted_quarter_trend(V.series(spark, d)), 6)


def forecast_accuracy(spark, d):
    pairs = V.series(spark, d).select(
        "product_id", F.col("demand").alias("actual"), F.lag("demand", 52).over(S.in_time()).alias("predicted")
    )
    return publish(stats.forecast_accuracy(pairs, "product_id"))


def median_mad_cv(spark, d):
    return publish(outliers.median_mad_cv(V.event_series(spark, d)))


def weekly_factors(spark, d):
    return publish(stats.weekly_seasonal_factors(V.series(spark, d)), 6)


def detect_trend(spark, d):
    return publish(stats.detect_trend(V.series(spark, d)))


def exp_weighted_recent(spark, d):
    return publish(stats.exp_weighted_recent(V.series(spark, d), 26))


def boundary_seasonality(spark, d):
    return publish(stats.boundary_seasonality(V.series(spark, d)), 6)


def best_params(spark, d):
    lags = (1, 13, 26, 52)
    wide = V.series(spark, d).withColumns({f"p{k}": F.lag("demand", k).over(S.in_time()) for k in lags})
    tried = F.array(
        *[F.struct(F.lit(i).alias("grid_idx"), F.lit(k).alias("params"), F.col(f"p{k}").alias("predicted")) for i, k in enumerate(lags)]
    )
    pairs = wide.select("product_id", F.col("demand").alias("actual"), F.inline(tried))
    return publish(stats.best_params(stats.forecast_accuracy(pairs, "product_id", "grid_idx", "params")))


def standardize(spark, d):
    line = V.series(spark, d).withColumns(windows.lag_columns((1, 13)))
    return publish(windows.standardize(line, ["demand", "lag_1", "lag_13"]), 6)


def weekly_features(spark, d):
    return publish(windows.weekly_features(V.series(spark, d)), 6)


def boundary_features(spark, d):
    return publish(windows.boundary_features(V.series(spark, d)), 6)


def rolling_median(spark, d):
    line = V.series(spark, d)
    return publish(line.withColumns({f"median_{k}": windows.rolling_median(k) for k in (4, 8)}))


def rolling_std(spark, d):
    line = V.series(spark, d)
    return publish(line.withColumns({f"std_{k}": windows.rolling_std(k) for k in (4, 8)}), 6)


def ewm_features(spark, d):
    line = windows.with_ewm(V.series(spark, d))
    return publish(line.withColumn("volatility", windows.volatility(F.col("ewm_mean"), F.col("ewm_std"))), 6)


def outliers_rolling(spark, d):
    return publish(outliers.outliers_rolling(V.series(spark, d)))


def outliers_cap(spark, d):
    return publish(outliers.outliers_cap(V.series(spark, d)))


def outliers_clip(spark, d):
    return publish(outliers.outliers_clip(V.series(spark, d), 1.5))


def outliers_auto(spark, d):
    flagged = V.brand_number() % 5 == 0
    return publish(outliers.outliers_auto(V.series(spark, d), flagged), 6)


def safety_stock(spark, d):
    units = V.quarter_units(spark, d)
    by_quarter = units.withColumn("demand", F.col("units") * V.DEMAND_PER_UNIT).drop("wos")
    wos = V.table(spark, d, "part").select(F.col("p_brand").alias("product_id")).distinct().withColumn("wos", V.brand_wos())
    out = inventory.safety_stock(inventory.wos_lookup(by_quarter, wos))
    return publish(out.select("product_id", "quarter", "demand", "wos", "safety_stock"), 2)


def inventory_balance(spark, d):
    q = V.quarters(spark, d).drop("balance")
    first = F.first("demand").over(V.Window.partitionBy("product_id").orderBy("quarter_index"))
    out = inventory.inventory_balance(q.withColumn("opening", first * 0.05))
    return publish(out.select("product_id", "quarter", "balance", "excess"), 1)


def recent_spike(spark, d):
    return publish(windows.recent_spike(V.series(spark, d), 0.5))


def ramp_envelope(spark, d):
    weeks = V.capacity(V.weekly_quarters(spark, d)).select("product_id", "quarter", "week_seq", "capacity")
    return publish(windows.ramp_envelope(weeks, max_decrease=300.0))


def blend_weights(spark, d):
    years = V.series(spark, d).groupBy("product_id", F.year("week_end").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), (F.stddev_samp("demand") / F.avg("demand")).alias("cv")
    )
    steps = years.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(12))))
    step, rows = F.col("step"), F.col("rows")
    return publish(
        steps.select(
            "product_id",
            "year",
            "step",
            blend_weight(step, rows, F.col("cv"), V.brand_number() % 5 == 0).alias("weight"),
            boundary_blend_weight(step, rows - 27).alias("boundary_weight"),
        )
    )


def shrink(spark, d):
    whole = S.by_product()
    line = V.series(spark, d).withColumns(
        {"mean": F.avg("demand").over(whole), "std": F.stddev_pop("demand").over(whole), "n": F.count("demand").over(whole)}
    )
    out = shrink_to_mean(F.col("demand"), F.col("mean"), F.col("std"), F.col("n"), 0.3)
    return publish(line.select("product_id", "week_end", out.alias("value")))


WEEK_MED = "quantile_cont(demand, 0.5) OVER (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN {a} AND {b})"


def _med(a: str, b: str = "CURRENT ROW") -> str:
    return WEEK_MED.format(a=a, b=b)


EWM = """, em AS (
  SELECT a.product_id, a.week_end, sum(pow(7.0/9.0, a.pos - b.pos) * b.demand) / sum(pow(7.0/9.0, a.pos - b.pos)) AS mean,
         sum(pow(7.0/9.0, a.pos - b.pos)) AS sw, sum(pow(7.0/9.0, 2 * (a.pos - b.pos))) AS sw2, count(*) AS m, a.pos
  FROM srn a JOIN srn b ON a.product_id = b.product_id AND b.pos <= a.pos AND b.demand IS NOT NULL GROUP BY ALL),
ew AS (
  SELECT em.product_id, em.week_end, any_value(mean) AS ewm_mean, any_value(m) AS m,
         CASE WHEN any_value(m) >= 2 THEN sqrt(sum(pow(7.0/9.0, em.pos - b.pos) * (b.demand - mean) * (b.demand - mean)) * any_value(sw / (sw * sw - sw2))) END AS ewm_std
  FROM em JOIN srn b ON em.product_id = b.product_id AND b.pos <= em.pos AND b.demand IS NOT NULL GROUP BY 1, 2)"""

VOLATILITY = "least(greatest(coalesce(ewm_std / nullif(ewm_mean, 0), 0), 0), 2)"

LEVEL = """, lm AS (SELECT *, count(*) OVER p AS n, count(demand) OVER p AS obs, quantile_cont(demand, 0.5) OVER p AS med,
    CASE WHEN avg(demand) OVER p > 0 THEN stddev_samp(demand) OVER p / avg(demand) OVER p ELSE 0 END AS cv FROM sr WINDOW p AS (PARTITION BY product_id)),
ls AS (SELECT *, quantile_cont(abs(demand - med), 0.5) OVER (PARTITION BY product_id) AS mad FROM lm)"""

ROLLED = """, r1 AS (SELECT *, CASE WHEN count(demand) OVER c >= 2 THEN quantile_cont(demand, 0.5) OVER c END AS m0 FROM ls
    WINDOW c AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r2 AS (SELECT *, coalesce(last_value(m0 IGNORE NULLS) OVER b, first_value(m0 IGNORE NULLS) OVER f) AS rm FROM r1
    WINDOW b AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r3 AS (SELECT *, CASE WHEN count(demand) OVER c >= 2 THEN quantile_cont(abs(demand - rm), 0.5) OVER c END AS d0 FROM r2
    WINDOW c AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r4 AS (SELECT *, coalesce(last_value(d0 IGNORE NULLS) OVER b, first_value(d0 IGNORE NULLS) OVER f) AS rd FROM r3
    WINDOW b AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           f AS (PARTITION BY product_id ORDER BY week_end ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ro AS (SELECT *, min(rd) OVER (PARTITION BY product_id) AS least_mad FROM r4)"""


def capped(t: str = "2.5") -> str:
    return f"CASE WHEN n >= 12 AND obs = n AND mad > 0 AND 3 * abs(demand - med) / mad > {t} THEN med + {t} * mad * 3 ELSE demand END"


def rolled(t: str = "2.5") -> str:
    return f"CASE WHEN n >= 12 AND least_mad > 0 AND 0.6745 * abs(demand - rm) / rd > {t} THEN rm + {t} * rd * sign(demand - rm) ELSE demand END"


FLAG5 = "CAST(split_part(product_id, '#', 2) AS INTEGER) % 5 = 0"

FEATURES = f"""{KEY}, {r('demand', 6)} AS demand, {big('n')} AS rows,
  {r('lag(demand, 1) OVER w', 6)} AS lag_1, {r('lag(demand, 2) OVER w', 6)} AS lag_2, {r('lag(demand, 4) OVER w', 6)} AS lag_4,
  {r('lag(demand, 13) OVER w', 6)} AS lag_13, {r('lag(demand, 52) OVER w', 6)} AS lag_52,
  {r('least(greatest(coalesce(demand / nullif(lag(demand, 13) OVER w, 0), 1), 0.1), 10)', 6)} AS q_q_change,
  {r(_med('3 PRECEDING'), 6)} AS rolling_median_4,
  {big('CASE WHEN ' + _med('3 PRECEDING') + ' > ' + _med('7 PRECEDING', '4 PRECEDING') + ' THEN 1 ELSE 0 END')} AS direction,
  {r('ewm_mean', 6)} AS ewm_mean, {r('ewm_std', 6)} AS ewm_std, {r(VOLATILITY, 6)} AS volatility,
  {big('quarter(week_end)')} AS quarter, {big('month(week_end)')} AS month, {big('week(week_end)')} AS week, {big('(week(week_end) - 1) % 13 + 1')} AS week_of_quarter,
  {big('CASE WHEN (week(week_end) - 1) % 13 + 1 IN (12, 13) THEN 1 ELSE 0 END')} AS is_quarter_end, {big('year(week_end)')} AS year,
  {big('quarter(week_end) * ((week(week_end) - 1) % 13 + 1)')} AS quarter_week_interaction, {big('quarter(week_end) * quarter(week_end)')} AS quarter_squared"""

SEASON = ", sq AS (SELECT *, quarter(week_end) AS quarter_num, (week(week_end) - 1) % 13 + 1 AS week_of_quarter FROM sr)"
MEANS = SEASON + """, mn AS (
  SELECT product_id, quarter_num, week_of_quarter, avg(demand) AS mean,
         CASE GROUPING(quarter_num, week_of_quarter) WHEN 3 THEN 'overall' WHEN 1 THEN 'quarter' WHEN 2 THEN 'week' ELSE 'quarter_week' END AS level
  FROM sq GROUP BY GROUPING SETS ((product_id), (product_id, quarter_num), (product_id, week_of_quarter), (product_id, quarter_num, week_of_quarter)))"""

STD = "(PARTITION BY product_id ORDER BY week_end ROWS BETWEEN {a} PRECEDING AND CURRENT ROW)"

QUERIES = {
    "fact_lookup": (
        fact_lookup,
        f"WITH {FACTS} SELECT product_id, attribute, quarter, {r('value', 1)} AS value FROM facts WHERE attribute = 'Safety Stock Target' AND qi % 4 = 0",
    ),
    "prev_balance": (
        prev_balance,
        f"""WITH {QU} SELECT product_id, quarter, {big('qi')} AS quarter_index, {r('balance', 1)} AS balance,
  {r('CASE WHEN lag(qi) OVER w = qi - 1 THEN lag(balance) OVER w END', 1)} AS opening
FROM qs WHERE (qi + 1) % 5 <> 0 WINDOW w AS (PARTITION BY product_id ORDER BY qi)""",
    ),
    "asof_last_year": (
        asof_last_year,
        f"""WITH {SR}, dl AS (SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
rq AS (SELECT product_id, week_end AS q, week_end - 364 AS t FROM sr QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sr.week_end DESC) <= 52)
SELECT rq.product_id, {day('q')} AS request_date, {r('arg_min(v, abs(d - t) * 2 - CASE WHEN d > t THEN 1 ELSE 0 END)')} AS last_year_value, {day('any_value(t)')} AS target_date
FROM rq LEFT JOIN dl ON rq.product_id = dl.product_id AND d BETWEEN t - 3 AND t + 3 GROUP BY rq.product_id, q""",
    ),
    "donor_leftover": (
        donor_leftover,
        f"""WITH {WQ}, p AS (SELECT product_id, CAST(split_part(product_id, '#', 2) AS INTEGER) AS pr, quarter, week_seq, quantity * 5 AS cap, floor(quantity * 5 * 0.8 / 5) * 5 AS w FROM wq)
SELECT a.product_id, a.quarter, {big('a.week_seq')} AS week_seq, {r('coalesce(b.cap - b.w, 0)')} AS leftover, {r('a.cap + coalesce(b.cap - b.w, 0)')} AS raised_capacity
FROM p a LEFT JOIN p b ON b.pr = a.pr - 1 AND b.quarter = a.quarter AND b.week_seq = a.week_seq""",
    ),
    "yield_x_capacity": (
        yield_x_capacity,
        f"WITH {WQ} SELECT product_id, quarter, {big('week_seq')} AS week_seq, {r('1 - discount / lines', 9)} AS yield_value, week_label, {r('quantity * 5', 2)} AS capacity FROM wq",
    ),
    "plan_inputs": (
        plan_inputs,
        f"""WITH {PI} SELECT product_id, quarter, {big('qi')} AS quarter_index, {big('week_seq')} AS week_seq, week_label, {r('b', 6)} AS bytes_per_wafer,
  {r('cap', 2)} AS capacity, {r('safety_stock', 2)} AS safety_stock, {r('demand', 2)} AS demand, {r('opening', 2)} AS opening FROM pi""",
    ),
    "yielded_supply": (
        yielded_supply,
        f"WITH {PI} SELECT product_id, quarter, {r('sum(cap * b)', 1)} AS yielded_supply FROM pi GROUP BY 1, 2",
    ),
    "product_stats": (
        product_stats,
        f"WITH {SR} SELECT product_id, {r('sum(demand)')} AS total, {r('avg(demand)')} AS mean, {big('count(demand)')} AS weeks FROM sr GROUP BY 1",
    ),
    "seasonal_means": (
        seasonal_means,
        f"WITH {SR}{MEANS} SELECT product_id, level, coalesce(CAST(quarter_num AS VARCHAR), 'all') AS quarter_num, coalesce(CAST(week_of_quarter AS VARCHAR), 'all') AS week_of_quarter, {r('mean')} AS mean FROM mn",
    ),
    "seasonal_factors": (
        seasonal_factors,
        f"""WITH {SR}{MEANS}, o AS (SELECT *, max(CASE WHEN level = 'overall' THEN mean END) OVER (PARTITION BY product_id) AS overall FROM mn)
SELECT product_id, level, coalesce(CAST(quarter_num AS VARCHAR), 'all') AS quarter_num, coalesce(CAST(week_of_quarter AS VARCHAR), 'all') AS week_of_quarter,
       {r('CASE WHEN overall > 0 THEN mean / overall ELSE 1 END', 6)} AS factor FROM o WHERE level IN ('quarter', 'week')""",
    ),
    "trend_factor": (
        trend_factor,
        f"""WITH {SRN} SELECT product_id, {r('CASE WHEN count(*) >= 26 AND avg(demand) > 0 THEN avg(demand) FILTER (rk <= 26) / avg(demand) ELSE 1 END', 6)} AS trend FROM srn GROUP BY 1""",
    ),
    "weighted_trend": (
        weighted_trend,
        f"""WITH {SRN}, q AS (SELECT product_id, date_trunc('quarter', week_end) AS qq, avg(demand) AS m FROM srn GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY qq DESC) AS age, least(8, count(*) OVER (PARTITION BY product_id)) AS used FROM q),
w AS (SELECT product_id, CASE WHEN count(*) = count(m) THEN sum(exp(-2.0 * (age - 1) / greatest(used - 1, 1)) * m) / sum(exp(-2.0 * (age - 1) / greatest(used - 1, 1))) END AS level FROM a WHERE age <= used GROUP BY 1)
SELECT product_id, {r('max(level) / avg(demand)', 6)} AS trend FROM srn JOIN w USING (product_id) GROUP BY 1 HAVING count(*) >= 52""",
    ),
    "forecast_accuracy": (
        forecast_accuracy,
        f"""WITH {SR}, p AS (SELECT product_id, demand AS a, lag(demand, 52) OVER (PARTITION BY product_id ORDER BY week_end) AS f FROM sr)
SELECT product_id, {r('avg(abs(a - f))')} AS mae, {r('sqrt(avg((a - f) * (a - f)))')} AS rmse, {r('avg(abs((a - f) / nullif(a, 0))) * 100')} AS mape, {r('avg((a - f) / nullif(a, 0)) * 100')} AS mpe FROM p GROUP BY 1""",
    ),
    "median_mad_cv": (
        median_mad_cv,
        f"""WITH sr AS (SELECT event_type AS product_id, CAST(ts AS DATE) AS week_end, sum(value) AS demand FROM events GROUP BY 1, 2){LEVEL}
SELECT product_id, {r('any_value(med)')} AS median, {r('any_value(mad)')} AS mad, {r('any_value(cv)')} AS cv FROM ls GROUP BY 1""",
    ),
    "weekly_factors": (
        weekly_factors,
        f"""WITH {SR}, o AS (SELECT product_id, count(*) AS n, quantile_cont(demand, 0.5) AS med, unnest(generate_series(1, 53)) AS w FROM sr GROUP BY 1),
m AS (SELECT product_id, week(week_end) AS w, quantile_cont(demand, 0.5) AS v FROM sr GROUP BY 1, 2),
c AS (SELECT o.product_id, o.w, n, med, least(greatest(coalesce(v, med) / med, 0.6), 1.8) AS f FROM o LEFT JOIN m ON o.product_id = m.product_id AND o.w = m.w)
SELECT product_id, {big('w')} AS iso_week, {r('CASE WHEN n < 104 OR med = 0 THEN 1 ELSE f * 53 / sum(f) OVER (PARTITION BY product_id) END', 6)} AS factor FROM c""",
    ),
    "detect_trend": (
        detect_trend,
        f"""WITH {SRN}, h AS (SELECT product_id, max(n) AS n, avg(demand) FILTER (pos <= n // 2) AS f, avg(demand) FILTER (pos > n // 2) AS s FROM srn GROUP BY 1)
SELECT product_id, CASE WHEN n >= 12 AND (s - f) / nullif(f, 0) * 100 > 20 THEN 'up' WHEN n >= 12 AND (s - f) / nullif(f, 0) * 100 < -20 THEN 'down' ELSE 'none' END AS trend FROM h""",
    ),
    "exp_weighted_recent": (
        exp_weighted_recent,
        f"""WITH {SR}, o AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week_end DESC) AS k, least(26, count(*) OVER (PARTITION BY product_id)) AS m FROM sr WHERE demand IS NOT NULL)
SELECT product_id, {r('sum(exp(-1.5 * (k - 1) / greatest(m - 1, 1)) * demand) / sum(exp(-1.5 * (k - 1) / greatest(m - 1, 1)))')} AS level FROM o WHERE k <= m GROUP BY 1""",
    ),
    "boundary_seasonality": (
        boundary_seasonality,
        f"""WITH {SR}, o AS (SELECT *, avg(demand) OVER (PARTITION BY product_id) AS mean FROM sr)
SELECT product_id, {big('quarter(week_end)')} AS quarter_num, {r('any_value(mean)', 6)} AS mean, {r('CASE WHEN any_value(mean) > 1e-6 THEN avg(demand) / any_value(mean) ELSE 1 END', 6)} AS factor FROM o GROUP BY product_id, quarter(week_end)""",
    ),
    "best_params": (
        best_params,
        f"""WITH {SRN}, p AS (SELECT a.product_id, k AS params, i AS grid_idx, avg(abs((a.demand - b.demand) / nullif(a.demand, 0))) * 100 AS mape
  FROM srn a CROSS JOIN (VALUES (0, 1), (1, 13), (2, 26), (3, 52)) g(i, k) LEFT JOIN srn b ON a.product_id = b.product_id AND b.pos = a.pos - k GROUP BY 1, 2, 3)
SELECT product_id, {big('params')} AS params, {r('mape')} AS mape FROM p QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY p.mape, grid_idx) = 1""",
    ),
    "standardize": (
        standardize,
        f"""WITH {SR}, l AS (SELECT *, lag(demand, 1) OVER w AS lag_1, lag(demand, 13) OVER w AS lag_13 FROM sr WINDOW w AS (PARTITION BY product_id ORDER BY week_end))
SELECT {KEY}, """
        + ", ".join(
            r(f"({c} - avg({c}) OVER p) / CASE WHEN stddev_pop({c}) OVER p > 0 THEN stddev_pop({c}) OVER p ELSE 1 END", 6) + f" AS {c}"
            for c in ("demand", "lag_1", "lag_13")
        )
        + " FROM l WINDOW p AS (PARTITION BY product_id)",
    ),
    "weekly_features": (
        weekly_features,
        f"WITH {SRN}{EWM}, j AS (SELECT srn.*, ewm_mean, ewm_std FROM srn LEFT JOIN ew USING (product_id, week_end)) SELECT {FEATURES} FROM j WINDOW w AS (PARTITION BY product_id ORDER BY j.week_end)",
    ),
    "boundary_features": (
        boundary_features,
        f"""WITH {SRN}{EWM}, j AS (SELECT srn.*, ewm_mean, CASE WHEN m >= 4 THEN ewm_std END AS ewm_std FROM srn LEFT JOIN ew USING (product_id, week_end))
SELECT {KEY}, {r('demand', 6)} AS demand, {big('n')} AS rows, """
        + ", ".join(f"{r(f'lag(demand, {k}) OVER w', 6)} AS lag_{k}" for k in (1, 2, 4, 8, 13))
        + ", "
        + ", ".join(
            f"{r(_med(f'{k - 1} PRECEDING'), 6)} AS rolling_median_{k}, round(CASE WHEN count(demand) OVER {STD.format(a=k - 1)} >= {max(2, k // 2)} THEN stddev_samp(demand) OVER {STD.format(a=k - 1)} END, 6) + 0.0 AS rolling_std_{k}"
            for k in (4, 8)
        )
        + f""", {r('ewm_mean', 6)} AS ewm_mean, {r('ewm_std', 6)} AS ewm_std,
  {big('quarter(week_end)')} AS quarter, {big('month(week_end)')} AS month, {big('week(week_end)')} AS week, {big('dayofyear(week_end)')} AS day_of_year,
  {big('day(week_end)')} AS day_of_month, {big('isodow(week_end) - 1')} AS day_of_week, {big('year(week_end)')} AS year
FROM j WINDOW w AS (PARTITION BY product_id ORDER BY j.week_end)""",
    ),
    "rolling_median": (
        rolling_median,
        f"WITH {SR} SELECT {KEY}, {r('demand')} AS demand, {r(_med('3 PRECEDING'))} AS median_4, {r(_med('7 PRECEDING'))} AS median_8 FROM sr",
    ),
    "rolling_std": (
        rolling_std,
        f"""WITH {SR} SELECT {KEY}, {r('demand', 6)} AS demand, {r('CASE WHEN count(demand) OVER a >= 2 THEN stddev_samp(demand) OVER a END', 6)} AS std_4,
  {r('CASE WHEN count(demand) OVER b >= 4 THEN stddev_samp(demand) OVER b END', 6)} AS std_8 FROM sr
WINDOW a AS (PARTITION BY product_id ORDER BY sr.week_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), b AS (PARTITION BY product_id ORDER BY sr.week_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    ),
    "ewm_features": (
        ewm_features,
        f"WITH {SRN}{EWM} SELECT {KEY}, {r('demand', 6)} AS demand, {r('ewm_mean', 6)} AS ewm_mean, {r('ewm_std', 6)} AS ewm_std, {r(VOLATILITY, 6)} AS volatility FROM srn LEFT JOIN ew USING (product_id, week_end)",
    ),
    "outliers_rolling": (
        outliers_rolling,
        f"WITH {SR}{LEVEL}{ROLLED} SELECT {KEY}, {r('demand')} AS demand, {r(rolled())} AS adjusted FROM ro",
    ),
    "outliers_cap": (
        outliers_cap,
        f"WITH {SR}{LEVEL} SELECT {KEY}, {r('demand')} AS demand, {r(capped())} AS adjusted FROM ls",
    ),
    "outliers_clip": (
        outliers_clip,
        f"""WITH {SR}{LEVEL} SELECT {KEY}, {r('demand')} AS demand,
  {r('CASE WHEN n >= 12 AND mad > 1e-6 AND demand IS NOT NULL THEN least(greatest(demand, med - 1.5 * 1.4826 * mad), med + 1.5 * 1.4826 * mad) ELSE demand END')} AS adjusted FROM ls""",
    ),
    "outliers_auto": (
        outliers_auto,
        f"""WITH {SR}{LEVEL}{ROLLED} SELECT {KEY}, {r('demand', 6)} AS demand, {r(f'CASE WHEN coalesce(cv > 0.5, FALSE) OR {FLAG5} THEN {rolled()} ELSE {capped()} END', 6)} AS adjusted, {r('cv', 6)} AS cv FROM ro""",
    ),
    "safety_stock": (
        safety_stock,
        f"WITH {QU} SELECT product_id, quarter, {r('demand', 2)} AS demand, {r('wos', 2)} AS wos, {r('safety_stock', 2)} AS safety_stock FROM qs",
    ),
    "inventory_balance": (
        inventory_balance,
        f"""WITH {QU}, b AS (SELECT *, first_value(demand) OVER w * 0.05 + sum(supply - demand) OVER w AS bal FROM qs WINDOW w AS (PARTITION BY product_id ORDER BY qi ROWS UNBOUNDED PRECEDING))
SELECT product_id, quarter, {r('bal', 1)} AS balance, {r('bal - safety_stock', 1)} AS excess FROM b""",
    ),
    "recent_spike": (
        recent_spike,
        f"""WITH {SR}, k AS (SELECT product_id, demand, row_number() OVER (PARTITION BY product_id ORDER BY week_end DESC) AS k FROM sr WHERE demand IS NOT NULL),
s AS (SELECT product_id, max(demand) FILTER (k = 1) AS last_value, quantile_cont(demand, 0.5) FILTER (k BETWEEN 2 AND 4) AS pm FROM k WHERE k <= 4 GROUP BY 1)
SELECT product_id, {r('last_value')} AS last_value, {r('pm')} AS previous_median, coalesce(last_value > pm * 1.1, FALSE) AS is_spike FROM s""",
    ),
    "ramp_envelope": (
        ramp_envelope,
        f"""WITH {WQ} SELECT product_id, quarter, {big('week_seq')} AS week_seq, {r('quantity * 5')} AS capacity,
  {r('min(quantity * 5 + 300 * week_seq) OVER (PARTITION BY product_id, quarter ORDER BY wq.week_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 300 * week_seq')} AS envelope FROM wq""",
    ),
    "blend_weight": (
        blend_weights,
        f"""WITH {SR}, y AS (SELECT product_id, year(week_end) AS year, count(*) AS n, stddev_samp(demand) / avg(demand) AS cv FROM sr GROUP BY 1, 2),
s AS (SELECT *, unnest(generate_series(0, 12)) AS i FROM y)
SELECT product_id, {big('year')} AS year, {big('i')} AS step,
  {r(f'CASE WHEN cv IS NOT NULL AND (cv > 0.5 OR {FLAG5}) THEN CASE WHEN i > 8 THEN greatest(0.4 - (i - 8) * 0.05, 0.2) ELSE greatest(0.6 - i * 0.1, 0.25) END WHEN n < 52 THEN greatest(0.7 - i * 0.08, 0.3) ELSE greatest(0.8 - i * 0.05, 0.4) END')} AS weight,
  {r('CASE WHEN n - 27 < 26 THEN greatest(0.6 - i * 0.08, 0.2) ELSE greatest(0.8 - i * 0.05, 0.3) END')} AS boundary_weight FROM s""",
    ),
    "shrink_to_mean": (
        shrink,
        f"""WITH {SR}, o AS (SELECT *, avg(demand) OVER p AS mean, stddev_pop(demand) OVER p AS std, count(demand) OVER p AS n FROM sr WINDOW p AS (PARTITION BY product_id))
SELECT {KEY}, {r('CASE WHEN n >= 2 AND std >= 1e-6 THEN mean + (demand - mean) * (1 - 0.3 * tanh(abs((demand - mean) / std) / 2)) ELSE demand END')} AS value FROM o""",
    ),
}
