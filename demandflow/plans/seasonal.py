"""Seasonal demand forecast: quarter-and-week pattern times recent trend.

One shuffle by product carries the whole forecast: outlier windows, seasonal cells, trend and
the per-product model row all keep that partitioning. The model row holds at most 52 cell
means, 4 quarter factors and 13 week factors, whatever the history's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.functions.calendar import week_of_quarter
from demandflow.functions.numeric import ratio, recency_weight, zero_floor
from demandflow.operators.outliers import outliers_auto
from demandflow.operators.series import (
    CARRIED,
    by_product,
    from_end,
    held_out_weeks,
    in_time,
    next_weeks,
    training_rows,
)
from demandflow.operators.stats import RECENT_ROWS, YEAR_ROWS, forecast_accuracy, season_cells
from demandflow.operators.windows import DEMAND_LAGS

SPIKE = 2.5
FLAGGED_SPIKE = 2.0


def _flag(flagged_ids: Sequence[str]) -> Column:
    return F.col("product_id").isin(list(flagged_ids)) if flagged_ids else F.lit(False)


def _with_usable_row(series: DataFrame) -> DataFrame:
    """Mark rows whose value and applicable lags are all known."""
    n = F.col("_rows")
    known = F.col("demand").isNotNull()
    for k in DEMAND_LAGS:
        known = known & ((n <= k) | F.lag("demand", k).over(in_time()).isNotNull())
    return series.withColumn("_rows", F.count(F.lit(1)).over(by_product())).withColumn("_usable", known)


def seasonal_model(
    series: DataFrame,
    flagged_ids: Sequence[str] = (),
    spike: float = SPIKE,
    flagged_spike: float = FLAGGED_SPIKE,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per product: overall mean, trend, cell means, quarter and week means, usable.

    Flagged (volatile) products take their trend from weighted calendar quarters. `carry`
    names columns of the series whose first known value goes along.
    """
    flagged = _flag(flagged_ids)
    threshold = F.when(flagged, flagged_spike).otherwise(F.lit(spike))
    adjusted = outliers_auto(_with_usable_row(series), flagged, threshold)
    quarter = F.trunc("week_end", "quarter")
    by_quarter = W.partitionBy("product_id", "_quarter")
    short = F.least(F.lit(13), F.floor(F.col("_rows") / 2))
    v = F.col("adjusted")
    placed = (
        adjusted.withColumn("_quarter", quarter)
        .withColumns(
            {
                "_rank": F.row_number().over(from_end()),
                "_age": F.dense_rank().over(W.partitionBy("product_id").orderBy(F.col("_quarter").desc())),
                "_q_mean": F.avg(v).over(by_quarter),
                "_q_last": F.max("week_end").over(by_quarter) == F.col("week_end"),
            }
        )
        .withColumn("_quarters", F.max("_age").over(by_product()))
        .withColumns(
            {
                "_used": F.least(F.lit(8), F.col("_quarters")),
                "_short": (F.col("_rank") <= short) | (short == 0),
            }
        )
    )
    # One row of each of the last (up to) eight calendar quarters carries its mean and weight.
    counted = F.col("_q_last") & (F.col("_age") <= F.col("_used"))
    weight = recency_weight(F.col("_age"), F.col("_used"), -2.0)
    recent = F.col("_rank") <= RECENT_ROWS
    cells = season_cells(
        placed,
        "adjusted",
        F.sum(F.when(recent, v)).alias("r_sum"),
        F.count(F.when(recent, v)).alias("r_n"),
        F.sum(F.when(F.col("_short"), v)).alias("s_sum"),
        F.count(F.when(F.col("_short"), v)).alias("s_n"),
        F.sum(F.when(counted, weight * F.col("_q_mean"))).alias("w_sum"),
        F.sum(F.when(counted, weight)).alias("w"),
        F.count_if(counted & F.col("_q_mean").isNull()).alias("w_gaps"),
        F.max("_rows").alias("rows"),
        F.max("_quarters").alias("quarters"),
        F.max("_usable").alias("usable"),
        F.max("week_end").alias("last_week"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )
    by_q = W.partitionBy("product_id", "quarter_num")
    by_w = W.partitionBy("product_id", "week_of_quarter")
    cells = cells.withColumns(
        {
            "_qm": ratio(F.sum("total").over(by_q), F.sum("observations").over(by_q)),
            "_wm": ratio(F.sum("total").over(by_w), F.sum("observations").over(by_w)),
        }
    )
    model = cells.groupBy("product_id").agg(
        ratio(F.sum("total"), F.sum("observations")).alias("overall"),
        F.map_from_entries(
            F.collect_list(
                F.struct(_cell_key(F.col("quarter_num"), F.col("week_of_quarter")), ratio(F.col("total"), F.col("observations")))
            )
        ).alias("cell_means"),
        F.map_from_entries(F.collect_set(F.struct("quarter_num", "_qm"))).alias("quarter_means"),
        F.map_from_entries(F.collect_set(F.struct("week_of_quarter", "_wm"))).alias("week_means"),
        ratio(F.sum("r_sum"), F.sum("r_n")).alias("_recent"),
        ratio(F.sum("s_sum"), F.sum("s_n")).alias("_short_mean"),
        F.when(F.sum("w_gaps") == 0, F.sum("w_sum") / F.sum("w")).alias("_weighted"),
        F.max("rows").alias("rows"),
        F.max("quarters").alias("_quarters"),
        F.max("usable").alias("usable"),
        F.max("last_week").alias("last_week"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )
    overall = F.col("overall")
    flagged_level = F.when((F.col("rows") >= YEAR_ROWS) & (F.col("_quarters") >= 4), F.col("_weighted")).otherwise(
        F.col("_short_mean")
    )
    level = F.when(flagged, flagged_level).when(F.col("rows") >= RECENT_ROWS, F.col("_recent"))
    plain = ~flagged & (F.col("rows") < RECENT_ROWS)
    trend = F.when(plain | ~F.coalesce(overall > 0, F.lit(False)), 1.0).otherwise(level / overall)
    return model.withColumn("trend", trend).select(
        "product_id", "overall", "trend", "cell_means", "quarter_means", "week_means", "rows", "usable",
        "last_week", *carry,
    )


def _cell_key(quarter: Column, week: Column) -> Column:
    return quarter * 100 + week


def seasonal_value(week_end: Column) -> Column:
    """Forecast of a date from the columns of a model row.

    A known quarter-and-week cell gives its mean; else overall mean times quarter factor times
    week factor, an unknown factor counting as 1. Nothing usable, missing or negative gives 0.
    """
    q, w = F.quarter(week_end), week_of_quarter(week_end)
    overall = F.col("overall")

    def factor(means: str, key: Column) -> Column:
        own = F.when(overall > 0, F.try_element_at(F.col(means), key) / overall).otherwise(1.0)
        return F.when(F.map_contains_key(F.col(means), key), own).otherwise(1.0)

    key = _cell_key(q, w)
    base = F.when(F.map_contains_key("cell_means", key), F.try_element_at("cell_means", key)).otherwise(
        overall * factor("quarter_means", q) * factor("week_means", w)
    )
    return F.when(F.col("usable"), zero_floor(base * F.col("trend"))).otherwise(0.0)


def seasonal_forecast(
    series: DataFrame, horizon: int = 13, flagged_ids: Sequence[str] = (), spike: float = SPIKE
) -> DataFrame:
    """product_id, week_end, step, forecast for the `horizon` weeks after each series."""
    ahead = next_weeks(seasonal_model(series, flagged_ids, spike), horizon)
    return ahead.select("product_id", "week_end", "step", seasonal_value(F.col("week_end")).alias("forecast"))


def seasonal_backtest_pairs(series: DataFrame, k: int = 13, spike: float = SPIKE) -> DataFrame:
    """Forecast the last `k` weeks from the ones before: product_id, too_short, week_end, actual,
    predicted. A product with no more than `k` rows gives one row without week."""
    model = seasonal_model(training_rows(series, k), (), spike, carry=CARRIED)
    return held_out_weeks(model).select(
        "product_id", "too_short", "week_end", "actual", seasonal_value(F.col("week_end")).alias("predicted")
    )


def backtest_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy per product of backtest pairs.

    `error` says why a product has none: too short, or no actual value in the test weeks.
    """
    scored = forecast_accuracy(pairs, "product_id", "too_short")
    error = F.when(F.col("too_short"), "Not enough data").when(F.col("mae").isNull(), "No valid actual values")
    return scored.withColumn("error", error).drop("too_short")


def seasonal_backtest(series: DataFrame, k: int = 13, spike: float = SPIKE) -> DataFrame:
    return backtest_metrics(seasonal_backtest_pairs(series, k, spike))


def with_missing_products(forecast: DataFrame, selected: DataFrame, horizon: int) -> DataFrame:
    """Forecast of every selected product; one without history gets zeros and no dates."""
    wanted = selected.select("product_id").distinct().select(
        "product_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    )
    return wanted.join(forecast, ["product_id", "step"], "left").withColumn(
        "forecast", F.coalesce("forecast", F.lit(0.0))
    )


def format_results(forecast: DataFrame, params: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per product: forecast and date arrays in step order, parameters, metrics.

    The arrays hold one entry per horizon week.
    """
    steps = F.array_sort(F.collect_list(F.struct("step", "forecast", "week_end")))
    rows = forecast.groupBy("product_id").agg(steps.alias("_steps"))
    return (
        rows.select(
            "product_id",
            F.transform("_steps", lambda s: s["forecast"]).alias("forecast"),
            F.transform(
                "_steps", lambda s: F.coalesce(F.date_format(s["week_end"], "yyyy-MM-dd"), F.lit("N/A"))
            ).alias("forecast_dates"),
        )
        .join(params, "product_id", "left")
        .join(metrics, "product_id", "left")
    )
