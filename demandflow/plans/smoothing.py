"""Exponentially weighted demand forecast, its backtest and parameter search.

Closed form, no recursion: a level from the recent weeks, a factor per ISO week and the value
a year earlier. Only the outlier threshold changes the cleaned series, so a search over a grid
expands the weekly rows by the distinct thresholds alone; the other parameters are applied to
the one model row per product and threshold.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product as cartesian

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.functions.numeric import median_of, recency_weight, zero_floor
from demandflow.operators.outliers import capped_value, with_level_stats
from demandflow.operators.series import (
    CARRIED,
    by_product,
    held_out_weeks,
    in_time,
    next_weeks,
    training_rows,
)
from demandflow.operators.stats import best_params, forecast_accuracy, trend_label, week_factor_array
from demandflow.plans.seasonal import backtest_metrics

# Default parameters and the search grid.
DEFAULTS = {"n_recent": 26, "alpha": 0.6, "spike": 2.5}
GRID = {"n_recent": (13, 26, 52), "alpha": (0.4, 0.6, 0.8), "spike": (2.0, 2.5, 3.0)}
MIN_ROWS_FOR_SEARCH = 52 + 13

DOWN_ROWS, DOWN_ALPHA = 13, 0.8
UP_ROWS, UP_ALPHA = 52, 0.6
SPIKE_MIX = 0.6


def smoothing_model(
    series: DataFrame, spikes: Sequence[float], n_recents: Sequence[int], carry: Sequence[str] = ()
) -> DataFrame:
    """One row per product and outlier threshold, with everything a forecast needs.

    Missing weeks count for nothing: positions, ranks and `rows` are over observed weeks.
    `levels` maps a number of recent weeks to its weighted mean; `last_year` holds the observed
    values of the year before the series' end. `carry` names columns whose first known value
    goes along.
    """
    lengths = sorted({m for n in n_recents for m in (n, min(n, DOWN_ROWS), min(n, UP_ROWS))})
    known = F.count("demand")
    placed = (
        with_level_stats(series)
        .withColumns(
            {
                "_end": F.max("week_end").over(by_product()),
                "rows": F.col("observations"),
                "_pos": known.over(in_time().rowsBetween(W.unboundedPreceding, 0)),
            }
        )
        .withColumn("_rank", F.when(F.col("demand").isNotNull(), F.col("rows") - F.col("_pos") + 1))
    )
    by_spike = W.partitionBy("product_id", "spike")
    cleaned = (
        placed.withColumn("spike", F.explode(F.array(*[F.lit(float(s)) for s in spikes])))
        .withColumn("adjusted", capped_value(F.col("spike")))
        .withColumn("_overall", F.percentile("adjusted", F.lit(0.5)).over(by_spike))
    )
    v, n = F.col("adjusted"), F.col("rows")
    early = F.col("_pos") <= F.floor(n / 2)

    def weighted(length: int) -> tuple[Column, Column]:
        used = F.least(F.lit(length), n)
        w = F.when(F.col("_rank") <= used, recency_weight(F.col("_rank"), used, -1.5))
        return F.sum(w * v).alias(f"_num{length}"), F.sum(w).alias(f"_den{length}")

    in_last_year = F.col("demand").isNotNull() & (F.col("week_end") >= F.date_add("_end", -357))
    weekly = cleaned.groupBy("product_id", "spike", F.weekofyear("week_end").alias("_week")).agg(
        F.percentile(v, F.lit(0.5)).alias("_median"),
        F.max("_overall").alias("_overall"),
        F.max("rows").alias("rows"),
        F.sum(F.when(early, v)).alias("_first"),
        F.count(F.when(early, v)).alias("_first_n"),
        F.sum(F.when(~early, v)).alias("_second"),
        F.count(F.when(~early, v)).alias("_second_n"),
        *[F.max(F.when(F.col("_rank") == i, v)).alias(f"_v{i}") for i in range(1, 5)],
        *[c for length in lengths for c in weighted(length)],
        F.collect_list(F.when(in_last_year, F.struct("week_end", "demand"))).alias("_year"),
        F.max("_end").alias("last_week"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )
    model = weekly.groupBy("product_id", "spike").agg(
        F.max("rows").alias("rows"),
        week_factor_array(
            F.map_from_entries(F.collect_list(F.struct("_week", "_median"))), F.max("_overall"), F.max("rows")
        ).alias("factors"),
        F.try_divide(F.sum("_first"), F.sum("_first_n")).alias("_first"),
        F.try_divide(F.sum("_second"), F.sum("_second_n")).alias("_second"),
        F.max("_v1").alias("_v1"),
        F.array(F.max("_v2"), F.max("_v3"), F.max("_v4")).alias("_before"),
        F.create_map(
            *[
                part
                for length in lengths
                for part in (F.lit(length), F.sum(f"_num{length}") / F.sum(f"_den{length}"))
            ]
        ).alias("levels"),
        F.map_from_entries(F.flatten(F.collect_list("_year"))).alias("last_year"),
        F.max("last_week").alias("last_week"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry],
    )
    previous = median_of(F.col("_before"))
    return model.select(
        "product_id",
        "spike",
        "rows",
        "factors",
        "levels",
        "last_year",
        trend_label(F.col("rows"), F.col("_first"), F.col("_second")).alias("trend"),
        previous.alias("previous_median"),
        F.coalesce(F.col("_v1") > previous * (1 + F.col("spike") / 5), F.lit(False)).alias("is_spike"),
        "last_week",
        *carry,
    )


def smoothing_value(week_end: Column, step: Column, n_recent: Column, alpha: Column) -> Column:
    """Forecast of a date (`step` counts from 1) from the columns of a model row."""
    trend = F.col("trend")
    used = F.when(trend == "down", F.least(n_recent, F.lit(DOWN_ROWS))).when(
        trend == "up", F.least(n_recent, F.lit(UP_ROWS))
    ).otherwise(n_recent)
    weight = F.when(trend == "down", DOWN_ALPHA).when(trend == "up", UP_ALPHA).otherwise(alpha)
    factor = F.get("factors", F.weekofyear(week_end) - 1)
    level = F.try_element_at("levels", used) * factor
    year_ago = F.try_element_at("last_year", F.date_add(week_end, -364))
    blended = F.when(year_ago.isNull(), level).otherwise(weight * level + (1 - weight) * year_ago)
    recovering = F.col("is_spike") & (step <= 2) & F.col("previous_median").isNotNull()
    mixed = blended * (1 - SPIKE_MIX) + F.col("previous_median") * factor * SPIKE_MIX
    return zero_floor(F.when(recovering, mixed).otherwise(blended))


def smoothing_forecast(
    series: DataFrame, horizon: int = 13, n_recent: int = 26, alpha: float = 0.6, spike: float = 2.5
) -> DataFrame:
    """product_id, week_end, step, forecast; zeros for a series without any value."""
    value = smoothing_value(F.col("week_end"), F.col("step"), F.lit(n_recent), F.lit(alpha))
    ahead = next_weeks(smoothing_model(series, [spike], [n_recent]), horizon)
    return ahead.select("product_id", "week_end", "step", value.alias("forecast"))


def smoothing_grid_pairs(series: DataFrame, grid: dict[str, Sequence], k: int = 13) -> DataFrame:
    """Backtest of every grid point: product_id, all_rows, grid_idx, params, week_end, actual,
    predicted.

    Points whose window is as long as the training series or longer are skipped; a product
    without any point keeps rows with nothing predicted.
    """
    points = [
        F.struct(
            F.lit(i).alias("grid_idx"), F.lit(n).alias("n_recent"), F.lit(float(a)).alias("alpha"), F.lit(float(s)).alias("spike")
        )
        for i, (n, a, s) in enumerate(cartesian(grid["n_recent"], grid["alpha"], grid["spike"]))
    ]
    model = smoothing_model(training_rows(series, k), grid["spike"], grid["n_recent"], CARRIED)
    mine = F.filter(
        F.array(*points), lambda p: (p["spike"] == F.col("spike")) & (p["n_recent"] < F.col("all_rows") - k)
    )
    tried = held_out_weeks(model.withColumn("p", F.explode_outer(mine)))
    value = smoothing_value(F.col("week_end"), F.col("step"), F.col("p.n_recent"), F.col("p.alpha"))
    return tried.select(
        "product_id",
        "all_rows",
        F.col("p.grid_idx").alias("grid_idx"),
        F.struct("p.n_recent", "p.alpha", "p.spike").alias("params"),
        "week_end",
        "actual",
        value.alias("predicted"),
    )


def smoothing_backtest(series: DataFrame, k: int = 13, n_recent: int = 26, alpha: float = 0.6, spike: float = 2.5) -> DataFrame:
    """Accuracy of one parameter set on the last `k` weeks; unlike the search it skips no window length."""
    model = smoothing_model(training_rows(series, k), [spike], [n_recent], CARRIED)
    value = smoothing_value(F.col("week_end"), F.col("step"), F.lit(n_recent), F.lit(alpha))
    pairs = held_out_weeks(model).select("product_id", "too_short", "week_end", "actual", value.alias("predicted"))
    return backtest_metrics(pairs)


def grid_search(series: DataFrame, grid: dict[str, Sequence] = GRID, k: int = 13) -> DataFrame:
    """Best parameters per product by backtest MAPE; defaults for a series under 65 rows or
    without any scored grid point (their mape is null)."""
    pairs = smoothing_grid_pairs(series, grid, k)
    scored = forecast_accuracy(pairs, "product_id", "all_rows", "grid_idx", "params")
    best = best_params(scored, "all_rows")
    defaults = F.struct(*[F.lit(value).alias(name) for name, value in DEFAULTS.items()])
    tuned = F.col("all_rows") >= MIN_ROWS_FOR_SEARCH
    return best.select(
        "product_id",
        F.coalesce(F.when(tuned, F.col("params")), defaults).alias("params"),
        F.when(tuned, F.col("mape")).alias("mape"),
    ).select("product_id", "params.n_recent", "params.alpha", "params.spike", "mape")
