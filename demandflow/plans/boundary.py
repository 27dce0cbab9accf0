"""Capacity (boundary) forecast without a trained model, and its integer result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.functions.numeric import nonneg_int, ratio, shrink_to_mean, zero_floor
from demandflow.operators.outliers import outliers_clip
from demandflow.operators.series import CARRIED, by_product, held_out_weeks, next_weeks, training_rows

SENSITIVITY = 0.3
MIN_TRAIN_ROWS = 5


def boundary_model(series: DataFrame, spike: float = 2.5, carry: Sequence[str] = ()) -> DataFrame:
    """One row per product: mean, population deviation, count, and mean per quarter (map).

    `carry` names columns of the series whose first known value goes along.
    """
    along = [F.first(c, ignorenulls=True).alias(c) for c in carry]
    cleaned = outliers_clip(series, spike).withColumns(
        {"_std": F.stddev_pop("adjusted").over(by_product()), "_n": F.count("adjusted").over(by_product())}
    )
    quarters = cleaned.groupBy("product_id", F.quarter("week_end").alias("_q")).agg(
        F.sum("adjusted").alias("_sum"), F.count("adjusted").alias("_cnt"), F.max("_std").alias("_std"), F.max("_n").alias("_n"),
        F.max("week_end").alias("last_week"), *along,
    )
    own = ratio(F.col("_sum"), F.col("_cnt"))
    return quarters.groupBy("product_id").agg(
        ratio(F.sum("_sum"), F.sum("_cnt")).alias("level"),
        F.max("_std").alias("spread"),
        F.max("_n").alias("observations"),
        F.map_from_entries(F.collect_list(F.struct("_q", own))).alias("quarter_levels"),
        F.max("last_week").alias("last_week"),
        *along,
    )


def boundary_seasonal_value(week_end: Column) -> Column:
    """Mean times the quarter's factor (1 when unknown or the mean is near 0)."""
    level = F.col("level")
    own = F.try_element_at("quarter_levels", F.quarter(week_end))
    factor = F.when(level > 1e-6, F.coalesce(own / level, F.lit(1.0))).otherwise(1.0)
    return level * factor


def pulled(value: Column) -> Column:
    """Value pulled towards the product's mean."""
    return shrink_to_mean(value, F.col("level"), F.col("spread"), F.col("observations"), SENSITIVITY)


def boundary_value(week_end: Column) -> Column:
    """Baseline of a date from a model row: plain mean for under five observations."""
    seasonal = pulled(boundary_seasonal_value(week_end))
    return zero_floor(F.when(F.col("observations") < MIN_TRAIN_ROWS, F.col("level")).otherwise(seasonal))


def boundary_baseline(series: DataFrame, horizon: int = 13, spike: float = 2.5) -> DataFrame:
    """product_id, week_end, step, forecast from mean, quarter factor and pull to the mean."""
    ahead = next_weeks(boundary_model(series, spike), horizon)
    return ahead.select("product_id", "week_end", "step", boundary_value(F.col("week_end")).alias("forecast"))


def boundary_baseline_pairs(series: DataFrame, spike: float = 2.5) -> DataFrame:
    """Backtest pairs over the last third of the rows, four at most."""
    model = boundary_model(training_rows(series, None, MIN_TRAIN_ROWS), spike, CARRIED)
    return held_out_weeks(model).select(
        "product_id", "too_short", "week_end", "actual", boundary_value(F.col("week_end")).alias("predicted")
    )


def boundary_combine(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """History followed by forecast as non-negative whole numbers."""
    past = series.select(
        "product_id", "week_end", F.lit(False).alias("is_forecast"), nonneg_int(F.col("demand")).alias("capacity")
    )
    ahead = forecast.select(
        "product_id", "week_end", F.lit(True).alias("is_forecast"), nonneg_int(F.col("forecast")).alias("capacity")
    )
    return past.unionByName(ahead)
