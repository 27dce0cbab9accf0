"""Outlier treatment of weekly series. Series under 12 rows are left as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from demandflow.operators.series import by_product, in_time

MIN_ROWS = 12
CAP_SCALE = 3.0
CLIP_SCALE = 1.4826
ROLLING_SCALE = 0.6745


def _back() -> WindowSpec:
    return in_time().rowsBetween(W.unboundedPreceding, 0)


def _ahead() -> WindowSpec:
    return in_time().rowsBetween(0, W.unboundedFollowing)



def with_level_stats(series: DataFrame, value: str = "demand") -> DataFrame:
    """Add rows, observations, median, MAD and coefficient of variation of each series.

    Computed as whole-partition windows, so the series is neither shuffled again nor joined.
    """
    v = F.col(value)
    first = series.withColumns(
        {
            "rows": F.count(F.lit(1)).over(by_product()),
            "observations": F.count(v).over(by_product()),
            "median": F.percentile(v, F.lit(0.5)).over(by_product()),
            "_mean": F.avg(v).over(by_product()),
            "_std": F.stddev_samp(v).over(by_product()),
        }
    )
    mad = F.percentile(F.abs(v - F.col("median")), F.lit(0.5)).over(by_product())
    cv = F.when(F.col("_mean") > 0, F.col("_std") / F.col("_mean")).otherwise(0.0)
    return first.withColumns({"mad": mad, "cv": cv}).drop("_mean", "_std")


def median_mad_cv(series: DataFrame, value: str = "demand") -> DataFrame:
    """One row per product: median, MAD and coefficient of variation."""
    return with_level_stats(series, value).groupBy("product_id").agg(
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
        F.first("cv", ignorenulls=True).alias("cv"),
    )


def _capped(value: Column, threshold: Column | float) -> Column:
    """Far values, high or low, become the upper bound. Off when a week is missing."""
    whole = (F.col("rows") >= MIN_ROWS) & (F.col("observations") == F.col("rows")) & (F.col("mad") > 0)
    far = CAP_SCALE * F.abs(value - F.col("median")) / F.when(F.col("mad") > 0, F.col("mad")) > threshold
    return F.when(whole & far, F.col("median") + threshold * F.col("mad") * CAP_SCALE).otherwise(value)


def outliers_cap(series: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Add `adjusted`: outliers on either side replaced by the upper bound."""
    stats = with_level_stats(series)
    return _finish(stats.withColumn("adjusted", _capped(F.col("demand"), threshold)), series)


def outliers_clip(series: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Add `adjusted`: outliers moved to the nearer of the two bounds; missing weeks allowed."""
    stats = with_level_stats(series)
    width = threshold * CLIP_SCALE * F.col("mad")
    v = F.col("demand")
    active = (F.col("rows") >= MIN_ROWS) & (F.col("mad") > 1e-6) & v.isNotNull()
    limited = F.least(F.greatest(v, F.col("median") - width), F.col("median") + width)
    return _finish(stats.withColumn("adjusted", F.when(active, limited).otherwise(v)), series)


def with_rolling_stats(series: DataFrame, value: str = "demand") -> DataFrame:
    """Add the centred five-week median and MAD, gaps filled forward then backward."""
    centred = in_time().rowsBetween(-2, 2)

    def centred_median(c: Column) -> Column:
        return F.when(F.count(c).over(centred) >= 2, F.percentile(c, F.lit(0.5)).over(centred))

    def filled(c: str) -> Column:
        return F.coalesce(
            F.last(c, ignorenulls=True).over(_back()), F.first(c, ignorenulls=True).over(_ahead())
        )

    v = F.col(value)
    out = series.withColumn("_m", centred_median(v)).withColumn("rolling_median", filled("_m"))
    out = out.withColumn("_d", centred_median(F.abs(v - F.col("rolling_median"))))
    return out.withColumn("rolling_mad", filled("_d")).drop("_m", "_d")


def _rolled(value: Column, threshold: Column | float) -> Column:
    """Far values move to threshold MADs from the local median; off when any MAD is 0."""
    mad, level = F.col("rolling_mad"), F.col("rolling_median")
    active = (F.col("rows") >= MIN_ROWS) & (F.col("_least_mad") > 0)
    far = ROLLING_SCALE * F.abs(value - level) / F.when(mad > 0, mad) > threshold
    moved = level + threshold * mad * F.signum(value - level)
    return F.when(active & far, moved).otherwise(value)


def _with_least_mad(df: DataFrame) -> DataFrame:
    return df.withColumn("_least_mad", F.min("rolling_mad").over(by_product()))


def outliers_rolling(series: DataFrame, threshold: float = 2.5) -> DataFrame:
    """Add `adjusted`: local outliers pulled towards the rolling median."""
    stats = _with_least_mad(with_rolling_stats(series.withColumn("rows", F.count(F.lit(1)).over(by_product()))))
    return _finish(stats.withColumn("adjusted", _rolled(F.col("demand"), threshold)), series)


def outliers_auto(
    series: DataFrame, flagged: Column | None = None, threshold: Column | float = 2.5
) -> DataFrame:
    """Add `adjusted` and `cv`: the rolling rule for volatile (cv > 0.5) or flagged products,
    the cap for the others."""
    stats = _with_least_mad(with_rolling_stats(with_level_stats(series)))
    rolling = F.coalesce(F.col("cv") > 0.5, F.lit(False)) | (F.lit(False) if flagged is None else flagged)
    v = F.col("demand")
    chosen = F.when(rolling, _rolled(v, threshold)).otherwise(_capped(v, threshold))
    return _finish(stats.withColumn("adjusted", chosen), series, "cv")


def _finish(df: DataFrame, series: DataFrame, *extra: str) -> DataFrame:
    return df.select(*series.columns, "adjusted", *extra)


def capped_value(threshold: Column | float) -> Column:
    """The cap rule as an expression over `demand` and the columns of `with_level_stats`."""
    return _capped(F.col("demand"), threshold)


__all__ = [
    "capped_value", "median_mad_cv", "outliers_auto", "outliers_cap", "outliers_clip",
    "outliers_rolling", "with_level_stats", "with_rolling_stats",
]
