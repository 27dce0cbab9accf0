"""Aggregates over weekly series: seasonal profiles, trends, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.functions.calendar import week_of_quarter
from demandflow.functions.numeric import clip, ratio, recency_weight
from demandflow.operators.series import by_product, from_end, in_time

RECENT_ROWS = 26
YEAR_ROWS = 52
ISO_WEEKS = 53


def product_stats(df: DataFrame, value: str = "demand") -> DataFrame:
    """Sum, mean and number of weekly values per product."""
    return df.groupBy("product_id").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("weeks")
    )


def eligible_products(df: DataFrame) -> DataFrame:
    """Distinct products in order."""
    return df.select("product_id").distinct().orderBy("product_id")


def seasonal_means(series: DataFrame, value: str = "demand") -> DataFrame:
    """Means overall, by quarter, by week of quarter and by both, told apart by `level`.

    A cell is first reduced to sum and count, so only the at most 52 cells of a product are
    expanded into the four groupings.
    """
    cells = season_cells(series, value)
    return (
        cells.groupingSets(
            [
                [F.col("product_id")],
                [F.col("product_id"), F.col("quarter_num")],
                [F.col("product_id"), F.col("week_of_quarter")],
                [F.col("product_id"), F.col("quarter_num"), F.col("week_of_quarter")],
            ],
            "product_id",
            "quarter_num",
            "week_of_quarter",
        )
        .agg(
            F.grouping_id().cast("int").alias("_gid"),
            ratio(F.sum("total"), F.sum("observations")).alias("mean"),
        )
        .select(
            "product_id",
            F.when(F.col("_gid") == 3, "overall")
            .when(F.col("_gid") == 1, "quarter")
            .when(F.col("_gid") == 2, "week")
            .otherwise("quarter_week")
            .alias("level"),
            "quarter_num",
            "week_of_quarter",
            "mean",
        )
    )


def season_cells(series: DataFrame, value: str = "demand", *measures: Column) -> DataFrame:
    """Sum and count per product, quarter and week of quarter (at most 52 rows a product)."""
    keyed = series.withColumns(
        {"quarter_num": F.quarter("week_end"), "week_of_quarter": week_of_quarter(F.col("week_end"))}
    )
    return keyed.groupBy("product_id", "quarter_num", "week_of_quarter").agg(
        F.sum(value).alias("total"), F.count(value).alias("observations"), *measures
    )


def seasonal_factors(means: DataFrame) -> DataFrame:
    """Quarter and week means over the overall mean; 1 when that is not positive."""
    overall = F.max(F.when(F.col("level") == "overall", F.col("mean"))).over(by_product())
    factor = F.when(F.col("_overall") > 0, F.col("mean") / F.col("_overall")).otherwise(1.0)
    return (
        means.withColumn("_overall", overall)
        .where(F.col("level").isin("quarter", "week"))
        .select("product_id", "level", "quarter_num", "week_of_quarter", factor.alias("factor"))
    )


def trend_factor(series: DataFrame, value: str = "demand") -> DataFrame:
    """Mean of the last 26 rows over the overall mean; 1 for shorter series."""
    ranked = series.withColumn("_rank", F.row_number().over(from_end()))
    recent = F.avg(F.when(F.col("_rank") <= RECENT_ROWS, F.col(value)))
    overall = F.avg(value)
    usable = (F.count(F.lit(1)) >= RECENT_ROWS) & (overall > 0)
    return ranked.groupBy("product_id").agg(F.when(usable, recent / overall).otherwise(1.0).alias("trend"))


def weighted_quarter_trend(series: DataFrame, value: str = "demand") -> DataFrame:
    """Trend of flagged products: weighted mean of the last (up to) eight calendar quarters
    over the overall mean. Under 52 rows: mean of the last min(13, rows / 2) rows instead.

    A quarter without any value makes the trend null. Not positive overall mean: 1.
    """
    quarter = F.trunc("week_end", "quarter")
    ranked = series.withColumns(
        {"_rank": F.row_number().over(from_end()), "_rows": F.count(F.lit(1)).over(by_product())}
    )
    short = F.least(F.lit(13), F.floor(F.col("_rows") / 2))
    in_short = (F.col("_rank") <= short) | (short == 0)
    quarters = ranked.groupBy("product_id", quarter.alias("_quarter")).agg(
        F.sum(value).alias("_sum"),
        F.count(value).alias("_n"),
        F.sum(F.when(in_short, F.col(value))).alias("_short_sum"),
        F.count(F.when(in_short, F.col(value))).alias("_short_n"),
        F.max("_rows").alias("_rows"),
    )
    back = W.partitionBy("product_id").orderBy(F.col("_quarter").desc())
    placed = quarters.withColumns(
        {
            "_age": F.row_number().over(back),
            "_used": F.least(F.lit(8), F.count(F.lit(1)).over(by_product())),
        }
    )
    weight = recency_weight(F.col("_age"), F.col("_used"), -2.0)
    used = F.col("_age") <= F.col("_used")
    gap = F.count_if(used & (F.col("_n") == 0)) > 0
    totals = placed.groupBy("product_id").agg(
        ratio(F.sum("_sum"), F.sum("_n")).alias("_overall"),
        ratio(F.sum("_short_sum"), F.sum("_short_n")).alias("_recent"),
        F.when(
            ~gap,
            F.sum(F.when(used, weight * ratio(F.col("_sum"), F.col("_n")))) / F.sum(F.when(used, weight)),
        ).alias("_weighted"),
        F.max("_rows").alias("_rows"),
        F.count(F.lit(1)).alias("_quarters"),
    )
    level = F.when((F.col("_rows") >= YEAR_ROWS) & (F.col("_quarters") >= 4), F.col("_weighted")).otherwise(
        F.col("_recent")
    )
    return totals.select(
        "product_id", F.when(F.col("_overall") > 0, level / F.col("_overall")).otherwise(1.0).alias("trend")
    )


def accuracy_columns(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates mae, rmse, mape and mpe (percent errors only where the actual is not 0)."""
    error = actual - predicted
    relative = ratio(error, actual)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(relative)) * 100).alias("mape"),
        (F.avg(relative) * 100).alias("mpe"),
    ]


def forecast_accuracy(pairs: DataFrame, *keys: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy per key over rows with an actual value."""
    usable = F.when(F.col(actual).isNotNull() & F.col(predicted).isNotNull(), F.col(actual))
    return pairs.groupBy(*keys).agg(*accuracy_columns(usable, F.col(predicted)))


def weekly_seasonal_factors(series: DataFrame, value: str = "demand") -> DataFrame:
    """A factor for each ISO week 1-53: median of that week over the overall median, limited to
    0.6-1.8 and scaled to mean 1. Flat 1 under 104 rows or with a zero median."""
    level = series.withColumns(
        {
            "_overall": F.percentile(value, F.lit(0.5)).over(by_product()),
            "_rows": F.count(F.lit(1)).over(by_product()),
        }
    )
    weekly = level.groupBy("product_id", F.weekofyear("week_end").alias("_week")).agg(
        F.percentile(value, F.lit(0.5)).alias("_median"),
        F.max("_overall").alias("_overall"),
        F.max("_rows").alias("_rows"),
    )
    model = weekly.groupBy("product_id").agg(
        week_factor_array(
            F.map_from_entries(F.collect_list(F.struct("_week", "_median"))),
            F.max("_overall"),
            F.max("_rows"),
        ).alias("_factors")
    )
    return model.select("product_id", F.posexplode_outer("_factors").alias("_pos", "factor")).select(
        "product_id", (F.col("_pos") + 1).alias("iso_week"), "factor"
    )


def week_factor_array(medians: Column, overall: Column, rows: Column) -> Column:
    """Array of 53 factors from a map of ISO week to median (at most 53 entries)."""
    weeks = F.sequence(F.lit(1), F.lit(ISO_WEEKS))
    raw = F.transform(
        weeks,
        lambda w: clip(
            ratio(F.coalesce(F.try_element_at(medians, w), overall), overall), 0.6, 1.8
        ),
    )
    total = F.aggregate(raw, F.lit(0.0), lambda a, f: a + f)
    scaled = F.transform(raw, lambda f: f * ISO_WEEKS / total)
    flat = F.array_repeat(F.lit(1.0), ISO_WEEKS)
    return F.when((rows >= 2 * YEAR_ROWS) & (overall != 0), scaled).otherwise(flat)


def trend_label(rows: Column, first_half: Column, second_half: Column) -> Column:
    """up / down / none: second half's mean 20 % above or below the first half's."""
    change = ratio(second_half - first_half, first_half) * 100
    return (
        F.when((rows >= 12) & (change > 20), "up").when((rows >= 12) & (change < -20), "down").otherwise("none")
    )


def detect_trend(series: DataFrame, value: str = "demand") -> DataFrame:
    placed = series.withColumns(
        {"_pos": F.row_number().over(in_time()), "_half": F.floor(F.count(F.lit(1)).over(by_product()) / 2)}
    )
    early = F.col("_pos") <= F.col("_half")
    halves = placed.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg(F.when(early, F.col(value))).alias("_first"),
        F.avg(F.when(~early, F.col(value))).alias("_second"),
    )
    return halves.select(
        "product_id", trend_label(F.col("_rows"), F.col("_first"), F.col("_second")).alias("trend")
    )


def exp_weighted_recent(series: DataFrame, n: int, value: str = "demand") -> DataFrame:
    """Weighted mean of the last `n` observed rows, newer rows weighing more."""
    observed = series.where(F.col(value).isNotNull())
    ranked = observed.withColumns(
        {
            "_rank": F.row_number().over(from_end()),
            "_used": F.least(F.lit(n), F.count(F.lit(1)).over(by_product())),
        }
    ).where(F.col("_rank") <= F.col("_used"))
    weight = recency_weight(F.col("_rank"), F.col("_used"), -1.5)
    return ranked.groupBy("product_id").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("level"))


def boundary_seasonality(series: DataFrame, value: str = "demand") -> DataFrame:
    """Mean of a capacity series and its factor per calendar quarter (1 for a mean near 0)."""
    quarters = series.groupBy("product_id", F.quarter("week_end").alias("quarter_num")).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n")
    )
    mean = ratio(F.sum("_sum").over(by_product()), F.sum("_n").over(by_product()))
    own = ratio(F.col("_sum"), F.col("_n"))
    return quarters.withColumn("mean", mean).select(
        "product_id", "quarter_num", "mean", F.when(F.col("mean") > 1e-6, own / F.col("mean")).otherwise(1.0).alias("factor")
    )


def horizon_demand(forecast: DataFrame) -> DataFrame:
    """Total forecast per product."""
    return forecast.groupBy("product_id").agg(F.sum("forecast").alias("demand"))


def best_params(scored: DataFrame, *keep: str) -> DataFrame:
    """Parameters with the least MAPE per product; the earlier grid position wins a tie."""
    return scored.groupBy("product_id", *keep).agg(
        F.min_by("params", F.when(F.col("mape").isNotNull(), F.struct("mape", "grid_idx"))).alias("params"),
        F.min("mape").alias("mape"),
    )
