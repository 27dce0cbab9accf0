"""Row filters, imputation and input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.functions.calendar import WEEKS_PER_QUARTER


def filter_attribute(facts: DataFrame, attribute: str = "EffectiveDemand") -> DataFrame:
    return facts.where(F.col("attribute") == attribute)


def drop_zero_demand(facts: DataFrame, column: str = "value") -> DataFrame:
    """Rows with a value other than 0; negative values stay."""
    return facts.where(F.col(column).isNotNull() & (F.col(column) != 0))


def select_products(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the products listed in `ids`."""
    return df.join(ids.select("product_id").distinct(), "product_id", "left_semi")


def boundary_rows(
    df: DataFrame, key_column: str, excluded: Sequence[str] = ("Product ID", "Total")
) -> DataFrame:
    """Rows with a key value whose id is a product, not a heading or a total."""
    return df.where(F.col(key_column).isNotNull() & ~F.col("product_id").isin(*excluded))


def impute_mean(df: DataFrame, column: str, period: str) -> DataFrame:
    """Missing values become the mean of their period over all rows, 0 if that is missing too.

    The means are aggregated map-side and joined back; a window would put every product's
    row of a period in one task.
    """
    means = df.groupBy(F.col(period).alias("_period")).agg(F.avg(column).alias("_mean"))
    filled = df.join(means, F.col(period).eqNullSafe(F.col("_period")), "left")
    return filled.withColumn(column, F.coalesce(column, "_mean", F.lit(0.0))).drop("_period", "_mean")


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def validate_ratio(ratio: DataFrame, *groups: str | Column) -> DataFrame:
    """Status of a week ratio (per group, if any): week count, sum, ok and warning flags.

    Not ok: other than 13 values, or one of them missing. A sum off 1 is only a warning.
    """
    checked = ratio.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("total"),
        F.count_if(F.col("ratio").isNull()).alias("missing"),
    )
    return checked.select(
        "*",
        ((F.col("weeks") == WEEKS_PER_QUARTER) & (F.col("missing") == 0)).alias("ok"),
        (F.abs(F.col("total") - 1) > 1e-6).alias("sum_warning"),
    )
