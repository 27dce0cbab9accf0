"""Sinks, upserts and report layouts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.sources.commits import merge_table

# Fixed values of the report's type column.
HISTORY_TYPE = "Histórico"
FORECAST_TYPE = "Pronóstico"

PLAN_KEYS = ("quarter", "product_id")
FACT_KEYS = ("product_id", "attribute", "quarter")


def write_weekly(df: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Weekly demand clustered by product, so a product's rows sit in few files.

    Products are range-partitioned rather than given a folder each: their number grows with
    the data, and row-group statistics prune a product filter just as well. The week is part
    of the range key, so a product with very many rows is spread over several files.
    """
    clustered = df.repartitionByRange("product_id", "week_start").sortWithinPartitions(
        "product_id", "week_start"
    )
    writer = clustered.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def upsert_plan(target: DataFrame, new: DataFrame, keys: Sequence[str] = PLAN_KEYS) -> DataFrame:
    """Replace all rows of every key present in `new`, then append `new`.

    Columns that only one side has are null in the other's rows.
    """
    replaced = new.select(*keys).distinct()
    kept = target.join(replaced, list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def write_plan(spark: SparkSession, new: DataFrame, path: str, run: str | None = None) -> bool:
    """Upsert a plan on disk (read it by `commits.read_table`); False if `run` was written before.

    Buckets of products that `new` does not touch stay as they are, and a failure leaves the old plan whole.
    """
    return merge_table(spark, path, new, upsert_plan, "product_id", run or uuid.uuid4().hex)


def write_facts(spark: SparkSession, new: DataFrame, path: str, run: str | None = None) -> bool:
    """Set facts on disk by key (read them by `commits.read_table`); False if `run` was written before."""
    return merge_table(spark, path, new.select(*FACT_KEYS, "value"), upsert_facts, "product_id", run or uuid.uuid4().hex)


def upsert_facts(facts: DataFrame, new: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """Set values by key: a new value wins, other rows keep theirs, new keys are added.

    A null new value changes nothing; of several new values of a key the largest counts.
    """
    old = facts.select(*keys, F.col("value").alias("_old"))
    fresh = new.groupBy(*keys).agg(F.max("value").alias("_new"))
    return old.join(fresh, list(keys), "full_outer").select(
        *keys, F.coalesce("_new", "_old").alias("value")
    )


def export_bi(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Report rows: product_id, period, kind, demand.

    `history` carries product_id, period, demand; `forecast` product_id, step, forecast.
    """
    past = history.select(
        "product_id", "period", F.lit(HISTORY_TYPE).alias("kind"), F.col("demand").cast("double")
    )
    future = forecast.select(
        "product_id",
        F.concat(F.lit("F"), F.col("step").cast("string")).alias("period"),
        F.lit(FORECAST_TYPE).alias("kind"),
        F.col("forecast").alias("demand"),
    )
    return past.unionByName(future)


def write_bi(report: DataFrame, path: str) -> None:
    """Report as CSV with the column headings the report reader expects."""
    report.select(
        F.col("product_id").alias("Product ID"),
        F.col("period").alias("Periodo"),
        F.col("kind").alias("Tipo"),
        F.col("demand").alias("Valor Demanda"),
    ).write.mode("overwrite").option("header", "true").csv(path)


def facts_to_wide(facts: DataFrame, quarters: Sequence[str]) -> DataFrame:
    """One row per product and attribute, one column per quarter in the given order.

    Naming the quarters keeps this one aggregation, without a job to list them first. A fact of
    another quarter is an error. Of repeated facts the largest value counts.
    """
    other = facts.where(~F.coalesce(F.col("quarter").isin(list(quarters)), F.lit(False))).select("quarter").first()
    if other is not None:
        raise ValueError(f"facts of a quarter that has no column: {other[0]}")
    return facts.groupBy("product_id", "attribute").pivot("quarter", list(quarters)).agg(F.max("value"))


def forecast_periods(forecast: DataFrame) -> DataFrame:
    """Forecast rows numbered `step` 1.. per product by date."""
    order = W.partitionBy("product_id").orderBy("week_end")
    return forecast.withColumn("step", F.row_number().over(order))
