"""Weekly series stored in buckets by product, so that work by product starts without a shuffle.

Every forecast reads the same weekly series and begins with windows by product. Written once as a bucketed
table, sorted by product and week inside a bucket, the rows of a product lie in one file of one bucket, and Spark
plans windows, aggregates and joins by product on it without an exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

KEYS = ("product_id", "week_end")


def write_weekly_store(series: DataFrame, name: str, path: str, buckets: int) -> None:
    """Replace table `name`, kept under `path`, by the series, once the new rows are written and checked.

    Raw rows have to be reduced to one a product and week before: that is what bounds a product's rows
    by the calendar, so that no bucket grows with a product that holds a third of all raw rows. A repeated
    (product, week) is an error. `buckets` should be about the number of tasks that read the table.
    """
    spark = series.sparkSession
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    staged = f"{name}_{uuid.uuid4().hex[:8]}"
    placed = series.repartition(buckets, "product_id")
    placed.write.format("parquet").bucketBy(buckets, "product_id").sortBy(*KEYS).option("path", folder).saveAsTable(staged)
    twice = spark.table(staged).groupBy(*KEYS).count().where("count > 1").take(1)
    if twice:
        spark.sql(f"DROP TABLE {staged}")
        raise ValueError(f"product {twice[0][0]} has several rows for week {twice[0][1]}")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")


def read_weekly_store(spark: SparkSession, name: str) -> DataFrame:
    """The stored series; a bucket is a partition."""
    return spark.table(name)
