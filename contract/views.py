"""Demand, capacity and fact tables that Spark derives from the driver's parquet tables.

product = part brand, demand = shipped quantity, week = the Sunday on or after the ship date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandflow.functions.calendar import quarter_index_of_date, quarter_label, week_end
from demandflow.operators.lookups import ATTRIBUTES, CAPACITY_ATTRIBUTE, with_week_seq
from demandflow.operators.series import fill_weeks
from demandflow.plans.capacity import PlanLimits, plan_inputs
from demandflow.session import cut_lineage

WAFERS_PER_UNIT = 5
DEMAND_PER_UNIT = 3400.0
SUPPLY_PER_UNIT = 3500.0
LIMITS = PlanLimits(min_week=100, max_decrease=560, lo=200_000.0, hi=900_000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their brand. Spark broadcasts the part keys only when their measured size
    allows; else both sides shuffle on the part and adaptive execution splits a hot one."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", F.to_date("l_shipdate").alias("ship_date")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product_id"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).drop("l_partkey", "p_partkey")


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly totals per brand: the only pass over raw lines most queries need."""
    return (
        shipments(spark, sf_dir)
        .groupBy("product_id", week_end(F.col("ship_date")).alias("week_end"))
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.sum("l_discount").alias("discount"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = brand_weeks(spark, sf_dir)
    return fill_weeks(weeks.select("product_id", "week_end", F.col("quantity").alias("demand")))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals per event type, shaped as a series."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("product_id"), F.to_date("ts").alias("week_end"))
        .agg(F.sum("value").alias("demand"))
    )


def quarter_units(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """product_id, quarter_index, quarter, units, wos."""
    weeks = weeks or brand_weeks(spark, sf_dir)
    units = weeks.groupBy("product_id", quarter_index_of_date(F.col("week_end")).alias("quarter_index")).agg(
        F.sum("quantity").alias("units")
    )
    return units.withColumn("quarter", quarter_label(F.col("quarter_index"))).withColumn("wos", brand_wos())


def brand_number() -> Column:
    return F.split("product_id", "#").getItem(1).cast("int")


def brand_wos() -> Column:
    rest = brand_number() % 3
    return F.when(rest == 0, 1.82).when(rest == 1, 1.56).otherwise(1.42)


def quarters(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """Quarter table with demand, supply, weeks of supply and the plan's balances."""
    from demandflow.operators.inventory import safety_stock

    base = quarter_units(spark, sf_dir, weeks).withColumns(
        {
            "demand": F.col("units") * DEMAND_PER_UNIT,
            "supply": F.col("units") * SUPPLY_PER_UNIT,
            "balance": F.col("units") * DEMAND_PER_UNIT * (0.02 + 0.02 * (F.col("quarter_index") % 4 + 1)),
        }
    )
    return safety_stock(base)


def facts(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """Long quarterly facts."""
    names = ("demand", "supply", "safety_stock", "wos", "balance")
    cells = F.array(*[F.struct(F.lit(ATTRIBUTES[n]).alias("attribute"), F.col(n).alias("value")) for n in names])
    return quarters(spark, sf_dir, weeks).select(
        "product_id",
        F.inline(cells),
        "quarter",
        F.floor(F.col("quarter_index") / 4).cast("int").alias("year"),
        (F.col("quarter_index") % 4 + 1).cast("int").alias("quarter_num"),
    )


def quarter_labels(spark: SparkSession, sf_dir: str) -> list[str]:
    """Labels from the first to the last ship date: two numbers from one aggregate."""
    day = week_end(F.to_date("l_shipdate"))
    first, last = (
        table(spark, sf_dir, "lineitem")
        .agg(F.min(quarter_index_of_date(day)), F.max(quarter_index_of_date(day)))
        .first()
    )
    return [f"Q{i % 4 + 1} {i // 4 % 100:02d}" for i in range(first, last + 1)]


def wide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand as a wide text table, one column per quarter, with thousands separators."""
    long = quarter_units(spark, sf_dir).withColumn("text", F.format_number(F.col("units") * DEMAND_PER_UNIT, 0))
    return (
        long.groupBy("product_id", F.lit(ATTRIBUTES["demand"]).alias("attribute"))
        .pivot("quarter", quarter_labels(spark, sf_dir))
        .agg(F.first("text"))
    )


def weekly_quarters(spark: SparkSession, sf_dir: str, weeks: DataFrame | None = None) -> DataFrame:
    """brand_weeks with quarter label, week label and week number in the quarter."""
    day = F.col("week_end")
    labelled = (weeks or brand_weeks(spark, sf_dir)).withColumns(
        {
            "quarter_index": quarter_index_of_date(day),
            "quarter": quarter_label(quarter_index_of_date(day)),
            "week_label": F.format_string("WW_%02d", ((F.weekofyear(day) - 1) % 52 + 1).cast("int")),
        }
    )
    return with_week_seq(labelled, "week_end")


def capacity(weeks: DataFrame) -> DataFrame:
    return weeks.select(
        "product_id",
        F.lit(CAPACITY_ATTRIBUTE).alias("attribute"),
        "quarter",
        "quarter_index",
        "week_label",
        "week_seq",
        "week_end",
        (F.col("quantity") * WAFERS_PER_UNIT).alias("capacity"),
    )


def yields(weeks: DataFrame) -> DataFrame:
    return weeks.select(
        "product_id", "quarter", "week_seq", "week_end", (1 - F.col("discount") / F.col("lines")).alias("yield_value")
    )


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("product_id"))
        .agg(F.floor(F.round(F.avg("p_retailprice"), 4)).cast("int").alias("density"))
    )


def planning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan inputs. Facts, yields and capacity all come from the weekly totals, which are
    checkpointed so that the lines are read once, not once for each of them."""
    totals = cut_lineage(brand_weeks(spark, sf_dir))
    weeks = weekly_quarters(spark, sf_dir, totals)
    return plan_inputs(facts(spark, sf_dir, totals), density(spark, sf_dir), yields(weeks), capacity(weeks))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("product_id")).distinct()
    return brands.withColumn("priority", brand_number())


def publish(df: DataFrame, digits: int = 4, **finer: int) -> DataFrame:
    """Result for comparison: doubles rounded, whole numbers as BIGINT, dates as ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, finer.get(f.name, digits)) + 0.0
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)
