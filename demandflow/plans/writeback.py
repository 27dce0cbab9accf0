"""Forecasts and plans written back into the quarterly facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions.calendar import quarter_index, quarter_successors
from demandflow.operators.inventory import safety_stock, wos_lookup
from demandflow.operators.lookups import ATTRIBUTES
from demandflow.operators.series import weeks_to_quarter_buckets
from demandflow.sources.writers import upsert_facts


def _cells(by_quarter: DataFrame, **columns: str) -> DataFrame:
    """Long facts from named columns: attribute key = column."""
    cells = F.array(*[F.struct(F.lit(ATTRIBUTES[k]).alias("attribute"), F.col(c).cast("double").alias("value")) for k, c in columns.items()])
    return by_quarter.select("product_id", F.inline(cells), "quarter")


def forecast_to_facts(facts: DataFrame, forecast: DataFrame, wos: DataFrame) -> DataFrame:
    """Facts with demand, weeks of supply and safety stock of the quarters a forecast covers.

    The forecast's 13-week sums continue each product's last demand quarter, whose safety stock
    changes too, since the quarter after it is now known. Products without demand facts are left
    out; a last sum of fewer weeks counts as it is.
    """
    index = quarter_index(F.col("year"), F.col("quarter_num"))
    known = facts.where((F.col("attribute") == ATTRIBUTES["demand"]) & (F.col("year") != -1) & F.col("value").isNotNull())
    last = known.groupBy("product_id").agg(F.max(F.struct(index.alias("at"), "quarter", "value")).alias("last"))
    ahead = weeks_to_quarter_buckets(forecast).join(last, "product_id")
    ahead = ahead.select(
        "product_id",
        "bucket",
        F.element_at(quarter_successors(F.col("last.quarter"), F.col("bucket")), F.col("bucket")).alias("quarter"),
        (F.col("last.at") + F.col("bucket")).alias("quarter_index"),
        "demand",
    )
    present = last.join(ahead.select("product_id").distinct(), "product_id", "left_semi").select(
        "product_id", F.lit(0).alias("bucket"), F.col("last.quarter").alias("quarter"), F.col("last.at").alias("quarter_index"), F.col("last.value").alias("demand")
    )
    stocked = safety_stock(wos_lookup(present.unionByName(ahead), wos))
    new = _cells(stocked.where("bucket > 0"), demand="demand", wos="wos").unionByName(_cells(stocked, safety_stock="safety_stock"))
    return upsert_facts(facts, new)


def plan_to_facts(facts: DataFrame, kpis: DataFrame) -> DataFrame:
    """Facts with the yielded supply, balance and excess of a plan's quarters (see `plan_kpis`)."""
    return upsert_facts(facts, _cells(kpis, supply="yielded_supply", balance="tpib", excess="ibesst"))
