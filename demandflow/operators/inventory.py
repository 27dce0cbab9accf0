"""Safety stock and inventory balances by quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from demandflow.functions.calendar import WEEKS_PER_QUARTER

# Weeks of supply held as safety stock, by product.
DEFAULT_WOS = {"21A": 1.82, "22B": 1.56, "23C": 1.42}


def _by_quarter() -> WindowSpec:
    return W.partitionBy("product_id").orderBy("quarter_index")


def wos_lookup(by_quarter: DataFrame, wos: DataFrame) -> DataFrame:
    """Add each product's weeks of supply. Spark broadcasts `wos` only when it is small enough."""
    return by_quarter.join(wos.select("product_id", "wos"), "product_id", "left")


def safety_stock(by_quarter: DataFrame) -> DataFrame:
    """Add `safety_stock`: weekly demand of the next quarter (own, if missing) times `wos`."""
    upcoming = F.coalesce(F.lead("demand").over(_by_quarter()), F.col("demand"))
    return by_quarter.withColumn("safety_stock", upcoming / WEEKS_PER_QUARTER * F.col("wos"))


def inventory_balance(by_quarter: DataFrame) -> DataFrame:
    """Add `balance` (opening stock plus all supply less all demand so far) and `excess` over
    the safety stock. `opening` is each product's stock before its first quarter."""
    so_far = _by_quarter().rowsBetween(W.unboundedPreceding, 0)
    balance = F.col("opening") + F.sum(F.col("supply") - F.col("demand")).over(so_far)
    return by_quarter.withColumn("balance", balance).withColumn(
        "excess", F.col("balance") - F.col("safety_stock")
    )


def net_balance(horizon: DataFrame, stock: DataFrame) -> DataFrame:
    """Initial stock plus receipts less forecast demand less safety stock, per product."""
    left = horizon.join(stock, "product_id")
    return left.select(
        "product_id",
        (F.col("initial") + F.col("receipts") - F.col("demand") - F.col("safety_stock")).alias("net"),
    )
