"""Joins between facts, dimensions and weekly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.functions.calendar import quarter_index

CAPACITY_ATTRIBUTE = "Available Capacity"

# Attribute names of the quarterly facts.
ATTRIBUTES = {
    "supply": "Yielded Supply",
    "safety_stock": "Safety Stock Target",
    "wos": "Safety Stock Target (WOS)",
    "demand": "EffectiveDemand",
    "balance": "Total Projected Inventory Balance",
    "excess": "Inventory Balance in excess of SST",
}


def fact_lookup(facts: DataFrame, requests: DataFrame) -> DataFrame:
    """Value of each requested (product, attribute, quarter); unknown keys give no row."""
    keys = ["product_id", "attribute", "quarter"]
    return requests.select(*keys).join(facts.select(*keys, "value"), keys)


def facts_by_quarter(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per product and quarter with the named attributes side by side.

    Of repeated facts the largest value counts.
    """
    pick = [F.max(F.when(F.col("attribute") == ATTRIBUTES[c], F.col("value"))).alias(c) for c in columns]
    wanted = facts.where(F.col("attribute").isin([ATTRIBUTES[c] for c in columns]))
    index = quarter_index(F.col("year"), F.col("quarter_num")).alias("quarter_index")
    return wanted.groupBy("product_id", "quarter", index).agg(*pick)


def previous_quarter_balance(by_quarter: DataFrame, column: str = "balance") -> DataFrame:
    """Add `opening`: the balance of exactly the quarter before, null when it is absent."""
    order = W.partitionBy("product_id").orderBy("quarter_index")
    adjacent = F.lag("quarter_index").over(order) == F.col("quarter_index") - 1
    return by_quarter.withColumn("opening", F.when(adjacent, F.lag(column).over(order)))


def with_week_seq(weekly: DataFrame, date: str) -> DataFrame:
    """Number the weeks of each product and quarter from 1 in date order."""
    order = W.partitionBy("product_id", "quarter").orderBy(date)
    return weekly.withColumn("week_seq", F.row_number().over(order))


def yield_x_capacity(yields: DataFrame, capacity: DataFrame) -> DataFrame:
    """Pair week i of the yield with week i of the capacity of the same product and quarter.

    A week that only one of them has gives no row here; `complete_quarters` tells such quarters.
    """
    keys = ["product_id", "quarter", "week_seq"]
    return yields.select(*keys, "yield_value").join(capacity.select(*keys, "week_label", "capacity"), keys)


def complete_quarters(yields: DataFrame, capacity: DataFrame) -> DataFrame:
    """Pairs of `yield_x_capacity`, of quarters only in which every week of either has both values."""
    keys = ["product_id", "quarter", "week_seq"]
    every = yields.select(*keys, "yield_value").join(capacity.select(*keys, "week_label", "capacity"), keys, "full_outer")
    lacking = F.col("yield_value").isNull() | F.col("capacity").isNull()
    of_quarter = W.partitionBy("product_id", "quarter")
    return every.withColumn("_lacks", F.max(lacking).over(of_quarter)).where(~F.col("_lacks")).drop("_lacks")


def unique_priorities(priority: DataFrame) -> DataFrame:
    """(product_id, line, priority), `line` null where the table has none.

    A product named twice, or two products of one line and priority, is an error: leftovers would be
    handed out twice.
    """
    line = F.col("line") if "line" in priority.columns else F.lit(None).cast("string").alias("line")
    ranks = priority.select("product_id", line, "priority")
    for keys in (["product_id"], ["line", "priority"]):
        twice = ranks.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"repeated {' and '.join(keys)} in the priorities: {tuple(twice)[:-1]}")
    return ranks


def asof_last_year(history: DataFrame, requests: DataFrame, tolerance: int = 3) -> DataFrame:
    """Value 52 weeks before each request date: exact, else the nearest within `tolerance` days.

    Every candidate day within the tolerance becomes an equality key (at most
    2 * tolerance + 1 per request), so the join hashes instead of comparing all dates of a
    product. Of two equally near days the later one wins.
    """
    target = F.date_add("request_date", -364)
    offsets = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))
    candidates = requests.select("product_id", "request_date", offsets.alias("_off")).withColumn(
        "obs_date", F.date_add(F.date_add("request_date", -364), F.col("_off"))
    )
    known = history.where(F.col("value").isNotNull()).select("product_id", "obs_date", "value")
    rank = F.abs(F.col("_off")) * 2 - F.when(F.col("_off") > 0, 1).otherwise(0)
    found = candidates.join(known, ["product_id", "obs_date"], "left")
    return found.groupBy("product_id", "request_date").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), rank)).alias("last_year_value")
    ).withColumn("target_date", target)


def donor_leftover(plans: DataFrame) -> DataFrame:
    """Capacity plus what the product one priority higher leaves unused that week.

    `plans`: product_id, priority, quarter, week_seq, capacity, wafers, and `line` where there are
    several. The first priority has no donor and keeps its own capacity. Two products of one
    priority would both donate, so that is an error.
    """
    keys = [c for c in ("line", "priority") if c in plans.columns]
    unique_priorities(plans.select("product_id", *keys).distinct())
    donor = plans.select(
        *keys[:-1],
        (F.col("priority") + 1).alias("priority"),
        "quarter",
        "week_seq",
        (F.col("capacity") - F.col("wafers")).alias("leftover"),
    )
    joined = plans.join(donor, [*keys, "quarter", "week_seq"], "left")
    extra = F.coalesce("leftover", F.lit(0.0))
    return joined.withColumn("leftover", extra).withColumn("raised_capacity", F.col("capacity") + extra)
