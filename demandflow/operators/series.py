"""From quarter facts and dated observations to regular weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from demandflow.functions.calendar import (
    WEEKS_PER_QUARTER,
    date_successors,
    quarter_index_of_date,
    quarter_successors,
    strict_quarter_index,
    week_end,
    week_label_successors,
    week_start,
)
from demandflow.operators.filters import drop_zero_demand, filter_attribute, validate_ratio


def by_product() -> WindowSpec:
    return W.partitionBy("product_id")


def in_time() -> WindowSpec:
    return by_product().orderBy("week_end")


def from_end() -> WindowSpec:
    return by_product().orderBy(F.col("week_end").desc())


def last_by(value: str | Column, *order: str | Column) -> Column:
    """Aggregate: value of the row that comes last by `order`.

    One ordering column keeps Spark's hash aggregation; several are compared as a struct.
    """
    return F.max_by(value, order[0] if len(order) == 1 else F.struct(*order))


def split_quarter_to_weeks(facts: DataFrame, ratio: DataFrame) -> DataFrame:
    """Thirteen rows per quarter fact: value times the week's ratio.

    `ratio` (week, ratio) is joined on the week; Spark broadcasts it by its measured size. Facts
    whose label did not parse (-1) are left out.
    """
    weeks = facts.where((F.col("year") != -1) & (F.col("quarter_num") != -1)).withColumn(
        "week", F.explode(F.sequence(F.lit(1), F.lit(WEEKS_PER_QUARTER)))
    )
    return weeks.join(ratio, "week").select(
        "product_id",
        "quarter",
        "year",
        "quarter_num",
        "week",
        week_start(F.col("year"), F.col("quarter_num"), F.col("week")).alias("week_start"),
        (F.col("value") * F.col("ratio")).alias("demand"),
    )


def weekly_demand(facts: DataFrame, ratio: DataFrame) -> DataFrame:
    """Quarter facts to weekly demand: demand attribute, non-zero quarters, 13 weeks each.

    A ratio without a known value for each of the weeks 1 to 13, once, is an error.
    """
    weeks = ratio.where(F.col("week").between(1, WEEKS_PER_QUARTER)).agg(F.count_distinct("week")).first()[0]
    if not validate_ratio(ratio).first()["ok"] or weeks != WEEKS_PER_QUARTER:
        raise ValueError(f"the week ratio needs one known value for each of the weeks 1 to {WEEKS_PER_QUARTER}")
    return split_quarter_to_weeks(drop_zero_demand(filter_attribute(facts)), ratio)


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`.

    Runs as an aggregate, not a ranking window, so duplicates shrink before the shuffle and a
    key with very many copies never sits whole in one task. Null comes before every value of an order column.
    """
    rest = [c for c in df.columns if c not in keys]
    # The struct is never null itself, so a key whose copies all lack the order column keeps its row.
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_match(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def resample_weekly_last(
    observations: DataFrame, date: str = "week_start", value: str = "demand", tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """Weekly series from dated values: the last value of each week, null rows for empty weeks.

    `tiebreak` orders values that share a date.
    """
    dated = observations.where(F.col(date).isNotNull() & F.col(value).isNotNull())
    order = (date, *tiebreak) if tiebreak else (date,)
    binned = dated.groupBy("product_id", week_end(F.col(date)).alias("week_end")).agg(
        last_by(value, *order).cast("double").alias("demand")
    )
    return fill_weeks(binned)


def fill_weeks(binned: DataFrame) -> DataFrame:
    """Add null rows for the weeks missing between a product's first and last week.

    Each row is stretched up to the week before its successor, so no calendar join is needed.
    """
    following = F.lead("week_end").over(in_time())
    until = F.coalesce(F.date_add(following, -7), F.col("week_end"))
    stretched = binned.withColumn("_until", until).select(
        "product_id",
        "demand",
        F.col("week_end").alias("_own"),
        F.explode_outer(F.sequence("week_end", "_until", F.expr("interval 7 days"))).alias("week_end"),
    )
    return stretched.select(
        "product_id", "week_end", F.when(F.col("week_end") == F.col("_own"), F.col("demand")).alias("demand")
    )


def trim_leading(
    series: DataFrame, order: str = "week_end", value: str = "demand"
) -> DataFrame:
    """Drop a product's rows before its first value above 0; keep all if there is none."""
    first = F.min(F.when(F.col(value) > 0, F.col(order))).over(by_product())
    kept = series.withColumn("_first", first).where(
        F.col("_first").isNull() | (F.col(order) >= F.col("_first"))
    )
    return kept.drop("_first")


def weekly_series(
    observations: DataFrame, date: str = "week_start", value: str = "demand", tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """Resampled, trimmed weekly series of every product."""
    return trim_leading(resample_weekly_last(observations, date, value, tiebreak))


def quarterly_series(facts: DataFrame, copy_order: str | None = None) -> DataFrame:
    """Quarterly demand per product: strict labels only, leading non-positive quarters cut,
    one row per quarter (the last by `copy_order`, then by value)."""
    parsed = facts.withColumn("quarter_index", strict_quarter_index(F.col("quarter"))).where(
        F.col("quarter_index").isNotNull() & F.col("value").isNotNull()
    )
    first_positive = parsed.groupBy("product_id").agg(
        F.min(F.when(F.col("value") > 0, F.col("quarter_index"))).alias("_first")
    )
    order = (copy_order, "value") if copy_order else ("value",)
    one_each = parsed.groupBy("product_id", "quarter_index").agg(last_by("value", *order).alias("demand"))
    return (
        one_each.join(first_positive, "product_id")
        .where(F.col("_first").isNull() | (F.col("quarter_index") >= F.col("_first")))
        .drop("_first")
    )


def future_weeks(series: DataFrame, horizon: int) -> DataFrame:
    """The `horizon` Sundays after each product's last week, numbered from 1."""
    last = series.groupBy("product_id").agg(F.max("week_end").alias("_last"))
    return last.select(
        "product_id", "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select("product_id", F.date_add("_last", F.col("step") * 7).alias("week_end"), "step")


def future_quarters(labels: DataFrame, count: int, label: str = "quarter") -> DataFrame:
    """The `count` quarter labels after each row's label, numbered from 1."""
    return _successors(labels, quarter_successors(F.col(label), count), label, "next_quarter")


def future_week_labels(labels: DataFrame, count: int, label: str = "week_label") -> DataFrame:
    """The `count` week labels after each row's label, numbered from 1."""
    return _successors(labels, week_label_successors(F.col(label), count), label, "next_label")


def future_dates(labels: DataFrame, count: int, step: int = 7, label: str = "date_text") -> DataFrame:
    """The `count` dates after each row's date text, `step` days apart, numbered from 1."""
    return _successors(labels, date_successors(F.col(label), count, step), label, "next_date")


def _successors(df: DataFrame, array: Column, label: str, name: str) -> DataFrame:
    return df.select(label, F.posexplode(array).alias("_pos", name)).select(
        label, (F.col("_pos") + 1).alias("step"), name
    )


def carry_forward(yields: DataFrame, horizon: int, value: str = "yield_value") -> DataFrame:
    """Each product's last known value repeated over the weeks after its last row."""
    last = yields.groupBy("product_id").agg(
        F.max("week_end").alias("_last"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("week_end"))).alias(value),
    )
    return last.select(
        "product_id", "_last", value, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select("product_id", F.date_add("_last", F.col("step") * 7).alias("week_end"), "step", value)


def weeks_to_quarter_buckets(forecast: DataFrame) -> DataFrame:
    """Sums of consecutive 13-week blocks of a forecast; the last block may be shorter."""
    bucket = F.floor((F.col("step") - 1) / WEEKS_PER_QUARTER).cast("int") + 1
    return forecast.groupBy("product_id", bucket.alias("bucket")).agg(F.sum("forecast").alias("demand"))


def tail_k(series: DataFrame, k: int) -> DataFrame:
    """Last `k` rows of each product."""
    return series.withColumn("_rank", F.row_number().over(from_end())).where(F.col("_rank") <= k).drop("_rank")


def backtest_split(series: DataFrame, k: int | None = 13) -> DataFrame:
    """Mark the last rows of each product as test rows: adds `is_test`, `rows`, `test_rows`.

    `k=None` uses the capacity rule: a third of the rows, four at most.
    """
    rows = F.count(F.lit(1)).over(by_product())
    test = F.least(F.lit(4), F.floor(F.col("rows") / 3)).cast("int") if k is None else F.lit(k)
    return (
        series.withColumn("rows", rows)
        .withColumn("test_rows", test)
        .withColumn("is_test", F.row_number().over(from_end()) <= F.col("test_rows"))
    )


def training_rows(series: DataFrame, k: int | None = 13, least_rows: int = 1) -> DataFrame:
    """Training rows of a backtest, the held-out rows carried along by the last one.

    `ahead` is an array of (week_end, actual) with one entry per test row, null on the other
    rows. Keeping both in one table means the history is read once and no join brings the test
    rows back. A product with fewer than `least_rows` rows before the test rows keeps just its
    last row, with `too_short` set and nothing ahead.
    """
    frame = in_time().rowsBetween(1, 4 if k is None else k)
    coming = F.collect_list(F.struct("week_end", F.col("demand").alias("actual"))).over(frame)
    split = backtest_split(series, k).withColumns(
        {
            "too_short": F.col("rows") < F.col("test_rows") + least_rows,
            "_rank": F.row_number().over(from_end()),
            "_coming": coming,
        }
    )
    short = F.col("too_short")
    ahead = F.when(~short & (F.col("_rank") == F.col("test_rows") + 1), F.col("_coming"))
    return split.where(F.when(short, F.col("_rank") == 1).otherwise(~F.col("is_test"))).select(
        "product_id", "week_end", "demand", ahead.alias("ahead"), "too_short", F.col("rows").alias("all_rows")
    )


def next_weeks(model: DataFrame, horizon: int) -> DataFrame:
    """Model rows (with `last_week`) repeated for each of the `horizon` weeks ahead."""
    steps = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("week_end", F.date_add("last_week", F.col("step") * 7))


def held_out_weeks(model: DataFrame) -> DataFrame:
    """Model rows repeated for each held-out week: `step`, `week_end`, `actual` (all null for
    a product too short to test)."""
    return model.select("*", F.posexplode_outer("ahead").alias("_pos", "_week")).select(
        *model.columns, (F.col("_pos") + 1).alias("step"), F.col("_week.week_end"), F.col("_week.actual")
    )


CARRIED = ("ahead", "too_short", "all_rows")


def order_series(df: DataFrame) -> DataFrame:
    """Rows by product, year and quarter."""
    return df.orderBy("product_id", "year", "quarter_num")


def with_quarter_index(series: DataFrame) -> DataFrame:
    return series.withColumn("quarter_index", quarter_index_of_date(F.col("week_end")))
