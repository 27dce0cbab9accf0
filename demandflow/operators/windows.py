"""Lag, rolling and exponentially weighted features of weekly series.

Every window partitions by product and orders by week, so one shuffle and one sort serve all
of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandflow.functions.calendar import date_features
from demandflow.functions.numeric import clip, median_of, ratio
from demandflow.operators.series import by_product, from_end, in_time

# Lags of the demand model and of the capacity model.
DEMAND_LAGS = (1, 2, 4, 13, 52)
BOUNDARY_LAGS = (1, 2, 4, 8, 13)

EWM_SPAN = 8
EWM_DECAY = (EWM_SPAN - 1) / (EWM_SPAN + 1)
EWM_BLOCK = 128  # rows folded together; any number gives the same values


def row_count() -> Column:
    """Number of rows of the product's series."""
    return F.count(F.lit(1)).over(by_product())


def lag_columns(lags: Sequence[int], value: str = "demand") -> dict[str, Column]:
    """`lag_k` columns."""
    return {f"lag_{k}": F.lag(value, k).over(in_time()) for k in lags}


def rolling_median(window: int, value: str = "demand", shift: int = 0) -> Column:
    """Median of the non-null values among `window` rows ending `shift` rows back."""
    frame = in_time().rowsBetween(-(window - 1) - shift, -shift)
    return F.percentile(value, F.lit(0.5)).over(frame)


def rolling_std(window: int, value: str = "demand") -> Column:
    """Sample deviation of the last `window` rows; null under max(2, window / 2) values."""
    frame = in_time().rowsBetween(-(window - 1), 0)
    enough = F.count(value).over(frame) >= max(2, window // 2)
    return F.when(enough, F.stddev_samp(value).over(frame))


def with_ewm(
    series: DataFrame,
    value: str = "demand",
    min_points_std: int = 2,
    block: int = EWM_BLOCK,
    keep_state: bool = False,
) -> DataFrame:
    """Add `ewm_mean` and bias-corrected `ewm_std` (span 8, weights by distance in rows).

    Missing values carry no weight. The whole history counts. A product's weeks are cut into
    blocks of `block` rows; each block is folded alone to the weight, mean and squares it leaves,
    what the blocks before leave is put together, and the block's rows are then folded on from
    there. So work is in proportion to the rows, and no array holds more than a block's rows or a
    product's blocks. `keep_state` adds the running figures as `ewm_state`.
    """
    columns = [c for c in series.columns if c != "product_id"]
    numbered = series.withColumn("_block", F.floor((F.row_number().over(in_time()) - 1) / block))
    rows = F.array_sort(F.collect_list(F.struct(F.col("week_end").alias("_at"), *columns)))
    packed = numbered.groupBy("product_id", "_block").agg(rows.alias("_rows"))
    alone = F.aggregate("_rows", _no_weight(), lambda acc, row: _weighted_step(_decayed(acc), row[value]))
    packed = packed.withColumn("_left", F.struct(alone.alias("s"), F.size("_rows").alias("rows")))
    before = by_product().orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    packed = packed.withColumn("_before", F.collect_list("_left").over(before))
    carried = F.aggregate("_before", _no_weight(), lambda acc, x: _joined(_decayed(acc, x["rows"]), x["s"]))
    kind = "struct<mean:double,std:double,s:struct<w:double,w2:double,mean:double,m2:double,n:int>>"

    def step(acc: Column, row: Column) -> Column:
        grown = _weighted_step(_decayed(acc["s"]), row[value])
        stats = _ewm_result(grown, min_points_std)
        shown = F.struct(stats["mean"].alias("mean"), stats["std"].alias("std"), grown.alias("s")).cast(kind)
        return F.struct(grown.alias("s"), F.concat(acc["path"], F.array(shown)).alias("path"))

    start = F.struct(carried.alias("s"), F.array().cast(f"array<{kind}>").alias("path"))
    path = F.aggregate("_rows", start, step, lambda acc: acc["path"])

    def merged(row: Column, e: Column) -> Column:
        added = [e["mean"].alias("ewm_mean"), e["std"].alias("ewm_std")]
        if keep_state:
            added.append(e["s"].alias("ewm_state"))
        return F.struct(*[row[c].alias(c) for c in columns], *added)

    return packed.select("product_id", F.inline_outer(F.zip_with("_rows", path, merged)))


def ewm_of(state: Column, min_points_std: int = 2) -> dict[str, Column]:
    """`ewm_mean` and `ewm_std` of an `ewm_state`."""
    stats = _ewm_result(state, min_points_std)
    return {"ewm_mean": stats["mean"], "ewm_std": stats["std"]}


def next_ewm_state(state: Column, v: Column) -> Column:
    """`ewm_state` one row later, with that row's value."""
    return _weighted_step(_decayed(state), v)


def _no_weight() -> Column:
    names = ("w", "w2", "mean", "m2")
    return F.struct(*[F.lit(0.0).alias(c) for c in names], F.lit(0).alias("n"))


def _decayed(s: Column, rows: int | Column = 1) -> Column:
    """State some rows later: every weight shrinks by the decay, once a row."""
    by = F.lit(EWM_DECAY) if isinstance(rows, int) and rows == 1 else F.pow(F.lit(EWM_DECAY), rows)
    return F.struct(
        (s["w"] * by).alias("w"),
        (s["w2"] * by * by).alias("w2"),
        s["mean"].alias("mean"),
        (s["m2"] * by).alias("m2"),
        s["n"].alias("n"),
    )


def _joined(a: Column, b: Column) -> Column:
    """State of both parts' observations together."""
    w, delta = a["w"] + b["w"], b["mean"] - a["mean"]
    both = F.struct(
        w.alias("w"),
        (a["w2"] + b["w2"]).alias("w2"),
        (a["mean"] + delta * b["w"] / w).alias("mean"),
        (a["m2"] + b["m2"] + delta * delta * a["w"] * b["w"] / w).alias("m2"),
        (a["n"] + b["n"]).alias("n"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _weighted_step(s: Column, v: Column) -> Column:
    """Add one observation of weight 1 to the running weighted mean and sum of squares."""
    delta = v - s["mean"]
    share = delta / (s["w"] + 1)
    added = F.struct(
        (s["w"] + 1).alias("w"),
        (s["w2"] + 1).alias("w2"),
        (s["mean"] + share).alias("mean"),
        (s["m2"] + delta * (delta - share)).alias("m2"),
        (s["n"] + 1).alias("n"),
    )
    return F.when(v.isNotNull(), added).otherwise(s)


def _ewm_result(s: Column, min_points_std: int) -> Column:
    spread = s["m2"] * s["w"] / F.nullif(s["w"] * s["w"] - s["w2"], F.lit(0.0))
    return F.struct(
        F.when(s["n"] >= 1, s["mean"]).alias("mean"),
        F.when(s["n"] >= max(2, min_points_std), F.sqrt(spread)).alias("std"),
    )


def ratio_to_lag13(value: str = "demand") -> Column:
    """Change against a quarter ago, 1 when unknown, limited to 0.1-10."""
    change = ratio(F.col(value), F.lag(value, 13).over(in_time()))
    return clip(F.coalesce(change, F.lit(1.0)), 0.1, 10.0)


def direction(value: str = "demand") -> Column:
    """1 when the median of the last four weeks exceeds that of the four before, else 0."""
    newer, older = rolling_median(4, value), rolling_median(4, value, shift=4)
    return F.when(newer > older, 1).otherwise(0)


def volatility(mean: Column, std: Column) -> Column:
    """Weighted deviation over weighted mean, 0 when unknown, limited to 0-2."""
    return clip(F.coalesce(ratio(std, mean), F.lit(0.0)), 0.0, 2.0)


def weekly_features(series: DataFrame) -> DataFrame:
    """Demand-model features. A feature is null throughout when the series is too short for it."""
    out = with_ewm(series).withColumn("rows", row_count())
    n = F.col("rows")
    longer = {f"lag_{k}": n > k for k in DEMAND_LAGS}
    out = out.withColumns({c: F.when(longer[c], e) for c, e in lag_columns(DEMAND_LAGS).items()})
    out = out.withColumns(
        {
            "q_q_change": F.when(n > 13, ratio_to_lag13()),
            "rolling_median_4": F.when(n > 4, rolling_median(4)),
            "direction": F.when(n > 8, direction()),
            **{c: F.when(n > 8, F.col(c)) for c in ("ewm_mean", "ewm_std")},
        }
    )
    parts = date_features(F.col("week_end"))
    dates = (
        "quarter", "month", "week", "week_of_quarter", "is_quarter_end", "year",
        "quarter_week_interaction", "quarter_squared",
    )
    return out.withColumns(
        {
            "volatility": F.when(n > 8, volatility(F.col("ewm_mean"), F.col("ewm_std"))),
            **{c: parts[c] for c in dates},
        }
    )


def boundary_features(series: DataFrame) -> DataFrame:
    """Capacity-model features, null throughout when the series is too short for them."""
    out = with_ewm(series, min_points_std=4).withColumn("rows", row_count())
    n = F.col("rows")
    parts = date_features(F.col("week_end"))
    dates = ("quarter", "month", "week", "day_of_year", "day_of_month", "day_of_week", "year")
    return out.withColumns(
        {
            **{f"lag_{k}": F.when(n > k, F.lag("demand", k).over(in_time())) for k in BOUNDARY_LAGS},
            **{f"rolling_median_{w}": F.when(n >= w, rolling_median(w)) for w in (4, 8)},
            **{f"rolling_std_{w}": F.when(n >= w, rolling_std(w)) for w in (4, 8)},
            **{c: F.when(n > 4, F.col(c)) for c in ("ewm_mean", "ewm_std")},
            **{c: parts[c] for c in dates},
        }
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores per product with the population deviation; a constant column becomes 0."""
    scaled = {}
    for c in columns:
        mean, std = F.avg(c).over(by_product()), F.stddev_pop(c).over(by_product())
        scaled[c] = (F.col(c) - mean) / F.when(std > 0, std).otherwise(1.0)
    return df.withColumns(scaled)


def recent_spike(series: DataFrame, spike: float = 2.5) -> DataFrame:
    """Per product: last value, median of the (up to) three before it, and whether it spikes.

    Missing weeks are left out first.
    """
    ranked = series.where(F.col("demand").isNotNull()).withColumn("_rank", F.row_number().over(from_end()))
    last = ranked.where(F.col("_rank") <= 4).groupBy("product_id").agg(
        *[F.max(F.when(F.col("_rank") == i, F.col("demand"))).alias(f"_v{i}") for i in range(1, 5)]
    )
    before = median_of(F.array("_v2", "_v3", "_v4"))
    return last.select("product_id", F.col("_v1").alias("last_value"), before.alias("previous_median")).withColumn(
        "is_spike",
        F.coalesce(F.col("last_value") > F.col("previous_median") * (1 + spike / 5), F.lit(False)),
    )


def ramp_envelope(
    inputs: DataFrame, capacity: str = "capacity", max_decrease: float = 560.0
) -> DataFrame:
    """Largest plan that stays within capacity and never drops by more than `max_decrease`.

    Per product and quarter: the least of every later week's capacity plus the drop allowed
    until then.
    """
    ahead = (
        W.partitionBy("product_id", "quarter")
        .orderBy("week_seq")
        .rowsBetween(0, W.unboundedFollowing)
    )
    slope = F.col("week_seq") * max_decrease
    return inputs.withColumn("envelope", F.min(F.col(capacity) + slope).over(ahead) - slope)
