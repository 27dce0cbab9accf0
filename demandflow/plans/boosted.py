"""Boosted-tree forecasts, their backtests and the search over their parameters.

Spark trains one pooled model a group of products (calm and flagged ones) on rows that are each scaled
by their product's mean, in place of one small model per product. The horizon is walked week by week because each
forecast is the next week's lag. A product's state is one row with its latest values as an
array, so a step is a narrow projection without a shuffle; a column says whose model it takes.

A backtest trains on the rows before each product's own held-out weeks only; these weeks travel
along as a short array on the state row and are compared when the walk is over. A boosted model of
many trees holds those of fewer trees, so the search fits the largest number only and walks one
state row per product and number of trees.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product as cartesian

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.functions.calendar import date_features
from demandflow.functions.numeric import (
    blend_weight,
    boundary_blend_weight,
    clip,
    median_of,
    ratio,
    zero_floor,
)
from demandflow.operators.outliers import outliers_auto, outliers_clip
from demandflow.operators.series import CARRIED, by_product, from_end, held_out_weeks, in_time, training_rows
from demandflow.operators.stats import best_params, forecast_accuracy
from demandflow.operators.windows import (
    BOUNDARY_LAGS,
    DEMAND_LAGS,
    boundary_features,
    ewm_of,
    next_ewm_state,
    volatility,
    weekly_features,
    with_ewm,
)
from demandflow.plans.boundary import MIN_TRAIN_ROWS, boundary_model, boundary_seasonal_value, pulled
from demandflow.plans.seasonal import SPIKE, _flag, backtest_metrics, seasonal_model, seasonal_value
from demandflow.session import cut_lineage


@dataclass(frozen=True)
class TreeParams:
    trees: int = 200
    depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8  # share of the features that a split chooses from
    min_rows: int = 3
    seed: int = 42

    def slower(self) -> TreeParams:
        """For flagged products: half the rate, half as many trees again."""
        return replace(self, learning_rate=self.learning_rate / 2, trees=int(self.trees * 1.5))


# Default parameters and the search grid.
DEMAND_TREES = TreeParams()
BOUNDARY_TREES = TreeParams(trees=100, depth=3, min_rows=1)
TREE_GRID = {"trees": (100, 200, 300), "learning_rate": (0.01, 0.05, 0.1), "depth": (3, 5, 7), "min_rows": (1, 3, 5)}
MIN_ROWS_FOR_SEARCH = 52 + 13

CALM, FLAGGED = "calm", "flagged"

DEMAND_DATES = (
    "quarter", "month", "week", "week_of_quarter", "is_quarter_end", "year",
    "quarter_week_interaction", "quarter_squared",
)
DEMAND_STATE = ("q_q_change", "rolling_median_4", "direction", "ewm_mean", "ewm_std", "volatility")
BOUNDARY_DATES = ("quarter", "month", "week", "day_of_year", "day_of_month", "day_of_week", "year")
BOUNDARY_STATE = (
    "rolling_median_4", "rolling_std_4", "rolling_median_8", "rolling_std_8", "ewm_mean", "ewm_std",
)

STEPS_PER_CHECKPOINT = 4


@dataclass(frozen=True)
class Setup:
    """What a walk needs: training rows, one state row a product (both with `group`), and the step's expressions."""

    training: DataFrame
    columns: list[str]
    state: DataFrame
    values: int  # of the history that a state row holds
    features: Callable[[Column, Column, Column], list[Column]]
    blended: Callable[[Column, Column, Column], Column]


def _demand_setup(series: DataFrame, flagged_ids: Sequence[str], spike: float, carry: Sequence[str] = ()) -> Setup:
    """Of the weekly series, written once first: training, seasonal model and state all read it.

    Features of a week use the weeks before it only. A product with a missing feature gets the
    seasonal value for that week.
    """
    flagged = _flag(flagged_ids)
    group = F.when(flagged, FLAGGED).otherwise(CALM)
    series = cut_lineage(series)
    cleaned = outliers_auto(series, flagged, spike).select(
        "product_id", "week_end", F.col("adjusted").alias("demand"), "cv"
    )
    scaled = _scaled(cleaned)
    lags = [f"lag_{k}" for k in DEMAND_LAGS]
    columns = [*lags, *DEMAND_STATE, *DEMAND_DATES]
    known = weekly_features(scaled)
    training = known.withColumns({c: F.lag(c, 1).over(in_time()) for c in DEMAND_STATE}).dropna(
        subset=["demand", *columns]
    )
    seasonal = seasonal_model(series, flagged_ids, spike, carry=carry).drop("last_week")
    state = _latest(scaled, max(DEMAND_LAGS), F.max("cv").alias("cv")).join(seasonal, "product_id")

    def features(hist: Column, state: Column, day: Column) -> list[Column]:
        ewm = ewm_of(state)
        newer, older = median_of(F.slice(hist, 1, 4)), median_of(F.slice(hist, 5, 4))
        parts = date_features(day)
        change = clip(F.coalesce(ratio(F.get(hist, F.lit(0)), F.get(hist, F.lit(13))), F.lit(1.0)), 0.1, 10.0)
        return [
            *[F.get(hist, F.lit(k - 1)) for k in DEMAND_LAGS],
            change,
            newer,
            F.when(newer > older, 1).otherwise(0),
            ewm["ewm_mean"],
            ewm["ewm_std"],
            volatility(ewm["ewm_mean"], ewm["ewm_std"]),
            *[parts[c] for c in DEMAND_DATES],
        ]

    def blended(trees: Column, day: Column, step: Column) -> Column:
        calm_mean = F.when(F.col("overall") > 0, F.col("cv"))
        weight = blend_weight(step, F.col("rows"), calm_mean, flagged)
        base = seasonal_value(day)
        return zero_floor(F.coalesce(weight * trees + (1 - weight) * base, base))

    return Setup(training.withColumn("group", group), columns, state.withColumn("group", group), max(DEMAND_LAGS), features, blended)


def _boundary_setup(series: DataFrame, spike: float, carry: Sequence[str] = ()) -> Setup:
    """Of a capacity series. A missing feature takes its mean over the product's training rows (`fills`);
    a product with fewer than five of these gets its plain mean."""
    series = cut_lineage(series)
    cleaned = outliers_clip(series, spike).select("product_id", "week_end", F.col("adjusted").alias("demand"))
    scaled = _scaled(cleaned)
    lags = [f"lag_{k}" for k in BOUNDARY_LAGS]
    columns = [*lags, *BOUNDARY_STATE, *BOUNDARY_DATES]
    training = (
        boundary_features(scaled)
        .withColumns({c: F.lag(c, 1).over(in_time()) for c in BOUNDARY_STATE})
        .dropna(subset=["demand", *columns])
    )
    fitted = training.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("complete"), F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("fills")
    )
    values = max(*BOUNDARY_LAGS, 8)
    model = boundary_model(series, spike, carry).drop("last_week").join(fitted, "product_id", "left")
    state = _latest(scaled, values).join(model, "product_id")

    def features(hist: Column, state: Column, day: Column) -> list[Column]:
        ewm = ewm_of(state, 4)
        parts = date_features(day)
        rolled = [f for w in (4, 8) for f in (median_of(F.slice(hist, 1, w)), _sample_std(F.slice(hist, 1, w), max(2, w // 2)))]
        found = [
            *[F.get(hist, F.lit(k - 1)) for k in BOUNDARY_LAGS],
            *rolled,
            ewm["ewm_mean"],
            ewm["ewm_std"],
            *[parts[c] for c in BOUNDARY_DATES],
        ]
        return [F.coalesce(c.cast("double"), F.get("fills", F.lit(i))) for i, c in enumerate(found)]

    def blended(trees: Column, day: Column, step: Column) -> Column:
        weight = boundary_blend_weight(step, F.col("observations"))
        mixed = pulled(weight * trees + (1 - weight) * boundary_seasonal_value(day))
        few = F.coalesce(F.col("complete"), F.lit(0)) < MIN_TRAIN_ROWS
        return zero_floor(F.when(few, F.col("level")).otherwise(F.coalesce(mixed, F.col("level"))))

    return Setup(training.withColumn("group", F.lit(CALM)), columns, state.withColumn("group", F.lit(CALM)), values, features, blended)


def gbt_blend_forecast(
    series: DataFrame,
    horizon: int = 13,
    flagged_ids: Sequence[str] = (),
    spike: float = SPIKE,
    params: TreeParams = DEMAND_TREES,
) -> DataFrame:
    """product_id, week_end, step, forecast: trees blended with the seasonal forecast.

    Flagged products have a model of their own, trained on their rows with half the rate and half
    as many trees again.
    """
    setup = _demand_setup(series, flagged_ids, spike)
    models = _fit(setup, {CALM: params, FLAGGED: params.slower()} if flagged_ids else {CALM: params})
    return _weeks_ahead(_walk(setup, models, horizon))


def boundary_forecast(
    series: DataFrame, horizon: int = 13, spike: float = 2.5, params: TreeParams = BOUNDARY_TREES
) -> DataFrame:
    """Capacity forecast: trees blended with mean and quarter factor, pulled to the mean."""
    setup = _boundary_setup(series, spike)
    return _weeks_ahead(_walk(setup, _fit(setup, {CALM: params}), horizon))


def gbt_backtest_pairs(series: DataFrame, k: int = 13, spike: float = SPIKE, params: TreeParams = DEMAND_TREES) -> DataFrame:
    """Forecast the last `k` weeks from the ones before: product_id, too_short, week_end, actual,
    predicted. A product with no more than `k` rows gives one row without week.

    The pooled model sees no product's held-out weeks; a backtest knows no flagged products.
    """
    setup = _demand_setup(training_rows(series, k), (), spike, CARRIED)
    return _held_out(_walk(setup, _fit(setup, {CALM: params}), k))


def gbt_backtest(series: DataFrame, k: int = 13, spike: float = SPIKE, params: TreeParams = DEMAND_TREES) -> DataFrame:
    return backtest_metrics(gbt_backtest_pairs(series, k, spike, params))


def boundary_backtest_pairs(series: DataFrame, spike: float = 2.5, params: TreeParams = BOUNDARY_TREES) -> DataFrame:
    """Backtest pairs of the capacity forecast over the last third of the rows, four at most."""
    setup = _boundary_setup(training_rows(series, None, MIN_TRAIN_ROWS), spike, CARRIED)
    return _held_out(_walk(setup, _fit(setup, {CALM: params}), 4))


def boundary_backtest(series: DataFrame, spike: float = 2.5, params: TreeParams = BOUNDARY_TREES) -> DataFrame:
    return backtest_metrics(boundary_backtest_pairs(series, spike, params))


def tree_grid_scores(
    series: DataFrame,
    grid: Mapping[str, Sequence] = TREE_GRID,
    k: int = 13,
    spike: float = SPIKE,
    params: TreeParams = DEMAND_TREES,
    at_once: int = 4,
) -> DataFrame:
    """Backtest accuracy per product and grid point: product_id, all_rows, grid_idx, params, mae, rmse, mape, mpe.

    One fit per rate, depth and least rows, of the largest number of trees; the smaller models are its first
    trees. Driver threads, `at_once` of them, only hand jobs to Spark and wait.
    """
    setup = _demand_setup(training_rows(series, k), (), spike, CARRIED)
    counts = list(grid["trees"])
    vectors = _vectors(setup)
    # Every stage of a product is a state row of its own, since each feeds its own forecasts back.
    staged = setup.state.withColumn("group", F.explode(F.array(*[F.lit(str(n)) for n in counts])))
    setup = replace(setup, state=cut_lineage(staged))
    places = {point: i for i, point in enumerate(cartesian(*(grid[name] for name in ("trees", "learning_rate", "depth", "min_rows"))))}

    def scored(point: tuple) -> DataFrame:
        rate, depth, least = point
        whole = _trained(vectors[CALM], replace(params, trees=max(counts), learning_rate=rate, depth=depth, min_rows=least)) if CALM in vectors else None
        models = {str(n): first_trees(whole, n) for n in counts} if whole else {}
        pairs = _held_out(_walk(setup, models, k), "all_rows", "group")
        # The two keys below are functions of `group`, which `places` numbers in grid order.
        of = lambda value: F.create_map(*[F.lit(x) for n in counts for x in (str(n), value(n))])[F.col("group")]
        named = F.struct(of(lambda n: n).alias("trees"), F.lit(float(rate)).alias("learning_rate"), F.lit(depth).alias("depth"), F.lit(least).alias("min_rows"))
        pairs = pairs.select("product_id", "all_rows", of(lambda n: places[n, rate, depth, least]).alias("grid_idx"), named.alias("params"), "actual", "predicted")
        return cut_lineage(forecast_accuracy(pairs, "product_id", "all_rows", "grid_idx", "params"))

    with ThreadPoolExecutor(at_once) as pool:
        tables = list(pool.map(scored, cartesian(grid["learning_rate"], grid["depth"], grid["min_rows"])))
    return reduce(DataFrame.unionByName, tables)


def tree_grid_search(series: DataFrame, grid: Mapping[str, Sequence] = TREE_GRID, k: int = 13, **options) -> DataFrame:
    """Best tree parameters per product by backtest MAPE, the first grid point of equals: product_id, trees,
    learning_rate, depth, min_rows, mape; defaults with a null mape for a series under 65 rows or without any
    scored point."""
    best = best_params(tree_grid_scores(series, grid, k, **options), "all_rows")
    usual = DEMAND_TREES
    defaults = F.struct(F.lit(usual.trees).alias("trees"), F.lit(usual.learning_rate).alias("learning_rate"), F.lit(usual.depth).alias("depth"), F.lit(usual.min_rows).alias("min_rows"))
    tuned = F.col("all_rows") >= MIN_ROWS_FOR_SEARCH
    chosen = best.select("product_id", F.coalesce(F.when(tuned, F.col("params")), defaults).alias("params"), F.when(tuned, F.col("mape")).alias("mape"))
    return chosen.select("product_id", "params.*", "mape")


def _scaled(cleaned: DataFrame) -> DataFrame:
    """Demand over its product's mean (over 1 when that is not positive), with the scale."""
    mean = F.avg("demand").over(by_product())
    scale = F.when(mean > 0, mean).otherwise(1.0)
    return cleaned.withColumn("scale", scale).withColumn("demand", F.col("demand") / F.col("scale"))


def _sample_std(values: Column, least: int) -> Column:
    known = F.filter(values, lambda v: v.isNotNull())
    n = F.size(known)
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(F.transform(known, lambda v: (v - total / n) * (v - total / n)), F.lit(0.0), lambda a, v: a + v)
    return F.when(n >= least, F.sqrt(squares / F.greatest(n - 1, F.lit(1))))


def _latest(scaled: DataFrame, values: int, *measures: Column) -> DataFrame:
    """One row per product: its last `values` values, newest first, as `hist`, and its `ewm_state`.

    The lags need no more values than the longest of them; the state stands for the whole history.
    """
    ranked = with_ewm(scaled, keep_state=True).withColumn("_rank", F.row_number().over(from_end()))
    latest = F.when(F.col("_rank") <= values, F.struct("_rank", "demand"))
    kept = F.array_sort(F.collect_list(latest))
    return ranked.groupBy("product_id").agg(
        F.transform(kept, lambda r: r["demand"]).alias("hist"),
        F.max("week_end").alias("last_week"),
        F.max("scale").alias("scale"),
        F.max_by("ewm_state", "week_end").alias("ewm_state"),
        *measures,
    )


def _vectors(setup: Setup) -> dict[str, DataFrame]:
    """Training vectors by group, written once; groups without a complete row are left out."""
    rows = setup.training.select(
        "group",
        array_to_vector(F.array(*[F.col(c).cast("double") for c in setup.columns])).alias("features"),
        F.col("demand").alias("label"),
    )
    rows = cut_lineage(rows)
    return {r["group"]: rows.where(F.col("group") == r["group"]) for r in rows.select("group").distinct().collect()}


def _trained(vectors: DataFrame, params: TreeParams) -> GBTRegressionModel:
    trees = GBTRegressor(
        maxIter=params.trees,
        maxDepth=params.depth,
        stepSize=params.learning_rate,
        subsamplingRate=params.subsample,
        featureSubsetStrategy=str(params.columns) if params.columns < 1 else "all",
        minInstancesPerNode=params.min_rows,
        seed=params.seed,
    )
    return trees.fit(vectors)


def _fit(setup: Setup, params: Mapping[str, TreeParams]) -> dict[str, GBTRegressionModel]:
    """The pooled model of each group that has complete rows."""
    vectors = _vectors(setup)
    wanted = {group: p for group, p in params.items() if group in vectors}
    # Side by side: a fit is many small jobs one after another.
    with ThreadPoolExecutor(max(1, len(wanted))) as pool:
        return dict(zip(wanted, pool.map(lambda group: _trained(vectors[group], wanted[group]), wanted)))


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The model after its first `count` rounds: each round adds a tree and changes none."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    java, gateway = spark._jvm.org.apache.spark.ml.regression, spark.sparkContext._gateway
    whole, weights = model._java_obj.trees(), model._java_obj.treeWeights()
    trees = gateway.new_array(java.DecisionTreeRegressionModel, count)
    shares = gateway.new_array(gateway.jvm.double, count)
    for i in range(count):
        trees[i], shares[i] = whole[i], weights[i]
    return GBTRegressionModel(java.GBTRegressionModel(f"{model.uid}_{count}", trees, shares, model.numFeatures))


def _walk(setup: Setup, models: Mapping[str, GBTRegressionModel], horizon: int) -> DataFrame:
    """State rows with the forecasts of `horizon` weeks as `path`.

    Week by week, each value is fed back as the newest of `hist` and `ewm_state` moves on with it. Every
    step has the same expressions over `hist`, `ewm_state`, `_day` and `_step`, which are built once; a row
    takes the model of its `group`, and none where there is no such model.
    """
    state = setup.state
    keep = [c for c in state.columns if c not in ("hist", "ewm_state")]
    inputs = F.array(*[c.cast("double") for c in setup.features(F.col("hist"), F.col("ewm_state"), F.col("_day"))])
    vector = array_to_vector(F.transform("_x", lambda x: F.coalesce(x, F.lit(0.0))))
    tree = F.lit(None).cast("double")
    if models:
        # In one conditional, so that only the row's own model is evaluated.
        own = reduce(lambda c, i: c.when(F.col("group") == i[1], F.col(f"_p{i[0]}")), enumerate(models), F)
        tree = F.when(~F.exists("_x", lambda x: x.isNull()), own * F.col("scale"))
    value = setup.blended(tree, F.col("_day"), F.col("_step"))
    grown = [
        F.concat(F.array(F.col("_value") / F.col("scale")), F.slice("hist", 1, setup.values - 1)).alias("hist"),
        next_ewm_state(F.col("ewm_state"), F.col("_value") / F.col("scale")).alias("ewm_state"),
        F.concat("path", F.array("_value")).alias("path"),
    ]
    walked = state.withColumn("path", F.array().cast("array<double>"))
    for step in range(horizon):
        day = F.date_add("last_week", 7 * (step + 1))
        walked = walked.withColumns({"_day": day, "_step": F.lit(step)}).withColumn("_x", inputs)
        if models:
            walked = walked.withColumn("features", vector)
        for i, model in enumerate(models.values()):
            walked = model.setPredictionCol(f"_p{i}").transform(walked)
        walked = walked.withColumn("_value", value).select(*keep, *grown)
        if (step + 1) % STEPS_PER_CHECKPOINT == 0 and step + 1 < horizon:
            walked = cut_lineage(walked)
    return walked


def _weeks_ahead(walked: DataFrame) -> DataFrame:
    """A row for each week of the path.

    The outer explode matters: for an inner one Spark would infer a filter on the path and push
    it, with every step's expression inlined, below all steps.
    """
    return walked.select("product_id", "last_week", F.posexplode_outer("path").alias("_pos", "forecast")).select(
        "product_id",
        F.date_add("last_week", (F.col("_pos") + 1) * 7).alias("week_end"),
        (F.col("_pos") + 1).alias("step"),
        "forecast",
    )


def _held_out(walked: DataFrame, *keep: str) -> DataFrame:
    """A row for each held-out week, with what the path has for it."""
    # Cut first: the explode would repeat the last steps' expressions for each week.
    weeks = held_out_weeks(cut_lineage(walked.select("product_id", "too_short", "ahead", "path", *keep)))
    return weeks.select("product_id", "too_short", *keep, "week_end", "actual", F.get("path", F.col("step") - 1).alias("predicted"))
