"""Weekly production plan within capacity, lot size, ramp-down and inventory band.

Per product and quarter the plan works in lots. The largest plan that respects capacity and
ramp is cut evenly until the inventory band's upper edge holds; the last lots are then put
back from the quarter's end. Cutting every week by the same number of lots, and raising only a
run of last weeks, both keep the ramp limit. The result is within one lot of the best total.

A quarter's weeks (14 at most) travel as one row with short arrays, so the steps below are
narrow projections; a product's quarters are folded in order for the rolling plan.

Results are exploded with the outer form, although no array is empty: for the inner one Spark
infers a filter on the array and would evaluate the whole plan a second time for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.lookups import complete_quarters, facts_by_quarter, previous_quarter_balance, unique_priorities
from demandflow.session import cut_lineage


@dataclass(frozen=True)
class PlanLimits:
    """Lot size, least wafers a week, largest weekly decrease, band of the excess over SST."""

    lot: int = 5
    min_week: float = 350
    max_decrease: float = 560
    lo: float = 70_000_000.0
    hi: float = 140_000_000.0

    @property
    def min_lots(self) -> int:
        return -int(-self.min_week // self.lot)

    @property
    def ramp_lots(self) -> int:
        return int(self.max_decrease // self.lot)


@dataclass(frozen=True)
class QuarterLimits:
    """The same as columns, for limits that change from quarter to quarter."""

    lot: Column
    min_lots: Column
    ramp_lots: Column
    lo: Column
    hi: Column

    @staticmethod
    def of(quarter: Column) -> QuarterLimits:
        return QuarterLimits(*(quarter[name] for name in ("lot", "min_lots", "ramp_lots", "lo", "hi")))


#: Quarters planned with a band; from then on the excess has to be exactly 0.
BAND_QUARTERS = 34
#: Quarters of a bucket in the join of quarters with limits.
LIMIT_BUCKET = 8


def with_limits(
    packed: DataFrame, table: DataFrame, default: PlanLimits = PlanLimits(), exact_after: int | None = BAND_QUARTERS
) -> DataFrame:
    """Add `limits`, a struct, to packed quarters.

    `table`: product_id (null for all products), from_index and until_index (quarter indexes, the latter excluded and
    null for no end), lot, min_week, max_decrease, lo, hi, of which a null means the default's. Of several
    intervals that hold a quarter a product's own goes before a common one, then the latest begun, then the
    smallest values; without any the default holds. After `exact_after` quarters from the table's first one the
    band is [0, 0].

    An interval meets a quarter by bucket, not by comparing all pairs: it is repeated once for each bucket that
    it touches between the first and the last planned quarter.
    """
    span = packed.agg(F.min("quarter_index").alias("first"), F.max("quarter_index").alias("last")).first()
    first, last = span["first"] or 0, span["last"] or 0
    start = F.greatest(F.col("from_index"), F.lit(first))
    end = F.least(F.coalesce(F.col("until_index") - 1, F.lit(last)), F.lit(last))
    usual = {"lot": default.lot, "min_week": default.min_week, "max_decrease": default.max_decrease, "lo": default.lo, "hi": default.hi}
    kinds = {"lot": "int"}
    values = [F.coalesce(F.col(c), F.lit(v)).cast(kinds.get(c, "double")).alias(c) for c, v in usual.items()]
    buckets = F.explode(F.sequence(F.floor(start / LIMIT_BUCKET).cast("int"), F.floor(end / LIMIT_BUCKET).cast("int")))
    spans = table.where(start <= end).select(
        F.col("product_id").alias("_product"), F.col("from_index").alias("_from"), end.alias("_to"), F.struct(*values).alias("_values"), buckets.alias("_bucket")
    )
    quarter = packed.select("product_id", F.col("quarter_index").cast("int").alias("quarter_index")).distinct()
    quarter = quarter.withColumn("_bucket", F.floor(F.col("quarter_index") / LIMIT_BUCKET).cast("int"))
    held = (F.col("quarter_index") >= F.col("_from")) & (F.col("quarter_index") <= F.col("_to"))
    own = quarter.join(spans.where("_product is not null"), (F.col("product_id") == F.col("_product")) & (quarter["_bucket"] == spans["_bucket"])).where(held)
    common = quarter.join(spans.where("_product is null"), quarter["_bucket"] == spans["_bucket"]).where(held)
    rank = F.struct((F.col("_product").isNull()).alias("common"), (-F.col("_from")).alias("age"), "_values")
    found = own.select("product_id", "quarter_index", rank.alias("r")).unionByName(common.select("product_id", "quarter_index", rank.alias("r")))
    chosen = found.groupBy(F.col("product_id").alias("_p"), F.col("quarter_index").alias("_q")).agg(F.min("r")["_values"].alias("_v"))
    joined = packed.join(chosen, (packed["product_id"] == F.col("_p")) & (packed["quarter_index"] == F.col("_q")), "left")
    v = F.coalesce(F.col("_v"), F.struct(*[F.lit(x).cast(kinds.get(c, "double")).alias(c) for c, x in usual.items()]))
    exact = F.lit(False) if exact_after is None else F.col("quarter_index") >= first + exact_after
    limits = F.struct(
        v["lot"].alias("lot"),
        F.ceil(v["min_week"] / v["lot"]).cast("long").alias("min_lots"),
        F.floor(v["max_decrease"] / v["lot"]).cast("long").alias("ramp_lots"),
        F.when(exact, 0.0).otherwise(v["lo"]).alias("lo"),
        F.when(exact, 0.0).otherwise(v["hi"]).alias("hi"),
    )
    return joined.withColumn("limits", limits).select(*packed.columns, "limits")


def _limited(packed: DataFrame, limits: PlanLimits | DataFrame) -> tuple[DataFrame, Callable[[Column | None], PlanLimits | QuarterLimits]]:
    """(packed quarters, limits of a quarter given its struct, or of a row's columns given None)."""
    if isinstance(limits, PlanLimits):
        return packed, lambda q: limits
    return with_limits(packed, limits), lambda q: QuarterLimits.of(F.col("limits") if q is None else q["limits"])


def plan_inputs(facts: DataFrame, density: DataFrame, yields: DataFrame, capacity: DataFrame) -> DataFrame:
    """One row per product, quarter and week with everything the plan needs.

    Quarters without safety stock, demand, previous balance or density, or that lack the yield or
    the capacity of any of their weeks, are left out.
    """
    scalars = previous_quarter_balance(facts_by_quarter(facts, ["safety_stock", "demand", "balance"]))
    scalars = scalars.dropna(subset=["safety_stock", "demand", "opening"]).drop("balance")
    weeks = complete_quarters(yields, capacity)
    return (
        weeks.join(scalars, ["product_id", "quarter"])
        .join(density.select("product_id", F.floor("density").cast("int").alias("density")), "product_id")
        .select(
            "product_id",
            "quarter",
            "quarter_index",
            "week_seq",
            "week_label",
            (F.col("density") * F.col("yield_value")).alias("bytes_per_wafer"),
            F.col("capacity").cast("double").alias("capacity"),
            "safety_stock",
            "demand",
            "opening",
        )
    )


def pack_quarters(inputs: DataFrame, *keep: str) -> DataFrame:
    """One row per product and quarter; its weeks in order as arrays `labels`, `b`, `cap`."""
    weeks = F.array_sort(F.collect_list(F.struct("week_seq", "week_label", "bytes_per_wafer", "capacity")))
    scalars = ("safety_stock", "demand", "opening", *keep)
    packed = inputs.groupBy("product_id", "quarter", "quarter_index").agg(
        weeks.alias("_weeks"), *[F.max(c).alias(c) for c in scalars]
    )
    return packed.select(
        "product_id",
        "quarter",
        "quarter_index",
        *scalars,
        F.transform("_weeks", lambda w: w["week_seq"]).alias("seqs"),
        F.transform("_weeks", lambda w: w["week_label"]).alias("labels"),
        F.transform("_weeks", lambda w: w["bytes_per_wafer"]).alias("b"),
        F.transform("_weeks", lambda w: w["capacity"]).alias("cap"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times inside an expression while evaluating it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(b: Column, lots: Column, lot: int | Column) -> Column:
    return F.aggregate(F.zip_with(b, lots, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) * lot


def largest_lots(cap: Column, seqs: Column, limits: PlanLimits | QuarterLimits) -> Column:
    """Lots per week of the largest plan within capacity and ramp, from the last week back.

    `seqs` numbers the weeks: over a missing week the plan may drop by two weeks' decrease.
    """
    weeks = F.zip_with(
        cap,
        seqs,
        lambda c, s: F.struct(F.floor(c / limits.lot).cast("long").alias("c"), s.cast("long").alias("s")),
    )

    def back(acc: Column, week: Column) -> Column:
        later = F.get(acc["lots"], F.lit(0)) + (acc["s"] - week["s"]) * limits.ramp_lots
        lots = F.least(week["c"], F.coalesce(later, week["c"]))
        return F.struct(week["s"].alias("s"), F.concat(F.array(lots), acc["lots"]).alias("lots"))

    start = F.struct(F.lit(None).cast("long").alias("s"), F.array().cast("array<bigint>").alias("lots"))
    return F.aggregate(F.reverse(weeks), start, back, lambda acc: acc["lots"])


def _raised(leftover: Column) -> Column:
    """Capacity plus a donor's leftover of the same week, a map by week number."""
    return F.zip_with("cap", "seqs", lambda c, s: c + F.coalesce(F.try_element_at(leftover, s), F.lit(0.0)))


def cut_to_band(b: Column, largest: Column, lo: Column, hi: Column, limits: PlanLimits | QuarterLimits) -> Column:
    """Plan whose supply lies in [lo, hi]: struct(feasible, lots).

    `lots` is null when even the least plan is above, or the largest one below, the band.
    """
    floor_lots = F.lit(limits.min_lots).cast("long")

    def after_cut(cut: Column) -> Column:
        return F.transform(largest, lambda u: F.greatest(floor_lots, u - cut))

    def search(span: Column) -> Column:
        halvings = F.sequence(F.lit(1), F.ceil(F.log2(span + 2)).cast("int"))
        start = F.struct(F.lit(0).cast("long").alias("low"), span.alias("high"))

        def halve(s: Column, _: Column) -> Column:
            return _let(
                F.floor((s["low"] + s["high"]) / 2).cast("long"),
                lambda mid: F.when(
                    _total(b, after_cut(mid), limits.lot) <= hi, F.struct(s["low"].alias("low"), mid.alias("high"))
                ).otherwise(F.struct(F.least(mid + 1, s["high"]).alias("low"), s["high"].alias("high"))),
            )

        return F.aggregate(halvings, start, halve, lambda s: s["high"])

    def refill(cut: Column) -> Column:
        """Give one lot back to as long a run of last weeks as the upper edge allows."""
        base = after_cut(cut)

        def back(acc: Column, week: Column) -> Column:
            raised = F.when(cut > 0, F.greatest(floor_lots, week["u"] - cut + 1)).otherwise(week["p"])
            cost = (raised - week["p"]) * week["b"] * limits.lot
            fits = acc["open"] & (cost <= acc["room"])
            return F.struct(
                F.when(fits, acc["room"] - cost).otherwise(acc["room"]).alias("room"),
                fits.alias("open"),
                F.concat(F.array(F.when(fits, raised).otherwise(week["p"])), acc["lots"]).alias("lots"),
            )

        weeks = F.zip_with(
            F.arrays_zip(largest.alias("u"), b.alias("b")),
            base,
            lambda ub, p: F.struct(ub["u"].alias("u"), ub["b"].alias("b"), p.alias("p")),
        )
        start = F.struct(
            (hi - _total(b, base, limits.lot)).alias("room"),
            F.lit(True).alias("open"),
            F.array().cast("array<bigint>").alias("lots"),
        )
        return F.aggregate(F.reverse(weeks), start, back, lambda acc: acc["lots"])

    span = F.greatest(F.array_max(largest) - floor_lots, F.lit(0).cast("long"))
    least = F.transform(largest, lambda _: floor_lots)
    possible = (
        (F.array_min(largest) >= floor_lots)
        & (_total(b, largest, limits.lot) >= lo)
        & (_total(b, least, limits.lot) <= hi)
    )
    lots = F.when(possible, _let(search(span), refill))
    return _let(
        lots,
        lambda y: F.when(
            y.isNotNull() & (_total(b, y, limits.lot) >= lo), F.struct(F.lit(True).alias("feasible"), y.alias("lots"))
        ).otherwise(F.struct(F.lit(False).alias("feasible"), F.lit(None).cast("array<bigint>").alias("lots"))),
    )


def plan_packed(packed: DataFrame, limits: PlanLimits | QuarterLimits) -> DataFrame:
    """Add `feasible`, `band_too_narrow` and `wafers` (array) to packed quarters.

    Without a plan the wafers are the available capacity. A band narrower than the largest
    week's lot may be jumped over, which `band_too_narrow` tells.
    """
    need = F.col("safety_stock") + F.col("demand") - F.col("opening")
    planned = packed.withColumn("_u", largest_lots(F.col("cap"), F.col("seqs"), limits)).withColumn(
        "_plan", cut_to_band(F.col("b"), F.col("_u"), need + limits.lo, need + limits.hi, limits)
    )
    lots = F.transform("_plan.lots", lambda y: (y * limits.lot).cast("double"))
    return planned.withColumns(
        {
            "feasible": F.col("_plan.feasible"),
            "band_too_narrow": F.lit(limits.hi - limits.lo) < F.array_max("b") * limits.lot,
            "wafers": F.when(F.col("_plan.feasible"), lots).otherwise(F.col("cap")),
        }
    ).drop("_u", "_plan")


def unpack_plan(planned: DataFrame, *extra: str) -> DataFrame:
    """Planned quarters back to one row per week."""
    weeks = F.explode_outer(F.arrays_zip("seqs", "labels", "b", "cap", "wafers"))
    return planned.withColumn("_w", weeks).select(
        "product_id",
        "quarter",
        "quarter_index",
        F.col("_w.seqs").alias("week_seq"),
        F.col("_w.labels").alias("week_label"),
        F.col("_w.cap").alias("capacity"),
        F.col("_w.b").alias("bytes_per_wafer"),
        F.col("_w.wafers").alias("wafers"),
        "feasible",
        "band_too_narrow",
        "safety_stock",
        "demand",
        "opening",
        *extra,
    )


def capacity_plan(inputs: DataFrame, limits: PlanLimits | DataFrame = PlanLimits()) -> DataFrame:
    """Weekly wafers of every product and quarter, each quarter from its given opening stock.

    `limits` may be a table as for `with_limits`.
    """
    packed, of = _limited(pack_quarters(inputs), limits)
    return unpack_plan(plan_packed(packed, of(None)))


def yielded_supply(plan: DataFrame) -> DataFrame:
    """Wafers times bytes per wafer, summed per product and quarter."""
    return plan.groupBy("product_id", "quarter").agg(
        F.sum(F.col("wafers") * F.col("bytes_per_wafer")).alias("yielded_supply")
    )


def plan_kpis(plan: DataFrame) -> DataFrame:
    """Yielded supply, closing balance (`tpib`) and its excess over safety stock (`ibesst`)."""
    supply = plan.groupBy("product_id", "quarter").agg(
        F.sum(F.col("wafers") * F.col("bytes_per_wafer")).alias("yielded_supply"),
        *[F.max(c).alias(c) for c in ("opening", "demand", "safety_stock")],
    )
    tpib = F.col("yielded_supply") + F.col("opening") - F.col("demand")
    return supply.withColumn("tpib", tpib).select(
        "product_id", "quarter", "yielded_supply", "tpib", (F.col("tpib") - F.col("safety_stock")).alias("ibesst")
    )


def rescue_plan(inputs: DataFrame, priority: DataFrame, limits: PlanLimits = PlanLimits()) -> DataFrame:
    """Plan, and plan again with a donor's leftover capacity where no plan was found.

    The donor is the product one priority higher. It is planned on its own capacity even if it
    was rescued itself, so every rescue runs at once, whatever the number of priorities. A donor
    without a plan has nothing left. The first plans, one short row per quarter, are
    checkpointed because donors, rescues and kept plans all read them.
    `priority`: product_id, priority (1 is highest), `line` where there are several. A product
    without priority is planned without a donor. Adds `rescued`.
    """
    ranked = inputs.join(unique_priorities(priority), "product_id", "left")
    first = cut_lineage(plan_packed(pack_quarters(ranked, "line", "priority"), limits))
    donor = first.where(F.col("feasible") & F.col("priority").isNotNull()).select(
        F.col("line").alias("_line"),
        (F.col("priority") + 1).alias("_priority"),
        F.col("quarter").alias("_quarter"),
        F.map_from_arrays("seqs", F.zip_with("cap", "wafers", lambda c, w: c - w)).alias("leftover"),
    )
    lacking = first.where(~F.col("feasible"))
    same = (
        (lacking["priority"] == donor["_priority"])
        & (lacking["quarter"] == donor["_quarter"])
        & lacking["line"].eqNullSafe(donor["_line"])
    )
    raised = lacking.join(donor, same, "left").withColumn("cap", _raised(F.col("leftover")))
    second = plan_packed(raised.select(*first.columns), limits).withColumn("rescued", F.col("feasible"))
    kept = first.where(F.col("feasible")).withColumn("rescued", F.lit(False))
    return unpack_plan(kept.unionByName(second), "rescued")


_ROLLED = (
    "struct<quarter:string,quarter_index:int,feasible:boolean,rescued:boolean,opening:double,supply:double,"
    "balance:double,excess:double,seqs:array<int>,labels:array<string>,wafers:array<double>,spare:array<double>>"
)


def _quarter_fields(packed: DataFrame) -> list[str]:
    fields = ["quarter_index", "quarter", "safety_stock", "demand", "opening", "seqs", "labels", "b", "cap", "u"]
    return [*fields, "limits"] if "limits" in packed.columns else fields


def _chains(packed: DataFrame, of, *keys: str) -> DataFrame:
    """One row per product: its quarters in order, with the largest plan of each."""
    ready = packed.withColumn("u", largest_lots(F.col("cap"), F.col("seqs"), of(None)))
    quarters = F.array_sort(F.collect_list(F.struct(*_quarter_fields(packed))))
    return ready.groupBy("product_id", *keys).agg(quarters.alias("quarters"))


def _fold(quarters: Column, of, spares: Column | None = None) -> Column:
    """The quarters of a product planned in order, carrying the balance along.

    `spares` (map by quarter of maps by week number) is what a donor leaves; it is added to the capacity
    of a quarter that has no plan otherwise. The output's own `spare` is what the first plan of the
    quarter leaves, all 0 without one.
    """

    def step(acc: Column, q: Column) -> Column:
        limits = of(q)
        need = q["safety_stock"] + q["demand"] - acc["balance"]
        lo, hi = need + limits.lo, need + limits.hi
        in_wafers = lambda lots: F.transform(lots, lambda y: (y * limits.lot).cast("double"))

        def retry(p: Column) -> Column:
            spare = F.try_element_at(spares, q["quarter"])
            raised = F.zip_with(q["cap"], q["seqs"], lambda c, s: c + F.coalesce(F.try_element_at(spare, s), F.lit(0.0)))
            again = F.when(
                ~p["feasible"] & spare.isNotNull(),
                _let(
                    raised,
                    lambda cap: F.struct(cap.alias("cap"), cut_to_band(q["b"], largest_lots(cap, q["seqs"], limits), lo, hi, limits).alias("plan")),
                ),
            )
            return _let(
                again,
                lambda r: settle(
                    p["feasible"],
                    F.coalesce(r["plan"]["feasible"], F.lit(False)),
                    in_wafers(p["lots"]),
                    F.coalesce(in_wafers(r["plan"]["lots"]), r["cap"], q["cap"]),
                ),
            )

        def settle(own: Column, rescued: Column, planned: Column, otherwise: Column) -> Column:
            wafers = F.when(own, planned).otherwise(otherwise)
            left = F.zip_with(q["cap"], planned, lambda c, w: c - w)
            spare = F.when(own, left).otherwise(F.transform(q["cap"], lambda _: F.lit(0.0)))
            return _let(
                F.struct(
                    (own | rescued).alias("ok"), rescued.alias("rescued"), wafers.alias("w"),
                    _total(q["b"], wafers, 1).alias("s"), spare.alias("spare"),
                ),
                book,
            )

        def book(r: Column) -> Column:
            balance = acc["balance"] + r["s"] - q["demand"]
            row = F.struct(
                q["quarter"], q["quarter_index"].cast("int"), r["ok"], r["rescued"], acc["balance"], r["s"], balance,
                balance - q["safety_stock"], q["seqs"], q["labels"], r["w"], r["spare"],
            ).cast(_ROLLED)
            return F.struct(balance.alias("balance"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        first = cut_to_band(q["b"], q["u"], lo, hi, limits)
        if spares is None:
            return _let(first, lambda p: settle(p["feasible"], F.lit(False), in_wafers(p["lots"]), q["cap"]))
        return _let(first, retry)

    start = F.struct(
        F.get(quarters, F.lit(0))["opening"].alias("balance"), F.array().cast(f"array<{_ROLLED}>").alias("rows")
    )
    return F.aggregate(quarters, start, step, lambda acc: acc["rows"])


def roll_plan(inputs: DataFrame, limits: PlanLimits | DataFrame = PlanLimits()) -> DataFrame:
    """Plan a product's quarters in order; the closing balance of one opens the next.

    `opening` counts for a product's first quarter only. Products run in parallel; within one,
    the fold walks its quarters, of which the calendar bounds the number. `limits` may be a table as for
    `with_limits`; each quarter is then planned within its own.
    """
    packed, of = _limited(pack_quarters(inputs), limits)
    rolled = _chains(packed, of).select("product_id", F.explode_outer(_fold(F.col("quarters"), of)).alias("r"))
    return rolled.select("product_id", "r.*").drop("spare", "rescued")


def production_plan(inputs: DataFrame, priority: DataFrame, limits: PlanLimits | DataFrame = PlanLimits()) -> DataFrame:
    """Rolling plan of whole production lines with rescue, in one job.

    `priority`: product_id, line, priority (any whole numbers, each once within a line). A quarter
    without a plan is planned again with what the line's product of the next smaller number left
    unused that quarter; a product without priority has no donor.

    A number missing in a line ends the dependence, so consecutive numbers are a chain of their own.
    A chain is folded twice over: its products by priority, with what the last one left per quarter and week
    as the state, and a product's quarters in order. Chains and products without priority run in
    parallel; one chain is as long as its line has products, each with the calendar's quarters.
    """
    ranked = inputs.join(unique_priorities(priority), "product_id", "left")
    packed, of = _limited(pack_quarters(ranked, "line", "priority"), limits)
    products = cut_lineage(_chains(packed, of, "line", "priority"))
    alone = products.where(F.col("priority").isNull())
    alone = alone.select("product_id", "line", "priority", F.explode_outer(_fold(F.col("quarters"), of)).alias("r"))
    place = F.row_number().over(Window.partitionBy("line").orderBy("priority"))
    numbered = products.where(F.col("priority").isNotNull()).withColumn("_run", F.col("priority") - place)
    member = F.struct("priority", "product_id", "quarters")
    chained = numbered.groupBy("line", "_run").agg(F.array_sort(F.collect_list(member)).alias("members"))
    spares = "map<string,map<int,double>>"
    planned = f"array<struct<product_id:string,priority:int,rows:array<{_ROLLED}>>>"

    def product(acc: Column, member: Column) -> Column:
        def booked(rows: Column) -> Column:
            left = F.map_from_arrays(
                F.transform(rows, lambda r: r["quarter"]), F.transform(rows, lambda r: F.map_from_arrays(r["seqs"], r["spare"]))
            )
            done = F.struct(member["product_id"].cast("string").alias("product_id"), member["priority"].cast("int").alias("priority"), rows.alias("rows"))
            return F.struct(left.cast(spares).alias("spares"), F.concat(acc["done"], F.array(done)).alias("done"))

        return _let(_fold(member["quarters"], of, acc["spares"]), booked)

    start = F.struct(F.create_map().cast(spares).alias("spares"), F.array().cast(planned).alias("done"))
    folded = F.aggregate("members", start, product, lambda acc: acc["done"])
    each = chained.select("line", F.explode_outer(folded).alias("m"))
    chains = each.select("m.product_id", "line", "m.priority", F.explode_outer("m.rows").alias("r"))
    return chains.select("product_id", "line", "priority", "r.*").unionByName(alone.select("product_id", "line", "priority", "r.*"))


def rolled_weeks(rolled: DataFrame) -> DataFrame:
    """Rolling plan as one row per week."""
    return rolled.withColumn("_w", F.explode(F.arrays_zip("seqs", "labels", "wafers"))).select(
        "product_id",
        "quarter",
        F.col("_w.seqs").alias("week_seq"),
        F.col("_w.labels").alias("week_label"),
        F.col("_w.wafers").alias("wafers"),
        "feasible",
    )
