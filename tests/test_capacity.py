from __future__ import annotations

import dataclasses
import itertools
import random

import pytest
from pyspark.sql import functions as F

from demandflow.operators.lookups import donor_leftover
from demandflow.operators.windows import ramp_envelope
from demandflow.plans import capacity as C

SCHEMA = (
    "product_id string, quarter string, quarter_index int, week_seq int, week_label string, "
    "bytes_per_wafer double, capacity double, safety_stock double, demand double, opening double"
)


def weeks(product, cap, b, sst=0.0, demand=0.0, opening=0.0, quarter="Q1 95", index=7980):
    return [
        (product, quarter, index, i + 1, f"WW_{i + 1:02d}", float(y), float(c), float(sst), float(demand), float(opening))
        for i, (c, y) in enumerate(zip(cap, b))
    ]


def plans(df):
    out = {}
    for r in df.orderBy("product_id", "quarter_index" if "quarter_index" in df.columns else "quarter", "week_seq").collect():
        out.setdefault((r["product_id"], r["quarter"]), []).append(r)
    return out


def optimum(cap, b, lo, hi, limits):
    """Best total of whole lots by listing every plan; None without any."""
    ranges = [range(limits.min_lots, int(c // limits.lot) + 1) for c in cap]
    best = None
    for lots in itertools.product(*ranges):
        if any(x - y > limits.ramp_lots for x, y in zip(lots, lots[1:])):
            continue
        total = sum(limits.lot * x * y for x, y in zip(lots, b))
        if lo <= total <= hi and (best is None or total > best):
            best = total
    return best


def test_plan_against_every_possible_plan(spark):
    rng = random.Random(7)
    limits = C.PlanLimits(lot=5, min_week=10, max_decrease=15, lo=0.0, hi=60.0)
    rows, cases = [], {}
    for k in range(150):
        n = rng.choice([3, 4])
        cap = [rng.randint(8, 45) + rng.random() for _ in range(n)]
        b = [rng.choice([1.0, 1.5, 2.0, 2.5]) for _ in range(n)]
        need = rng.uniform(50, 330)
        rows += weeks(f"p{k}", cap, b, sst=need / 2, demand=need / 2 + 5, opening=5)
        cases[f"p{k}"] = (cap, b, need)
    got = plans(C.capacity_plan(spark.createDataFrame(rows, SCHEMA), limits))
    outcomes = {"cut": 0, "uncut": 0, "none": 0}
    for name, (cap, b, need) in cases.items():
        plan = got[(name, "Q1 95")]
        wafers = [r["wafers"] for r in plan]
        best = optimum(cap, b, need, need + 60, limits)
        assert not plan[0]["band_too_narrow"]
        if best is None:
            assert not plan[0]["feasible"] and wafers == cap, name
            outcomes["none"] += 1
            continue
        assert plan[0]["feasible"], name
        assert all(w % 5 == 0 and 10 <= w <= c for w, c in zip(wafers, cap))
        assert all(x - y <= 15 for x, y in zip(wafers, wafers[1:]))
        total = sum(w * y for w, y in zip(wafers, b))
        assert need - 1e-9 <= total <= need + 60 + 1e-9
        assert best - total < 5 * max(b) + 1e-9
        free = optimum(cap, b, 0, float("inf"), limits)
        outcomes["uncut" if free == best else "cut"] += 1
    assert min(outcomes.values()) >= 15, outcomes


def test_default_limits_and_fourteen_weeks(spark):
    cap = [5150, 5255, 5180, 4745, 5000, 5100, 5200, 4800, 4900, 5000, 5100, 5200, 5000, 3000]
    rows = weeks("A", cap, [47000.0] * 14, sst=6.8e8, demand=2.2e9, opening=1.0e8)
    plan = plans(C.capacity_plan(spark.createDataFrame(rows, SCHEMA)))[("A", "Q1 95")]
    assert len(plan) == 14 and plan[0]["feasible"]
    excess = 1.0e8 + sum(r["wafers"] * 47000.0 for r in plan) - 2.2e9 - 6.8e8
    assert 70e6 <= excess <= 140e6 and 140e6 - excess < 5 * 47000
    k = C.plan_kpis(C.capacity_plan(spark.createDataFrame(rows, SCHEMA))).first()
    assert k["ibesst"] == pytest.approx(excess) and k["tpib"] == pytest.approx(excess + 6.8e8)


def test_exact_target_falls_back_to_capacity(spark):
    rows = weeks("A", [50, 50], [1.3, 1.7], demand=100.05)
    plan = plans(C.capacity_plan(spark.createDataFrame(rows, SCHEMA), C.PlanLimits(min_week=10, lo=0.0, hi=0.0)))
    week = plan[("A", "Q1 95")][0]
    assert not week["feasible"] and week["band_too_narrow"] and week["wafers"] == 50


def test_rescue_uses_the_donor_left_over(spark):
    limits = C.PlanLimits(min_week=10, max_decrease=1000, lo=0.0, hi=50.0)
    rows = weeks("A", [100, 100], [1.0, 1.0], demand=100)  # needs half of its capacity
    rows += weeks("B", [40, 40], [1.0, 1.0], demand=120)  # too little alone
    rows += weeks("C", [40, 40], [1.0, 1.0], demand=120)  # its donor B has no plan of its own
    order = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "product_id string, priority int")
    got = plans(C.rescue_plan(spark.createDataFrame(rows, SCHEMA), order, limits))
    state = {p: (v[0]["feasible"], v[0]["rescued"]) for (p, _), v in got.items()}
    assert state == {"A": (True, False), "B": (True, True), "C": (False, False)}
    assert sum(r["wafers"] for r in got[("B", "Q1 95")]) >= 120
    assert [r["wafers"] for r in got[("C", "Q1 95")]] == [40, 40]


def test_rolling_plan_chains_balances(spark):
    rng = random.Random(11)
    limits = C.PlanLimits(min_week=10, max_decrease=15, lo=0.0, hi=60.0)
    rows, quarters = [], 6
    for p in ("A", "B", "C"):
        for q in range(quarters):
            cap = [rng.randint(20, 45) for _ in range(4)]
            rows += weeks(p, cap, [1.5, 1.0, 2.0, 1.0], sst=20, demand=rng.randint(120, 190), opening=15, quarter=f"Q{q % 4 + 1} {95 + q // 4}", index=7980 + q)
    source = spark.createDataFrame(rows, SCHEMA)
    rolled = {}
    for r in C.roll_plan(source, limits).orderBy("product_id", "quarter_index").collect():
        rolled.setdefault(r["product_id"], []).append(r)
    seen = set()
    for p, chain in rolled.items():
        opening = 15.0
        for r in chain:
            assert r["opening"] == pytest.approx(opening)
            own = [(*w[:9], opening) for w in rows if w[0] == p and w[1] == r["quarter"]]
            alone = plans(C.capacity_plan(spark.createDataFrame(own, SCHEMA), limits))[(p, r["quarter"])]
            assert [w["wafers"] for w in alone] == r["wafers"] and alone[0]["feasible"] == r["feasible"]
            opening = opening + r["supply"] - own[0][8]
            assert r["balance"] == pytest.approx(opening) and r["excess"] == pytest.approx(opening - 20)
            seen.add(r["feasible"])
    assert seen == {True, False} and C.rolled_weeks(C.roll_plan(source, limits)).count() == 72


def test_production_plan_rolls_and_rescues(spark):
    rng = random.Random(5)
    limits = C.PlanLimits(min_week=10, max_decrease=15, lo=0.0, hi=60.0)
    rows, given = [], {}
    for p, scale in (("A", 130), ("B", 200), ("C", 230)):
        for q in range(4):
            cap = [rng.randint(25, 45) for _ in range(4)]
            mine = weeks(p, cap, [1.5, 1.0, 2.0, 1.0], sst=20, demand=rng.randint(scale - 30, scale + 30), opening=15, quarter=f"Q{q + 1} 95", index=7980 + q)
            rows += mine
            given[(p, q)] = mine
    order = spark.createDataFrame([("A", 0, 1), ("B", 0, 2), ("C", 0, 3)], "product_id string, line int, priority int")
    got = {(r["product_id"], r["quarter_index"] - 7980): r for r in C.production_plan(spark.createDataFrame(rows, SCHEMA), order, limits).collect()}

    def solve(mine):
        plan = plans(C.capacity_plan(spark.createDataFrame(mine, SCHEMA), limits))
        return next(iter(plan.values()))

    spare, rescued = {}, []
    for p, donor in (("A", None), ("B", "A"), ("C", "B")):
        opening = 15.0
        for q in range(4):
            mine = [(*w[:9], opening) for w in given[(p, q)]]
            plan = solve(mine)
            spare[(p, q)] = [w["capacity"] - w["wafers"] for w in plan]
            row = got[(p, q)]
            assert row["spare"] == spare[(p, q)]
            if not plan[0]["feasible"] and donor:
                plan = solve([(*w[:6], w[6] + extra, *w[7:]) for w, extra in zip(mine, spare[(donor, q)])])
                rescued.append(row["rescued"])
                assert row["rescued"] == plan[0]["feasible"]
            assert row["wafers"] == [w["wafers"] for w in plan] and row["feasible"] == plan[0]["feasible"]
            opening += sum(w["wafers"] * w["bytes_per_wafer"] for w in plan) - mine[0][8]
            assert row["balance"] == pytest.approx(opening)
    assert True in rescued and False in rescued


def test_plan_inputs_drop_incomplete_keys(spark):
    facts = spark.createDataFrame(
        [
            (p, a, q, 1995, n, v)
            for p in ("A", "B", "C")
            for q, n in (("Q1 95", 1), ("Q2 95", 2))
            for a, v in (("EffectiveDemand", 10.0 * n), ("Safety Stock Target", 3.0), ("Total Projected Inventory Balance", 7.0 * n))
        ],
        "product_id string, attribute string, quarter string, year int, quarter_num int, value double",
    )
    density = spark.createDataFrame([("A", 2.9), ("C", 2.9)], "product_id string, density double")
    yields = spark.createDataFrame([(p, "Q2 95", w, 0.5 * w) for p in ("A", "B", "C") for w in (1, 2) if (p, w) != ("C", 2)], "product_id string, quarter string, week_seq int, yield_value double")
    caps = spark.createDataFrame([(p, "Q2 95", w, f"WW_{13 + w}", 9.0) for p in ("A", "B", "C") for w in (1, 2)], "product_id string, quarter string, week_seq int, week_label string, capacity double")
    got = C.plan_inputs(facts, density, yields, caps).orderBy("week_seq").collect()
    assert [(r["product_id"], r["week_seq"], r["bytes_per_wafer"], r["opening"], r["demand"]) for r in got] == [
        ("A", 1, 1.0, 7.0, 20.0), ("A", 2, 2.0, 7.0, 20.0)
    ]


def test_missing_week_widens_the_ramp(spark):
    limits = C.PlanLimits(lot=5, min_week=5, max_decrease=200, lo=0.0, hi=1e9)
    rows = [r for r in weeks("A", [900, 0, 350], [1.0] * 3) if r[3] != 2]
    plan = plans(C.capacity_plan(spark.createDataFrame(rows, SCHEMA), limits))[("A", "Q1 95")]
    assert [(r["week_seq"], r["wafers"]) for r in plan] == [(1, 750.0), (3, 350.0)]


def test_donor_weeks_meet_by_number(spark):
    limits = C.PlanLimits(min_week=10, max_decrease=1000, lo=0.0, hi=50.0)
    donor = [r for r in weeks("A", [100, 0, 100], [1.0] * 3, demand=100) if r[3] != 2]
    rows = [*donor, *weeks("B", [40, 40, 40], [1.0] * 3, demand=130), *weeks("N", [40, 40], [1.0] * 2, demand=120)]
    order = [("A", 1, "x"), ("B", 2, "x"), ("N", None, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    ranks = spark.createDataFrame(order, "product_id string, priority int, line string")
    for name in ("unranked", "not listed"):
        got = plans(C.rescue_plan(frame, ranks if name == "unranked" else ranks.where("priority is not null"), limits))
        assert {p for p, _ in got} == {"A", "B", "N"} and not got[("N", "Q1 95")][0]["feasible"]
        assert got[("B", "Q1 95")][0]["rescued"]
        second = next(r for r in got[("B", "Q1 95")] if r["week_seq"] == 2)
        assert second["capacity"] == 40 and second["wafers"] <= 40
    rolled = C.production_plan(frame, ranks, limits).collect()
    assert {r["product_id"] for r in rolled} == {"A", "B", "N"}
    low = spark.createDataFrame([("A", -3, "x"), ("B", 0, "x"), ("N", 0, "y")], ranks.schema)
    assert {r["product_id"] for r in C.production_plan(frame, low, limits).collect()} == {"A", "B", "N"}
    for twice in ([("A", 1, "x"), ("B", 1, "x")], [("A", 1, "x"), ("A", 2, "x")]):
        with pytest.raises(ValueError, match="repeated"):
            C.rescue_plan(frame, spark.createDataFrame(twice, ranks.schema), limits)


def test_ramp_envelope_and_donor_rows(spark):
    df = spark.createDataFrame([("A", "q", i + 1, float(c)) for i, c in enumerate([900, 100, 500])], "product_id string, quarter string, week_seq int, capacity double")
    got = [r["envelope"] for r in ramp_envelope(df, max_decrease=300).orderBy("week_seq").collect()]
    assert got == [400.0, 100.0, 500.0]
    rows = [("A", 1, "q", 1, 10.0, 4.0), ("B", 2, "q", 1, 10.0, 10.0), ("B", 2, "q", 2, 10.0, 10.0)]
    plan = spark.createDataFrame(rows, "product_id string, priority int, quarter string, week_seq int, capacity double, wafers double")
    raised = {(r["product_id"], r["week_seq"]): r["raised_capacity"] for r in donor_leftover(plan).collect()}
    assert raised == {("A", 1): 10.0, ("B", 1): 16.0, ("B", 2): 10.0}


def test_a_thousand_priorities_are_one_chain(spark):
    """A chain of 1,000 products equals the plan of its first ones, and gaps in the numbers end it."""
    rng = random.Random(9)
    limits = C.PlanLimits(min_week=10, max_decrease=15, lo=0.0, hi=60.0)
    rows = [
        w
        for i in range(1000)
        for q in range(2)
        for w in weeks(f"P{i:04d}", [rng.randint(20, 45) for _ in range(3)], [1.5, 1.0, 2.0], sst=20, demand=rng.randint(90, 170), opening=15, quarter=f"Q{q + 1} 95", index=7980 + q)
    ]
    ranks = "product_id string, line int, priority int"
    order = [(f"P{i:04d}", 0, i) for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r["product_id"], r["quarter_index"])
    whole = {key(r): r for r in C.production_plan(frame, spark.createDataFrame(order, ranks), limits).collect()}
    assert len(whole) == 2000 and any(r["rescued"] for r in whole.values())
    few = C.production_plan(frame.where("product_id < 'P0020'"), spark.createDataFrame(order[:20], ranks), limits).collect()
    assert [whole[key(r)] for r in few] == few
    # Without number 500 its successor has no donor; all before and all from there on are as if planned alone.
    cut = {key(r): r for r in C.production_plan(frame, spark.createDataFrame(order[:500] + order[501:], ranks), limits).collect()}
    later = C.production_plan(frame.where("product_id > 'P0500'"), spark.createDataFrame(order[501:], ranks), limits).collect()
    assert [cut[key(r)] for r in later] == later
    assert all(cut[k] == r for k, r in whole.items() if k[0] < "P0500")


LIMITS = "product_id string, from_index int, until_index int, lot int, min_week double, max_decrease double, lo double, hi double"


def test_limits_change_within_a_product(spark):
    """Every quarter of the rolling plan equals that quarter planned alone with the limits that hold in it."""
    rng = random.Random(3)
    rows, given = [], {}
    for p in ("A", "B"):
        for q in range(12):
            mine = weeks(p, [rng.randint(30, 60) for _ in range(4)], [1.5, 1.0, 2.0, 1.0], sst=20, demand=rng.randint(120, 200), opening=15, quarter=f"Q{q % 4 + 1} {95 + q // 4}", index=7980 + q)
            rows += mine
            given[p, q] = mine
    default = C.PlanLimits(min_week=10, max_decrease=15, lo=0.0, hi=60.0)
    table = [
        ("A", 7982, 7985, 4, None, None, None, 30.0),
        (None, 7984, None, None, 20.0, 40.0, None, None),
        ("A", 7984, 7986, None, None, 5.0, 10.0, 50.0),
        (None, 7000, 7981, None, None, None, None, 20.0),
        ("B", 9000, None, 1, None, None, None, None),
        ("B", 7986, 7986, 1, None, None, None, None),
    ]

    def plain(p, q):
        index = 7980 + q
        held = [r for r in table if r[0] in (None, p) and r[1] <= index and (r[2] is None or index < r[2])]
        best = min(held, key=lambda r: (r[0] is None, -r[1]), default=None)
        found = dict(zip(("lot", "min_week", "max_decrease", "lo", "hi"), best[3:])) if best else {}
        out = dataclasses.replace(default, **{k: v for k, v in found.items() if v is not None})
        return dataclasses.replace(out, lo=0.0, hi=0.0) if q >= 9 else out

    packed = C.pack_quarters(spark.createDataFrame(rows, SCHEMA))
    limited = C.with_limits(packed, spark.createDataFrame(table, LIMITS), default, exact_after=9)
    got = {(r["product_id"], r["quarter_index"] - 7980): r["limits"] for r in limited.collect()}
    assert len(got) == 24
    for (p, q), r in got.items():
        want = plain(p, q)
        assert (r["lot"], r["min_lots"], r["ramp_lots"], r["lo"], r["hi"]) == (want.lot, want.min_lots, want.ramp_lots, want.lo, want.hi), (p, q)
    of = lambda q: C.QuarterLimits.of(F.col("limits") if q is None else q["limits"])
    rolled = C._chains(limited, of).select("product_id", F.explode_outer(C._fold(F.col("quarters"), of)).alias("r")).select("product_id", "r.*")
    seen = {(r["product_id"], r["quarter_index"] - 7980): r for r in rolled.collect()}
    feasible = set()
    for p in ("A", "B"):
        opening = 15.0
        for q in range(12):
            mine = [(*w[:9], opening) for w in given[p, q]]
            plan = next(iter(plans(C.capacity_plan(spark.createDataFrame(mine, SCHEMA), plain(p, q))).values()))
            row = seen[p, q]
            assert row["wafers"] == [w["wafers"] for w in plan] and row["feasible"] == plan[0]["feasible"], (p, q)
            feasible.add((q >= 9, row["feasible"]))
            opening = row["balance"]
    assert (False, True) in feasible
    empty = C.with_limits(packed.limit(0), spark.createDataFrame(table, LIMITS))
    assert empty.count() == 0
    assert C.with_limits(packed, spark.createDataFrame([], LIMITS), default, None).select("limits.hi").distinct().collect()[0][0] == 60.0
