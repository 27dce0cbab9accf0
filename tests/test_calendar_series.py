from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from demandflow.functions import calendar as C
from demandflow.functions.numeric import clip, median_of, nonneg_int
from demandflow.operators import filters, series as S
from demandflow.sources.readers import default_week_ratio
from tests.conftest import by_product, make_series


def one(spark, sql_type, values, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {sql_type}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_quarter_labels(spark):
    labels = ["Q1 49", "Q1 50", "Q5 95", "bad", "Q4 99", "Q2 1995"]
    assert one(spark, "string", labels, C.quarter_year_of) == [2049, 1950, 1995, -1, 1999, -1]
    assert one(spark, "string", labels, C.quarter_num_of) == [1, 1, 5, -1, 4, -1]
    assert one(spark, "string", [" Q4 99 ", "Q5 99", "4Q 99"], C.strict_quarter_index) == [1999 * 4 + 3, None, None]


def test_successors(spark):
    assert one(spark, "string", ["Q4 99", "q4 99", "Q5 99"], lambda c: C.quarter_successors(c, 2)) == [["Q1 00", "Q2 00"], [], []]
    assert one(spark, "string", ["WW_51", "ww_52", "WW_53", "W_1"], lambda c: C.week_label_successors(c, 2)) == [
        ["WW_52", "WW_01"], ["WW_01", "WW_02"], [], []
    ]
    texts = ["25-12-1999", " 25-12-1999 00:00:00", "1999-12-25", "31-02-1999"]
    assert one(spark, "string", texts, lambda c: C.date_successors(c, 2)) == [
        ["01-01-2000", "08-01-2000"], ["01-01-2000", "08-01-2000"], [], []
    ]


def test_week_parts(spark):
    days = [dt.date(1995, 1, 1), dt.date(1995, 1, 2), dt.date(1999, 1, 3)]
    assert one(spark, "date", days, C.week_end) == [dt.date(1995, 1, 1), dt.date(1995, 1, 8), dt.date(1999, 1, 3)]
    assert one(spark, "date", days, C.week_of_quarter) == [13, 1, 1]  # 1999-01-03 is ISO week 53


def test_week_start_outside_range_is_null(spark):
    df = spark.createDataFrame([(1995, 2, 1), (1995, 2, 13), (1995, 2, 14), (1995, 7, 1), (1995, 0, 1)], "y int, q int, w int")
    got = [r[0] for r in df.select(C.week_start(F.col("y"), F.col("q"), F.col("w"))).collect()]
    assert got == [dt.date(1995, 4, 1), dt.date(1995, 6, 24), None, None, None]


def test_small_numbers(spark):
    assert one(spark, "double", [2.9, -1.0, None], nonneg_int) == [2, 0, 0]
    assert one(spark, "double", [0.0, 5.0, None], lambda c: clip(c, 1.0, 3.0)) == [1.0, 3.0, None]
    arrays = [[3.0, None, 1.0], [4.0, 1.0, 2.0, 3.0], [None], []]
    assert one(spark, "array<double>", arrays, median_of) == [2.0, 2.5, None, None]


def facts(spark, rows):
    return spark.createDataFrame(
        rows, "product_id string, attribute string, quarter string, year int, quarter_num int, value double"
    )


def test_split_keeps_the_quarter_total(spark):
    rows = [
        ("A", "EffectiveDemand", "Q1 95", 1995, 1, 1300.0), ("A", "EffectiveDemand", "Q2 95", 1995, 2, 0.0),
        ("A", "EffectiveDemand", "Q3 95", 1995, 3, -26.0), ("A", "Yielded Supply", "Q1 95", 1995, 1, 9.0),
        ("A", "EffectiveDemand", "bad", -1, -1, 9.0), ("A", "EffectiveDemand", "Q7 95", 1995, 7, 13.0),
    ]
    weekly = S.weekly_demand(facts(spark, rows), default_week_ratio(spark))
    totals = {r["quarter"]: (round(r["t"], 6), r["n"], r["d"]) for r in weekly.groupBy("quarter").agg(
        F.sum("demand").alias("t"), F.count("*").alias("n"), F.count("week_start").alias("d")).collect()}
    assert totals == {"Q1 95": (1300.0, 13, 13), "Q3 95": (-26.0, 13, 13), "Q7 95": (13.0, 13, 0)}


def test_ratio_status(spark):
    good = [("g", w, 1 / 13) for w in range(1, 14)]
    short = [("s", w, 0.1) for w in range(1, 13)]
    holed = [("h", w, None if w == 3 else 0.1) for w in range(1, 14)]
    df = spark.createDataFrame(good + short + holed, "k string, week int, ratio double")
    got = {r["k"]: (r["ok"], r["sum_warning"]) for r in filters.validate_ratio(df, "k").collect()}
    assert got == {"g": (True, False), "s": (False, True), "h": (False, True)}


def test_resample_gaps_duplicates_and_trim(spark):
    d = dt.date
    rows = [
        ("A", d(1995, 1, 2), 0.0, 1), ("A", d(1995, 1, 9), 3.0, 1), ("A", d(1995, 1, 15), 4.0, 1), ("A", d(1995, 1, 15), 5.0, 2),
        ("A", d(1995, 2, 5), 7.0, 1), ("A", d(1995, 2, 4), 6.0, 1), ("A", d(1995, 2, 5), None, 3), ("B", d(1995, 1, 1), 0.0, 1),
        ("B", d(1995, 1, 2), -1.0, 1), ("C", None, 4.0, 1),
    ]
    obs = spark.createDataFrame(rows, "product_id string, week_start date, demand double, copy int")
    got = S.weekly_series(obs, tiebreak=("copy",))
    assert by_product(got, "demand") == {"A": [5.0, None, None, 7.0], "B": [0.0, -1.0]}
    assert by_product(got, "week_end")["A"][0] == d(1995, 1, 15)


def test_dedup_first_tail_and_split(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")], "id string, o int, v string")
    assert {tuple(r) for r in S.dedup_keep_last(df, ["id"], ["o"]).collect()} == {("k", 3, "c"), ("j", 1, "z")}
    assert {tuple(r) for r in S.first_match(df, ["id"], ["o"]).collect()} == {("k", 1, "a"), ("j", 1, "z")}
    line = make_series(spark, A=range(10), B=[1, 2])
    assert by_product(S.tail_k(line, 3), "demand") == {"A": [7, 8, 9], "B": [1, 2]}
    assert by_product(S.backtest_split(line, None), "is_test") == {"A": [False] * 7 + [True] * 3, "B": [False, False]}


def test_training_rows_carry_the_test_weeks(spark):
    line = make_series(spark, A=range(20), B=[1, 2, 3])
    rows = S.training_rows(line, 5).orderBy("product_id", "week_end").collect()
    a = [r for r in rows if r["product_id"] == "A"]
    assert len(a) == 15 and [r["actual"] for r in a[-1]["ahead"]] == [15, 16, 17, 18, 19]
    assert all(r["ahead"] is None for r in a[:-1])
    assert [(r["too_short"], r["ahead"], r["all_rows"]) for r in rows if r["product_id"] == "B"] == [(True, None, 3)]


def test_impute_mean_uses_the_period_then_zero(spark):
    df = spark.createDataFrame([("A", "w1", 2.0), ("B", "w1", None), ("C", "w1", 4.0), ("A", "w2", None)], "p string, w string, v double")
    got = {(r["p"], r["w"]): r["v"] for r in filters.impute_mean(df, "v", "w").collect()}
    assert got == {("A", "w1"): 2.0, ("B", "w1"): 3.0, ("C", "w1"): 4.0, ("A", "w2"): 0.0}


def test_carry_forward_and_buckets(spark):
    line = make_series(spark, A=[0.9, None, 0.8, None]).withColumnRenamed("demand", "yield_value")
    got = S.carry_forward(line, 2)
    assert by_product(got, "yield_value") == {"A": [0.8, 0.8]}
    assert by_product(got, "week_end")["A"][0] == dt.date(1995, 1, 29)
    steps = spark.createDataFrame([("A", i, 1.0) for i in range(1, 31)], "product_id string, step int, forecast double")
    assert {(r["bucket"], r["demand"]) for r in S.weeks_to_quarter_buckets(steps).collect()} == {(1, 13.0), (2, 13.0), (3, 4.0)}


def test_quarterly_series(spark):
    rows = [
        ("A", "EffectiveDemand", "Q1 95", 1995, 1, 0.0), ("A", "EffectiveDemand", "Q2 95", 1995, 2, 5.0),
        ("A", "EffectiveDemand", "Q2 95", 1995, 2, 6.0), ("A", "EffectiveDemand", "FY95", -1, -1, 9.0),
        ("B", "EffectiveDemand", "Q1 95", 1995, 1, 0.0),
    ]
    got = {(r["product_id"], r["quarter_index"]): r["demand"] for r in S.quarterly_series(facts(spark, rows)).collect()}
    assert got == {("A", 1995 * 4 + 1): 6.0, ("B", 1995 * 4): 0.0}


def test_last_row_of_a_key_without_any_order(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", 3, 4)], "k string, at int, v int")
    assert sorted(map(tuple, S.dedup_keep_last(rows, ["k"], ["at"]).collect())) == [("a", None, 1), ("b", 3, 4)]
