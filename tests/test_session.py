from __future__ import annotations

import os

from pyspark.sql import functions as F

from demandflow.session import cut_lineage, temporary_cuts


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file:"))


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_cut_keeps_rows_names_and_types(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.5)], "k long, t string, x double").withColumn("void", F.lit(None))
    df = df.select("k", F.col("t").alias("K"), "x", "void", F.array("x").alias("k"))
    back = cut_lineage(df)
    assert back.columns == df.columns and [t for _, t in back.dtypes] == [t for _, t in df.dtypes]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    empty = cut_lineage(df.limit(0))
    assert empty.count() == 0 and empty.columns == df.columns


def test_size_estimate_does_not_grow_in_a_loop(spark):
    path = spark.range(200).select("id", (F.col("id") + 1).alias("next"))
    reach = cut_lineage(path)
    sizes = []
    for _ in range(6):
        step = reach.toDF("id", "mid").join(path.toDF("mid", "next"), "mid", "left")
        reach = cut_lineage(step.select("id", F.coalesce("next", "mid").alias("next")))
        sizes.append(estimate(reach))
    assert max(sizes) < 2 * min(sizes)


def test_temporary_cuts_go_and_kept_ones_stay(spark):
    with temporary_cuts() as keep:
        inner = cut_lineage(spark.range(10))
        gone = folder(inner)
        kept = keep(inner.where("id > 4"))
        assert os.path.exists(gone)
    assert not os.path.exists(gone)
    assert kept.count() == 5
