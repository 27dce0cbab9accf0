from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from demandflow.operators.series import weekly_demand
from demandflow.sources import commits, readers, writers
from demandflow.sources.commits import read_table


def test_require_columns_names_what_is_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert readers.require_columns(df, ["a"]) is df
    with pytest.raises(readers.MissingColumnsError, match="b, c"):
        readers.require_columns(df, ["a", "b", "c"])


def test_facts_read_separators_blanks_and_labels(spark, fixtures):
    facts = readers.read_quarterly_facts(spark, f"{fixtures}/quarterly_facts.csv")
    assert facts.count() == 18 * 35
    row = facts.where("product_id = '21A' AND attribute = 'EffectiveDemand' AND quarter = 'Q3 95'").first()
    assert (row["year"], row["quarter_num"], row["value"]) == (1995, 3, 3920865476.0)
    assert facts.where("value IS NULL").count() > 0


def test_unparseable_text_becomes_null(spark):
    df = spark.createDataFrame([("1,234.5",), (" 7 ",), ("",), ("n/a",), ("-3",), (None,)], "value string")
    got = [r[0] for r in readers.clean_numeric(df).collect()]
    assert got == [1234.5, 7.0, None, None, -3.0, None]


def test_table_set_defaults_and_errors(spark, tmp_path):
    path = str(tmp_path / "sd")
    spark.createDataFrame([("A", 1.0)], "product_id string, v double").write.parquet(path)
    tables = readers.read_table_set(spark, {"supply_demand": path})
    assert set(tables) == {"supply_demand", "week_ratio"}
    assert tables["week_ratio"].count() == 13
    assert abs(sum(r["ratio"] for r in tables["week_ratio"].collect()) - 1) < 1e-9
    with pytest.raises(KeyError, match="supply_demand"):
        readers.read_table_set(spark, {})
    with pytest.raises(KeyError, match="nonsense"):
        readers.read_table_set(spark, {"supply_demand": path, "nonsense": path})


def test_two_level_header(spark):
    rows = [
        (0, None, None, "Q3 95", None, "Q4 95"),
        (1, None, None, "WW_09", "WW_10", "WW_11"),
        (2, "A", "Available Capacity", "5,150", "x", "7"),
    ]
    table = spark.createDataFrame(rows, "row_no int, _c0 string, _c1 string, _c2 string, _c3 string, _c4 string")
    got = {(r["quarter"], r["label"]): (r["position"], r["value"]) for r in readers.two_level_header_to_long(table).collect()}
    assert got == {("Q3 95", "WW_09"): (1, 5150.0), ("Q3 95", "WW_10"): (2, None), ("Q4 95", "WW_11"): (3, 7.0)}


def test_density_long(spark):
    wide = spark.createDataFrame([(100, 200)], "`21A` int, `22B` int")
    assert {tuple(r) for r in readers.density_long(wide).collect()} == {("21A", 100), ("22B", 200)}


def test_plan_upsert_replaces_whole_groups_and_is_idempotent(spark):
    schema = "quarter string, week_label string, product_id string, wafers double"
    old = spark.createDataFrame(
        [("Q1 95", "WW_01", "A", 1.0), ("Q1 95", "WW_02", "A", 2.0), ("Q1 95", "WW_01", "B", 3.0)], schema
    )
    new = spark.createDataFrame([("Q1 95", "WW_01", "A", 9.0)], schema)
    once = writers.upsert_plan(old, new)
    assert {tuple(r) for r in once.collect()} == {("Q1 95", "WW_01", "A", 9.0), ("Q1 95", "WW_01", "B", 3.0)}
    assert sorted(writers.upsert_plan(once, new).collect()) == sorted(once.collect())


def test_plan_on_disk_keeps_other_quarters(spark, tmp_path):
    path = str(tmp_path / "plan")
    schema = "quarter string, week_label string, product_id string, wafers double"
    first = [("Q1 95", "WW_01", "A", 1.0), ("Q1 95", "WW_01", "B", 2.0), ("Q2 95", "WW_14", "A", 3.0)]
    writers.write_plan(spark, spark.createDataFrame(first, schema), path)
    fresh = spark.createDataFrame([("Q1 95", "WW_01", "A", 8.0), ("Q3 95", "WW_27", "A", 4.0)], schema)
    writers.write_plan(spark, fresh, path)
    writers.write_plan(spark, fresh, path)
    got = {tuple(r) for r in read_table(spark, path).select("quarter", "week_label", "product_id", "wafers").collect()}
    assert got == {("Q1 95", "WW_01", "A", 8.0), ("Q1 95", "WW_01", "B", 2.0), ("Q2 95", "WW_14", "A", 3.0), ("Q3 95", "WW_27", "A", 4.0)}


def test_plan_on_disk_keeps_rows_when_columns_change(spark, tmp_path):
    path = str(tmp_path / "plan")
    writers.write_plan(spark, spark.createDataFrame([("Q1 95", "A", 1.0), ("Q1 95", "B", 2.0)], "quarter string, product_id string, wafers double"), path)
    writers.write_plan(spark, spark.createDataFrame([("Q1 95", "A", 9.0, "x")], "quarter string, product_id string, wafers double, note string"), path)
    rows = {r["product_id"]: (r["wafers"], r["note"]) for r in read_table(spark, path).collect()}
    assert rows == {"A": (9.0, "x"), "B": (2.0, None)}
    with pytest.raises(AnalysisException):
        writers.write_plan(spark, spark.createDataFrame([("A",)], "product_id string"), path)


def test_repeated_and_null_new_facts(spark):
    kind = "product_id string, attribute string, quarter string, value double"
    old = spark.createDataFrame([("A", "x", "q", 1.0), ("B", "x", "q", 2.0)], kind)
    new = spark.createDataFrame([("A", "x", "q", 5.0), ("A", "x", "q", 7.0), ("B", "x", "q", None)], kind)
    assert {(r["product_id"], r["value"]) for r in writers.upsert_facts(old, new).collect()} == {("A", 7.0), ("B", 2.0)}
    assert writers.upsert_facts(old, new).count() == 2
    with pytest.raises(ValueError, match="no column"):
        writers.facts_to_wide(old, ["other"])


@pytest.mark.parametrize("weeks", [list(range(1, 13)), [*range(1, 13), 12], list(range(0, 13))])
def test_week_ratio_must_be_whole(spark, fixtures, weeks):
    facts = readers.read_quarterly_facts(spark, f"{fixtures}/quarterly_facts.csv")
    with pytest.raises(ValueError, match="13"):
        weekly_demand(facts, spark.createDataFrame([(w, 0.1) for w in weeks], "week int, ratio double"))


def test_header_rows_must_be_unique(spark):
    rows = [(0, None, None, "Q3 95"), (0, None, None, "Q4 95"), (1, None, None, "WW_09"), (2, "A", "x", "5")]
    with pytest.raises(ValueError, match="header"):
        readers.two_level_header_to_long(spark.createDataFrame(rows, "row_no int, _c0 string, _c1 string, _c2 string"))


def test_facts_upsert(spark):
    schema = "product_id string, attribute string, quarter string, value double"
    old = spark.createDataFrame([("A", "x", "Q1 95", 1.0), ("A", "x", "Q2 95", 2.0)], schema)
    new = spark.createDataFrame([("A", "x", "Q2 95", 5.0), ("A", "x", "Q3 95", 6.0)], schema)
    got = {(r["quarter"], r["value"]) for r in writers.upsert_facts(old, new).collect()}
    assert got == {("Q1 95", 1.0), ("Q2 95", 5.0), ("Q3 95", 6.0)}


def test_wide_layout_keeps_quarter_order(spark, fixtures):
    wide = readers.read_quarterly_wide(spark, f"{fixtures}/quarterly_facts.csv")
    quarters = [c for c in wide.columns if c not in ("product_id", "attribute")]
    back = writers.facts_to_wide(readers.quarterly_facts(wide), quarters)
    assert back.columns == ["product_id", "attribute", *quarters]
    assert back.where("product_id = '21A' AND attribute = 'EffectiveDemand'").first()["Q3 95"] == 3920865476.0


def test_weekly_and_report_round_trip(spark, tmp_path):
    weekly = spark.createDataFrame(
        [("A", "Q1 95", 1, dt.date(1995, 1, 1), 2.5), ("B", "Q1 95", 1, dt.date(1995, 1, 1), 3.5)],
        "product_id string, quarter string, week int, week_start date, demand double",
    )
    for kind in ("parquet", "csv"):
        path = str(tmp_path / kind)
        writers.write_weekly(weekly, path, kind)
        back = spark.read.format(kind).schema(weekly.schema).option("header", "true").load(path)
        assert sorted(back.collect()) == sorted(weekly.collect())
    history = spark.createDataFrame([("A", "Q1 95", 4.0)], "product_id string, period string, demand double")
    forecast = spark.createDataFrame([("A", 1, 5.0)], "product_id string, step int, forecast double")
    writers.write_bi(writers.export_bi(history, forecast), str(tmp_path / "bi"))
    rows = spark.read.csv(str(tmp_path / "bi"), header=True).collect()
    assert {tuple(r) for r in rows} == {("A", "Q1 95", "Histórico", "4.0"), ("A", "F1", "Pronóstico", "5.0")}


FACTS = "product_id string, attribute string, quarter string, value double"


def stored(spark, path):
    table = read_table(spark, path)
    return None if table is None else {tuple(r)[:3]: r["value"] for r in table.select("product_id", "attribute", "quarter", "value").collect()}


def test_facts_on_disk_are_the_old_or_the_new_ones(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "facts")
    assert stored(spark, path) is None
    old = {(f"P{i}", "x", "Q1 95"): float(i) for i in range(40)}
    assert writers.write_facts(spark, spark.createDataFrame([(*k, v) for k, v in old.items()], FACTS), path, "first")
    assert stored(spark, path) == old
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "facts").rglob("*.parquet")}
    fresh = spark.createDataFrame([("P1", "x", "Q1 95", 9.0), ("P1", "y", "Q1 95", 8.0), ("new", "x", "Q1 95", 1.0), ("P2", "x", "Q1 95", None)], FACTS)
    commit = commits._commit

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(commits, "_commit", lost)
    with pytest.raises(RuntimeError, match="lost"):
        writers.write_facts(spark, fresh, path, "second")
    assert stored(spark, path) == old
    monkeypatch.setattr(commits, "_commit", commit)
    assert writers.write_facts(spark, fresh, path, "second")
    want = old | {("P1", "x", "Q1 95"): 9.0, ("P1", "y", "Q1 95"): 8.0, ("new", "x", "Q1 95"): 1.0}
    assert stored(spark, path) == want
    # A run that was committed does nothing, whatever its rows.
    assert not writers.write_facts(spark, fresh.withColumn("value", F.lit(-1.0)), path, "second")
    assert not writers.write_facts(spark, fresh, path, "first")
    assert stored(spark, path) == want
    # Buckets without new rows were not written again, and no old file was touched.
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    manifest = commits._manifest(spark, path)
    assert sum(f.startswith("data/second/") for f in manifest["folders"].values()) <= 3 < len(manifest["folders"])


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.createDataFrame([("A", "x", "Q1 95", 1.0)], FACTS)
    writers.write_facts(spark, rows, path, "one")
    manifest = commits._manifest(spark, path)
    with pytest.raises(commits.CommitConflict):
        commits._commit(spark, path, 1, {**manifest, "run": "two"})
    assert commits._manifest(spark, path)["run"] == "one"
    assert writers.write_facts(spark, rows.limit(0), path, "empty")
    assert stored(spark, path) == {("A", "x", "Q1 95"): 1.0}


def two_headers(*rows):
    lines = [",,Q3 95,,Q4 95", "Product ID,Attribute,WW_27,WW_28,WW_40", *rows]
    return "\n".join(lines) + "\n"


def test_two_header_rows_are_found_in_each_file(spark, tmp_path):
    folder = tmp_path / "yield"
    folder.mkdir()
    (folder / "a.csv").write_text(two_headers('A,Yield,0.9,"1,000",', "B,Yield,1,2", ",Yield,1,2,3", "", "C,Yield,x, 5 ,6"))
    (folder / "b.csv").write_text(two_headers("D,Yield,7,8,9", '"E, F",Yield,1,2,3,4'))
    body, rejects = readers.read_two_header_table(spark, str(folder))
    assert dict(body.dtypes)["value"] == "double"
    got = {(r["product_id"], r["quarter"], r["label"]): r["value"] for r in body.collect()}
    assert got == {
        ("A", "Q3 95", "WW_27"): 0.9, ("A", "Q3 95", "WW_28"): 1000.0, ("A", "Q4 95", "WW_40"): None,
        ("C", "Q3 95", "WW_27"): None, ("C", "Q3 95", "WW_28"): 5.0, ("C", "Q4 95", "WW_40"): 6.0,
        ("D", "Q3 95", "WW_27"): 7.0, ("D", "Q3 95", "WW_28"): 8.0, ("D", "Q4 95", "WW_40"): 9.0,
    }
    bad = {(r["file"].rsplit("/", 1)[-1], r["line"]): r["reason"] for r in rejects.collect()}
    assert bad == {
        ("a.csv", "B,Yield,1,2"): "wrong number of cells",
        ("a.csv", ",Yield,1,2,3"): "no product",
        ("b.csv", '"E, F",Yield,1,2,3,4'): "wrong number of cells",
    }
    (folder / "c.csv").write_text(two_headers("A,Yield,1,2,3").replace("WW_40", "WW_41"))
    with pytest.raises(ValueError, match="different"):
        readers.read_two_header_table(spark, str(folder))


def test_header_rows_of_a_file_in_many_blocks(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text(two_headers(*(f"P{i},Yield,{i},{i + 1},{i + 2}" for i in range(5000))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        body, rejects = readers.read_two_header_table(spark, str(path))
        assert body.count() == 15_000 and rejects.count() == 0
        assert body.agg(F.sum("value")).first()[0] == sum(3 * i + 3 for i in range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_of_planning_tables(spark, tmp_path):
    (tmp_path / "supply_demand.csv").write_text("Product ID,Attribute,Q3 95,Q4 95\nA,EffectiveDemand,\"1,200\",7\n")
    (tmp_path / "density.csv").write_text("A,B\n94500,57344\n")
    (tmp_path / "yield.csv").write_text(two_headers("A,Yield,1,2,3"))
    tables, rejects = readers.read_planning_folder(spark, str(tmp_path))
    assert sorted(tables) == ["capacity", "density", "supply_demand", "week_ratio", "yield"]
    assert {(r["quarter"], r["value"]) for r in tables["supply_demand"].collect()} == {("Q3 95", 1200.0), ("Q4 95", 7.0)}
    assert {tuple(r) for r in tables["density"].collect()} == {("A", 94500), ("B", 57344)}
    assert tables["week_ratio"].count() == 13 and dict(tables["week_ratio"].dtypes)["ratio"] == "double"
    assert tables["yield"].count() == 3 and tables["capacity"].count() == 0
    assert tables["capacity"].dtypes == tables["yield"].dtypes and rejects.count() == 0
    (tmp_path / "week_ratio.csv").write_text("Week,Ratio\n1,0.4\n2,0.6\n")
    assert {tuple(r) for r in readers.read_planning_folder(spark, str(tmp_path))[0]["week_ratio"].collect()} == {(1, 0.4), (2, 0.6)}
    with pytest.raises(KeyError, match="supply_demand"):
        readers.read_planning_folder(spark, str(tmp_path / "nothing"))
