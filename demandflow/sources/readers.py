"""Readers for quarterly facts and the planning tables around them."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.functions.calendar import quarter_num_of, quarter_year_of
from demandflow.functions.numeric import parse_number

ID_COLUMNS = ("product_id", "attribute")

# Default share of a quarter's demand that falls in each of its 13 weeks.
DEFAULT_WEEK_RATIO = (
    0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055,
    0.06, 0.1, 0.1, 0.15, 0.15,
)

REQUIRED_TABLES = ("supply_demand",)
OPTIONAL_TABLES = ("density", "week_ratio", "yield", "capacity")


class MissingColumnsError(ValueError):
    """Named columns are absent from a table."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table itself, or an error naming the missing columns. Looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing columns: {', '.join(missing)}")
    return df


def read_quarterly_wide(spark: SparkSession, path: str) -> DataFrame:
    """Wide text table, one column per quarter, with `product_id` and `attribute` in front."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, ["Product ID", "Attribute"])
    return raw.withColumnsRenamed({"Product ID": "product_id", "Attribute": "attribute"})


def unpivot_quarters(wide: DataFrame, id_columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """One row per id and quarter column: ids, `quarter`, `value` (type as in the table)."""
    require_columns(wide, id_columns)
    values = [c for c in wide.columns if c not in id_columns]
    return wide.unpivot(list(id_columns), values, "quarter", "value")


def clean_numeric(long_text: DataFrame, column: str = "value") -> DataFrame:
    """Text cells to doubles; separators are dropped, blanks and other text become null."""
    return long_text.withColumn(column, parse_number(F.col(column)))


def quarterly_facts(wide: DataFrame) -> DataFrame:
    """Long facts with the parsed label: product_id, attribute, quarter, year, quarter_num, value."""
    facts = clean_numeric(unpivot_quarters(wide))
    return facts.select(
        "product_id",
        "attribute",
        "quarter",
        quarter_year_of(F.col("quarter")).alias("year"),
        quarter_num_of(F.col("quarter")).alias("quarter_num"),
        "value",
    )


def read_quarterly_facts(spark: SparkSession, path: str) -> DataFrame:
    return quarterly_facts(read_quarterly_wide(spark, path))


def default_week_ratio(spark: SparkSession) -> DataFrame:
    """The default ratio as a table of 13 rows: week, ratio."""
    ratios = F.array(*[F.lit(r) for r in DEFAULT_WEEK_RATIO])
    return spark.range(1).select(F.posexplode(ratios).alias("pos", "ratio")).select(
        (F.col("pos") + 1).alias("week"), "ratio"
    )


def read_table_set(
    spark: SparkSession, paths: Mapping[str, str], file_format: str = "parquet"
) -> dict[str, DataFrame]:
    """Named planning tables. `supply_demand` must be there; a missing ratio gets the default.

    Other optional tables that are not named stay out of the result.
    """
    missing = [name for name in REQUIRED_TABLES if name not in paths]
    if missing:
        raise KeyError(f"missing tables: {', '.join(missing)}")
    unknown = [name for name in paths if name not in REQUIRED_TABLES + OPTIONAL_TABLES]
    if unknown:
        raise KeyError(f"unknown tables: {', '.join(unknown)}")
    options = {"header": "true"} if file_format == "csv" else {}
    tables = {
        name: spark.read.format(file_format).options(**options).load(path)
        for name, path in paths.items()
    }
    tables.setdefault("week_ratio", default_week_ratio(spark))
    return tables


def density_long(wide: DataFrame) -> DataFrame:
    """Density table with one column per product to product_id, density."""
    return wide.unpivot([], list(wide.columns), "product_id", "density").select(
        "product_id", F.col("density").cast("int").alias("density")
    )


def _sql_text(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def two_level_header_to_long(
    table: DataFrame, row_column: str = "row_no", id_columns: Sequence[str] = ("_c0", "_c1")
) -> DataFrame:
    """Table whose rows 0 and 1 are headers (quarter over week) to long form.

    Row 0 names a quarter only above the first of its weeks, so it is filled to the right.
    The two header rows are the table's schema: they alone are read first, and the body is
    then unpivoted in one narrow pass.
    """
    cells = [c for c in table.columns if c != row_column and c not in id_columns]
    top = table.where(F.col(row_column) < 2).limit(3).collect()
    headers = {r[row_column]: r for r in top}
    if len(top) != 2 or set(headers) != {0, 1}:
        raise ValueError("the table needs exactly one header row 0 and one header row 1")
    names = _week_columns({c: headers[0][c] for c in cells}, {c: headers[1][c] for c in cells})
    return _weeks_long(table.where(F.col(row_column) >= 2), names, id_columns)


def _week_columns(above: Mapping[str, str | None], below: Mapping[str, str | None]) -> dict[str, tuple[str, str]]:
    """(quarter, week label) by column, from the cells of the two header rows."""
    names: dict[str, tuple[str, str]] = {}
    quarter = None
    for cell in above:
        quarter = above[cell].strip() if above[cell] and above[cell].strip() else quarter
        label = below[cell]
        if quarter is not None and label and label.strip():
            names[cell] = (quarter, label.strip())
    return names


def _weeks_long(body: DataFrame, names: Mapping[str, tuple[str, str]], id_columns: Sequence[str]) -> DataFrame:
    # One SQL expression: building hundreds of columns one by one costs more than the query.
    cells_sql = ", ".join(
        f"struct({_sql_text(q)} AS quarter, {_sql_text(label)} AS label, {position} AS position, `{cell}` AS raw)"
        for position, (cell, (q, label)) in enumerate(names.items(), start=1)
    )
    return (
        body.select(F.col(id_columns[0]).alias("product_id"), F.col(id_columns[1]).alias("attribute"), F.expr(f"inline(array({cells_sql}))"))
        .withColumn("value", parse_number(F.col("raw")))
        .drop("raw")
    )


WEEKS_SCHEMA = "product_id string, attribute string, quarter string, label string, position int, value double"
REJECTS_SCHEMA = "file string, line string, reason string"


def read_two_header_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(long table, rejects) of CSV files whose first two lines are headers: quarter over week.

    The first two lines of every file are found by their place: lines are numbered in order inside the block
    at offset 0 of their file. They are the schema, the only lines that come to the driver (once, whatever the
    number of files), and must be alike in all files. The other lines are parsed with it in one
    narrow pass. A line with another number of cells than the headers, or without product, is kept
    apart with the reason; blank lines are nothing. Cells cannot hold line ends.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min("id").alias("first"))
    # Numbers are consecutive within a block; a table has far fewer files than lines.
    placed = lines.join(F.broadcast(first), "file", "left").withColumn("row", F.when(F.col("block") == 0, F.col("id") - F.col("first")))
    heads = placed.where("row < 2").groupBy("file").agg(F.max(F.when(F.col("row") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("row") == 1, F.col("value"))).alias("b"))
    found = heads.select("a", "b").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("the files have different header rows")
    if not found or not found[0]["a"] or not found[0]["b"]:
        raise ValueError("the table needs two header rows")
    above, below = (next(csv.reader([text])) for text in found[0])
    width = max(len(above), len(below))
    columns = [f"c{i}" for i in range(width)]
    cells = dict(zip(columns, above + [None] * width)), dict(zip(columns, below + [None] * width))
    names = _week_columns(*({c: h[c] for c in columns[2:]} for h in cells))
    schema = ", ".join([*(f"{c} string" for c in columns), "_bad string"])
    body = placed.where("(row is null or row >= 2) and trim(value) <> ''").select(
        "file", F.col("value").alias("line"), F.from_csv("value", schema, {"columnNameOfCorruptRecord": "_bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("cells")
    )
    reason = F.when(F.col("cells._bad").isNotNull(), "wrong number of cells").when(F.coalesce(F.col("cells.c0"), F.lit("")) == "", "no product")
    judged = body.select("file", "line", reason.alias("reason"), "cells.*").drop("_bad")
    rejects = judged.where("reason is not null").select("file", "line", "reason")
    return _weeks_long(judged.where("reason is null"), names, columns[:2]), rejects


def read_planning_folder(spark: SparkSession, folder: str, suffix: str = ".csv") -> tuple[dict[str, DataFrame], DataFrame]:
    """({name: typed table}, rejects) of a folder with CSV files (or folders of them) named as the tables.

    supply_demand: long facts; density: product_id, density; week_ratio: week, ratio; yield and capacity: two
    header rows, long. `supply_demand` must be there. A missing ratio is the default one; the other
    optional tables are empty where missing, so that joins with them find nothing.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    paths = {}
    for name in REQUIRED_TABLES + OPTIONAL_TABLES:
        path = f"{folder.rstrip('/')}/{name}{suffix}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            paths[name] = path
    missing = [name for name in REQUIRED_TABLES if name not in paths]
    if missing:
        raise KeyError(f"missing tables: {', '.join(missing)}")
    tables = {"supply_demand": read_quarterly_facts(spark, paths["supply_demand"])}
    tables["density"] = density_long(spark.read.csv(paths["density"], header=True)) if "density" in paths else spark.createDataFrame([], "product_id string, density int")
    if "week_ratio" in paths:
        ratio = spark.read.csv(paths["week_ratio"], header=True).toDF("week", "ratio")
        tables["week_ratio"] = ratio.select(parse_number(F.col("week")).cast("int").alias("week"), parse_number(F.col("ratio")).alias("ratio"))
    else:
        tables["week_ratio"] = default_week_ratio(spark)
    rejects = spark.createDataFrame([], REJECTS_SCHEMA)
    for name in ("yield", "capacity"):
        if name in paths:
            tables[name], bad = read_two_header_table(spark, paths[name])
            rejects = rejects.unionByName(bad)
        else:
            tables[name] = spark.createDataFrame([], WEEKS_SCHEMA)
    return tables, rejects
