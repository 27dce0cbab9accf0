"""Sources, sinks, filters, reshaping and calendar."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contract import views as V
from contract.sql_parts import BW, FACTS, QU, SR, WQ, big, day, r
from contract.views import publish
from demandflow.functions.calendar import date_features, quarter_num_of, quarter_year_of, week_start
from demandflow.functions.numeric import normalize_label
from demandflow.operators import filters, series as S
from demandflow.operators.stats import eligible_products
from demandflow.session import shared_folder
from demandflow.sources import commits, readers, writers


def clean_numeric(spark, d):
    long = readers.clean_numeric(readers.unpivot_quarters(V.wide_text(spark, d)))
    return publish(long.select("product_id", "quarter", "value"), 1)


def unpivot_quarters(spark, d):
    return publish(readers.unpivot_quarters(V.wide_text(spark, d)))


UNPIVOT_CTE = (
    QU
    + """, labels AS (SELECT DISTINCT quarter FROM qs), ids AS (SELECT DISTINCT product_id FROM qs),
cells AS (SELECT product_id, quarter, demand FROM ids CROSS JOIN labels LEFT JOIN qs USING (product_id, quarter))"""
)


def header_sheet(spark, d):
    """Weekly capacity as a sheet: row 0 names quarters, row 1 weeks, the others products."""
    weeks = V.weekly_quarters(spark, d)
    ends = V.week_end(F.to_date("l_shipdate"))
    first, last = V.table(spark, d, "lineitem").agg(F.min(ends), F.max(ends)).first()
    count = (last - first).days // 7 + 1
    position = (F.floor(F.datediff("week_end", F.lit(first)) / 7) + 1).cast("int")

    def sheet(cells):
        """Rows (row_no, _c0, _c1, pos, cell) to one text column per week."""
        rows = cells.groupBy("row_no", "_c0", "_c1").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "cell"))).alias("m")
        )
        weekly = [f"try_element_at(m, {i}) AS _c{i + 1}" for i in range(1, count + 1)]
        return rows.selectExpr("row_no", "_c0", "_c1", *weekly)

    blank = F.lit(None).cast("string")
    calendar = weeks.select("week_end", "quarter", "quarter_index", "week_label").distinct().withColumn("pos", position)
    opens = F.min("pos").over(V.Window.partitionBy("quarter_index")) == F.col("pos")
    top = F.struct(F.lit(0).alias("row_no"), F.when(opens, F.col("quarter")).alias("cell"))
    under = F.struct(F.lit(1).alias("row_no"), F.col("week_label").alias("cell"))
    heads = calendar.withColumn("pair", F.array(top, under)).select("pos", F.inline("pair"))
    body = V.capacity(weeks).select(
        (V.brand_number() + 1).alias("row_no"),
        F.col("product_id").alias("_c0"),
        F.col("attribute").alias("_c1"),
        position.alias("pos"),
        F.format_number("capacity", 0).alias("cell"),
    )
    heads = heads.select("row_no", blank.alias("_c0"), blank.alias("_c1"), "pos", "cell")
    return sheet(heads.unionByName(body))


def two_level_header(spark, d):
    return publish(readers.two_level_header_to_long(header_sheet(spark, d)), 1)


def two_header_files(spark, d):
    """The same sheet written as text files, each with the header rows in front, and read from there."""
    sheet = header_sheet(spark, d)
    cells = [c for c in sheet.columns if c != "row_no"]
    files = F.when(F.col("row_no") < 2, F.sequence(F.lit(0), F.lit(2))).otherwise(F.array((F.col("row_no") % 3).cast("int")))
    line = F.to_csv(F.struct(*cells), {"emptyValue": "", "nullValue": ""})
    folder = f"{shared_folder(spark).rstrip('/')}/sheet-{uuid.uuid4().hex}"
    lines = sheet.select("row_no", line.alias("line"), F.explode(files).alias("part"))
    lines.repartitionByRange("part").sortWithinPartitions("part", "row_no").select("line", "part").write.partitionBy("part").text(folder)
    return publish(readers.read_two_header_table(spark, folder)[0], 1)


def plan_upsert(spark, d):
    weeks = V.capacity(V.weekly_quarters(spark, d))
    target = weeks.select("quarter", "week_label", "product_id", F.col("capacity").alias("wafers"))
    fresh = weeks.where((F.col("quarter_index") % 4 == 3) & (F.col("week_seq") <= 13)).select(
        "quarter", "week_label", "product_id", (F.col("capacity") * 0.9).alias("wafers")
    )
    return publish(writers.upsert_plan(target, fresh), 2)


def facts_upsert(spark, d):
    old = V.facts(spark, d)
    fresh = filters.filter_attribute(old).select(
        "product_id",
        "attribute",
        V.quarter_label(F.col("year") * 4 + F.col("quarter_num")).alias("quarter"),
        (F.col("value") * 1.1).alias("value"),
    )
    return publish(writers.upsert_facts(old, fresh), 1)


def stored_facts(spark, d):
    """The same upsert on disk: two commits, of which the second changes the touched buckets only."""
    old = V.facts(spark, d)
    fresh = filters.filter_attribute(old).select(
        "product_id",
        "attribute",
        V.quarter_label(F.col("year") * 4 + F.col("quarter_num")).alias("quarter"),
        (F.col("value") * 1.1).alias("value"),
    )
    folder = f"{shared_folder(spark).rstrip('/')}/facts-{uuid.uuid4().hex}"
    writers.write_facts(spark, old, folder, "old")
    writers.write_facts(spark, fresh, folder, "fresh")
    return publish(commits.read_table(spark, folder), 1)


def facts_pivot(spark, d):
    return publish(writers.facts_to_wide(V.facts(spark, d), V.quarter_labels(spark, d)), 1)


LABELS = [f"Q{q} {y % 100:02d}" for y in range(1995, 2002) for q in (1, 2, 3, 4)]


def filter_attribute(spark, d):
    return publish(filters.filter_attribute(V.facts(spark, d)).select("product_id", "quarter", "value"), 1)


def drop_zero_demand(spark, d):
    shifted = V.series(spark, d).withColumn("value", F.col("demand") - 100)
    return publish(filters.drop_zero_demand(shifted).select("product_id", "week_end", "value"))


def select_products(spark, d):
    parts = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("product_id"))
    ids = parts.agg(F.avg("p_size").alias("size")).where(F.col("size") > 25)
    return publish(filters.select_products(V.series(spark, d), ids))


def boundary_rows(spark, d):
    units = V.quarter_units(spark, d)
    key = F.when(F.col("units") % 3 != 0, F.col("units") * 5)
    rows = units.select("product_id", "quarter", key.alias("key"))
    total = units.groupBy("quarter").agg(F.lit("Total").alias("product_id"), F.sum(F.col("units") * 5).alias("key"))
    heading = units.groupBy("quarter").agg(F.lit("Product ID").alias("product_id"), F.max("units").alias("key"))
    return publish(filters.boundary_rows(rows.unionByName(total).unionByName(heading), "key"))


def impute_mean(spark, d):
    line = V.series(spark, d).withColumn("demand", F.when(F.col("demand") >= 60, F.col("demand")))
    return publish(filters.impute_mean(line, "demand", "week_end").select("product_id", "week_end", "demand"))


def validate_ratio(spark, d):
    weeks = V.weekly_quarters(spark, d)
    total = F.sum("quantity").over(V.Window.partitionBy("product_id", "quarter"))
    shares = weeks.withColumn("ratio", F.col("quantity") / total)
    shares = shares.withColumn("ratio", F.when((F.col("lines") > 1), F.col("ratio")))
    return publish(filters.validate_ratio(shares, "product_id", "quarter"))


def parse_quarter(spark, d):
    labels = V.quarter_units(spark, d).select("quarter").distinct()
    spelled = F.explode(
        F.array(
            "quarter", F.lower("quarter"), F.concat("quarter", F.lit("x")), F.concat(F.lit("FY "), "quarter"),
            F.regexp_replace("quarter", "^Q.", "Q7"), F.regexp_replace("quarter", "..$", "49"),
            F.regexp_replace("quarter", "..$", "50"),
        )
    )
    label = F.col("label")
    return publish(
        labels.select(spelled.alias("label"))
        .distinct()
        .select("label", quarter_year_of(label).alias("year"), quarter_num_of(label).alias("quarter_num"))
    )


def week_starts(spark, d):
    keyed = V.quarter_units(spark, d).select(
        F.floor(F.col("quarter_index") / 4).cast("int").alias("year"),
        F.explode(F.array((F.col("quarter_index") % 4 + 1).cast("int"), F.lit(7))).alias("quarter_num"),
    ).distinct()
    weeks = keyed.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(14))))
    return publish(
        weeks.withColumn("week_start", week_start(F.col("year"), F.col("quarter_num"), F.col("week")))
    )


def split_quarter(spark, d):
    weekly = S.weekly_demand(V.facts(spark, d), readers.default_week_ratio(spark))
    return publish(weekly.select("product_id", "quarter", "week", "week_start", "demand"), 2)


def resample_weekly(spark, d):
    lines = V.shipments(spark, d)
    regular = S.resample_weekly_last(lines, "ship_date", "l_quantity", ("l_orderkey", "l_linenumber", "l_quantity"))
    return publish(regular)


def dedup_last(spark, d):
    lines = V.shipments(spark, d).select("product_id", "ship_date", "l_orderkey", "l_linenumber", "l_quantity")
    kept = S.dedup_keep_last(lines, ["product_id", "ship_date"], ["l_orderkey", "l_linenumber", "l_quantity"])
    return publish(kept)


def first_match(spark, d):
    lines = V.shipments(spark, d).select("product_id", "l_orderkey", "l_linenumber", "l_quantity", "ship_date")
    return publish(
        S.first_match(lines, ["product_id", "l_orderkey"], ["ship_date", "l_linenumber", "l_quantity"])
    )


def trim_leading(spark, d):
    line = V.series(spark, d).withColumn("demand", F.greatest(F.col("demand") - 250, F.lit(0.0)))
    return publish(S.trim_leading(line))


def quarterly_series(spark, d):
    copies = V.facts(spark, d).where(F.col("attribute") == "EffectiveDemand").select(
        "product_id", F.explode(F.array("quarter", F.concat(F.lit(" "), "quarter"), F.lower("quarter"))).alias("quarter"),
        "year", "value",
    )
    padded = F.col("quarter").startswith(" ")
    shaped = copies.withColumn("copy", F.when(padded, 2).otherwise(1)).withColumn(
        "value", F.when(F.col("year") == 1995, F.lit(0.0)).otherwise(F.when(padded, F.col("value") + 1).otherwise(F.col("value")))
    )
    return publish(S.quarterly_series(shaped, "copy"), 1)


def future_weeks(spark, d):
    return publish(S.future_weeks(V.series(spark, d), 13))


def future_quarters(spark, d):
    labels = V.quarter_units(spark, d).select("quarter").distinct()
    spelled = labels.select(F.explode(F.array("quarter", F.lower("quarter"))).alias("quarter"))
    return publish(S.future_quarters(spelled, 6))


def future_week_labels(spark, d):
    labels = V.weekly_quarters(spark, d).select("week_label").distinct()
    spelled = labels.select(
        F.explode(F.array("week_label", F.lower("week_label"), F.regexp_replace("week_label", "_.*", "_53"))).alias("week_label")
    ).distinct()
    return publish(S.future_week_labels(spelled, 5))


def future_dates(spark, d):
    dates = V.brand_weeks(spark, d).select(
        F.concat(F.date_format("week_end", "dd-MM-yyyy"), F.lit(" 00:00:00")).alias("good"),
        F.date_format("week_end", "yyyy/MM/dd").alias("bad"),
    )
    texts = dates.select(F.explode(F.array("good", "bad")).alias("date_text")).distinct()
    return publish(S.future_dates(texts, 4))


def carry_forward(spark, d):
    line = V.yields(V.weekly_quarters(spark, d))
    gaps = line.withColumn("yield_value", F.when(F.col("yield_value") < 0.95, F.col("yield_value")))
    return publish(S.carry_forward(gaps, 13), 6)


def tail_k(spark, d):
    return publish(S.tail_k(V.series(spark, d), 26))


def backtest_split(spark, d):
    return publish(S.backtest_split(V.series(spark, d)))


def eligible(spark, d):
    return publish(eligible_products(V.series(spark, d)))


def dates(spark, d):
    return publish(V.series(spark, d).withColumns(date_features(F.col("week_end"))).drop("demand"))


def label_normalize(spark, d):
    rows = V.facts(spark, d).select("attribute", "quarter").distinct()
    padded = rows.select(
        F.concat(F.lit("  "), F.lower("quarter"), F.lit(" ")).alias("raw"), "attribute",
    )
    return publish(
        padded.select(
            "raw",
            "attribute",
            normalize_label(F.col("raw")).alias("label"),
            F.col("attribute").contains("Safety Stock Target").alias("is_safety"),
            F.format_string("WW_%02d", F.regexp_extract("raw", r"q(\d)", 1).cast("int")).alias("week_label"),
        )
    )


SERIES_COLS = f"product_id, {day()} AS week_end"

TWO_HEADERS = f"""WITH {WQ}, cal AS (SELECT DISTINCT week_end, quarter, week_label FROM wq), ids AS (SELECT DISTINCT product_id FROM wq)
SELECT product_id, 'Available Capacity' AS attribute, cal.quarter, cal.week_label AS label,
       {big("datediff('day', (SELECT min(week_end) FROM cal), cal.week_end) // 7 + 1")} AS position, {r('quantity * 5', 1)} AS value
FROM ids CROSS JOIN cal LEFT JOIN wq USING (product_id, week_end)"""

FACTS_UPSERT = f"""WITH {FACTS}, fresh AS (
  SELECT product_id, attribute, 'Q' || ((qi + 1) % 4 + 1) || ' ' || lpad(CAST(((qi + 1) // 4) % 100 AS VARCHAR), 2, '0') AS quarter, value * 1.1 AS value
  FROM facts WHERE attribute = 'EffectiveDemand')
SELECT product_id, attribute, quarter, {r('coalesce(n.value, o.value)', 1)} AS value
FROM facts o FULL OUTER JOIN fresh n USING (product_id, attribute, quarter)"""

QUERIES = {
    "clean_numeric": (
        clean_numeric,
        f"WITH {UNPIVOT_CTE} SELECT product_id, quarter, {r('demand', 1)} AS value FROM cells",
    ),
    "unpivot_quarters": (
        unpivot_quarters,
        f"WITH {UNPIVOT_CTE} SELECT product_id, 'EffectiveDemand' AS attribute, quarter, format('{{:,}}', CAST(demand AS BIGINT)) AS value FROM cells",
    ),
    "two_level_header": (two_level_header, TWO_HEADERS),
    "two_header_files": (two_header_files, TWO_HEADERS),
    "plan_upsert": (
        plan_upsert,
        f"""WITH {WQ} SELECT quarter, week_label, product_id,
  CASE WHEN qi % 4 = 3 THEN {r('quantity * 5 * 0.9', 2)} ELSE {r('quantity * 5', 2)} END AS wafers
FROM wq WHERE qi % 4 <> 3 OR week_seq <= 13""",
    ),
    "facts_upsert": (facts_upsert, FACTS_UPSERT),
    "stored_facts": (stored_facts, FACTS_UPSERT),
    "facts_pivot": (
        facts_pivot,
        f"WITH {FACTS} SELECT product_id, attribute, "
        + ", ".join(f"round(max(value) FILTER (quarter = '{q}'), 1) + 0.0 AS \"{q}\"" for q in LABELS)
        + " FROM facts GROUP BY 1, 2",
    ),
    "filter_attribute": (
        filter_attribute,
        f"WITH {QU} SELECT product_id, quarter, {r('demand', 1)} AS value FROM qs",
    ),
    "drop_zero_demand": (
        drop_zero_demand,
        f"WITH {SR} SELECT {SERIES_COLS}, {r('demand - 100')} AS value FROM sr WHERE demand - 100 <> 0",
    ),
    "select_products": (
        select_products,
        f"WITH {SR} SELECT {SERIES_COLS}, {r('demand')} AS demand FROM sr WHERE product_id IN (SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size) > 25)",
    ),
    "boundary_rows": (
        boundary_rows,
        f"WITH {QU} SELECT product_id, quarter, {r('units * 5')} AS key FROM qs WHERE CAST(units AS BIGINT) % 3 <> 0",
    ),
    "impute_mean": (
        impute_mean,
        f"""WITH {SR}, g AS (SELECT product_id, week_end, CASE WHEN demand >= 60 THEN demand END AS demand FROM sr)
SELECT {SERIES_COLS}, {r('coalesce(demand, avg(demand) OVER (PARTITION BY week_end), 0)')} AS demand FROM g""",
    ),
    "validate_ratio": (
        validate_ratio,
        f"""WITH {WQ}, sh AS (SELECT product_id, quarter, CASE WHEN lines > 1 THEN quantity / sum(quantity) OVER (PARTITION BY product_id, quarter) END AS ratio FROM wq)
SELECT product_id, quarter, {big('count(*)')} AS weeks, {r('coalesce(sum(ratio), 0)')} AS total, {big('count(*) FILTER (ratio IS NULL)')} AS missing,
       count(*) = 13 AND count(ratio) = count(*) AS ok, abs(coalesce(sum(ratio), 0) - 1) > 1e-6 AS sum_warning FROM sh GROUP BY 1, 2""",
    ),
    "parse_quarter": (
        parse_quarter,
        f"""WITH {QU}, l AS (SELECT DISTINCT quarter FROM qs), s AS (SELECT DISTINCT unnest([quarter, lower(quarter), quarter || 'x', 'FY ' || quarter,
    regexp_replace(quarter, '^Q.', 'Q7'), regexp_replace(quarter, '..$', '49'), regexp_replace(quarter, '..$', '50')]) AS label FROM l),
p AS (SELECT label, nullif(regexp_extract(label, 'Q(\\d)', 1), '') AS q, nullif(regexp_extract(label, ' (\\d{{2}})$', 1), '') AS y FROM s)
SELECT label, {big("CASE WHEN q IS NULL OR y IS NULL THEN -1 WHEN CAST(y AS INT) >= 50 THEN 1900 + CAST(y AS INT) ELSE 2000 + CAST(y AS INT) END")} AS year,
       {big("CASE WHEN q IS NULL OR y IS NULL THEN -1 ELSE CAST(q AS INT) END")} AS quarter_num FROM p""",
    ),
    "week_start": (
        week_starts,
        f"""WITH {QU}, k AS (SELECT DISTINCT qi // 4 AS year, unnest([qi % 4 + 1, 7]) AS quarter_num FROM qs),
w AS (SELECT year, quarter_num, unnest(generate_series(0, 14)) AS week FROM k)
SELECT {big('year')} AS year, {big('quarter_num')} AS quarter_num, {big('week')} AS week,
       CASE WHEN quarter_num <= 4 AND week BETWEEN 1 AND 13 THEN strftime(make_date(year, least(quarter_num, 4) * 3 - 2, 1) + CAST(7 * (week - 1) AS INTEGER), '%Y-%m-%d') END AS week_start FROM w""",
    ),
    "split_quarter": (
        split_quarter,
        f"""WITH {QU}, ratio AS (SELECT unnest(generate_series(1, 13)) AS week, unnest([0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.055, 0.06, 0.1, 0.1, 0.15, 0.15]) AS ratio)
SELECT product_id, quarter, {big('week')} AS week, strftime(make_date(qi // 4, (qi % 4) * 3 + 1, 1) + CAST(7 * (week - 1) AS INTEGER), '%Y-%m-%d') AS week_start,
       {r('demand * CAST(ratio AS DOUBLE)', 2)} AS demand FROM qs CROSS JOIN ratio WHERE demand <> 0""",
    ),
    "resample_weekly": (
        resample_weekly,
        f"""WITH raw AS (SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS d, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
wk AS (SELECT product_id, d + CAST(7 - isodow(d) AS INTEGER) AS week_end, l_quantity,
       row_number() OVER (PARTITION BY product_id, d + CAST(7 - isodow(d) AS INTEGER) ORDER BY d DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS k FROM raw),
b AS (SELECT product_id, week_end, l_quantity AS demand FROM wk WHERE k = 1),
g AS (SELECT product_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM b GROUP BY 1)
SELECT {SERIES_COLS}, {r('demand')} AS demand FROM g LEFT JOIN b USING (product_id, week_end)""",
    ),
    "dedup_last": (
        dedup_last,
        f"""WITH raw AS (SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT product_id, {day('ship_date')} AS ship_date, l_orderkey, {big('l_linenumber')} AS l_linenumber, {r('l_quantity')} AS l_quantity FROM raw
QUALIFY row_number() OVER (PARTITION BY product_id, ship_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""",
    ),
    "first_match": (
        first_match,
        f"""WITH raw AS (SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS ship_date, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT product_id, l_orderkey, {big('l_linenumber')} AS l_linenumber, {r('l_quantity')} AS l_quantity, {day('ship_date')} AS ship_date FROM raw
QUALIFY row_number() OVER (PARTITION BY product_id, l_orderkey ORDER BY ship_date, l_linenumber, l_quantity) = 1""",
    ),
    "trim_leading": (
        trim_leading,
        f"""WITH {SR}, z AS (SELECT product_id, week_end, CASE WHEN demand IS NULL THEN 0.0 ELSE greatest(demand - 250, 0.0) END AS demand FROM sr),
f AS (SELECT *, min(CASE WHEN demand > 0 THEN week_end END) OVER (PARTITION BY product_id) AS first FROM z)
SELECT {SERIES_COLS}, {r('demand')} AS demand FROM f WHERE first IS NULL OR week_end >= first""",
    ),
    "quarterly_series": (
        quarterly_series,
        f"WITH {QU} SELECT product_id, {big('qi')} AS quarter_index, {r('demand + 1', 1)} AS demand FROM qs WHERE qi // 4 > 1995",
    ),
    "future_weeks": (
        future_weeks,
        f"""WITH {BW}, l AS (SELECT product_id, max(week_end) AS last FROM bw GROUP BY 1), s AS (SELECT *, unnest(generate_series(1, 13)) AS step FROM l)
SELECT product_id, {day('last + CAST(7 * step AS INTEGER)')} AS week_end, {big('step')} AS step FROM s""",
    ),
    "future_quarters": (
        future_quarters,
        f"""WITH {QU}, l AS (SELECT DISTINCT quarter, (qi // 4) % 100 * 4 + qi % 4 AS c FROM qs), s AS (SELECT *, unnest(generate_series(1, 6)) AS step FROM l)
SELECT quarter, {big('step')} AS step, 'Q' || ((c + step) % 4 + 1) || ' ' || lpad(CAST((c + step) // 4 % 100 AS VARCHAR), 2, '0') AS next_quarter FROM s""",
    ),
    "future_week_labels": (
        future_week_labels,
        f"""WITH {WQ}, l AS (SELECT DISTINCT week_label FROM wq), s AS (SELECT CAST(substr(week_label, 4) AS INT) AS n, unnest([week_label, lower(week_label)]) AS week_label FROM l),
t AS (SELECT *, unnest(generate_series(1, 5)) AS step FROM s)
SELECT week_label, {big('step')} AS step, 'WW_' || lpad(CAST((n - 1 + step) % 52 + 1 AS VARCHAR), 2, '0') AS next_label FROM t""",
    ),
    "future_dates": (
        future_dates,
        f"""WITH {BW}, l AS (SELECT DISTINCT week_end FROM bw), s AS (SELECT *, unnest(generate_series(1, 4)) AS step FROM l)
SELECT strftime(week_end, '%d-%m-%Y') || ' 00:00:00' AS date_text, {big('step')} AS step, strftime(week_end + CAST(7 * step AS INTEGER), '%d-%m-%Y') AS next_date FROM s""",
    ),
    "carry_forward": (
        carry_forward,
        f"""WITH {BW}, y AS (SELECT product_id, week_end, 1 - discount / lines AS v FROM bw),
l AS (SELECT product_id, max(week_end) AS last, arg_max(v, week_end) FILTER (v < 0.95) AS v FROM y GROUP BY 1), s AS (SELECT *, unnest(generate_series(1, 13)) AS step FROM l)
SELECT product_id, {day('last + CAST(7 * step AS INTEGER)')} AS week_end, {big('step')} AS step, {r('v', 6)} AS yield_value FROM s""",
    ),
    "tail_k": (
        tail_k,
        f"WITH {SR} SELECT {SERIES_COLS}, {r('demand')} AS demand FROM sr QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sr.week_end DESC) <= 26",
    ),
    "backtest_split": (
        backtest_split,
        f"""WITH {SR} SELECT {SERIES_COLS}, {r('demand')} AS demand, {big('count(*) OVER (PARTITION BY product_id)')} AS rows, {big('13')} AS test_rows,
  row_number() OVER (PARTITION BY product_id ORDER BY sr.week_end DESC) <= 13 AS is_test FROM sr""",
    ),
    "eligible_products": (eligible, f"WITH {BW} SELECT DISTINCT product_id FROM bw ORDER BY 1"),
    "date_features": (
        dates,
        f"""WITH {SR}, f AS (SELECT product_id, week_end AS w, (week(week_end) - 1) % 13 + 1 AS woq FROM sr)
SELECT product_id, {day('w')} AS week_end, {big('quarter(w)')} AS quarter, {big('month(w)')} AS month, {big('week(w)')} AS week, {big('woq')} AS week_of_quarter,
  {big('CASE WHEN woq IN (12, 13) THEN 1 ELSE 0 END')} AS is_quarter_end, {big('year(w)')} AS year, {big('dayofyear(w)')} AS day_of_year, {big('day(w)')} AS day_of_month,
  {big('isodow(w) - 1')} AS day_of_week, {big('quarter(w) * woq')} AS quarter_week_interaction, {big('quarter(w) * quarter(w)')} AS quarter_squared FROM f""",
    ),
    "label_normalize": (
        label_normalize,
        f"""WITH {FACTS} SELECT DISTINCT '  ' || lower(quarter) || ' ' AS raw, attribute, upper(trim('  ' || lower(quarter) || ' ')) AS label,
  contains(attribute, 'Safety Stock Target') AS is_safety, 'WW_' || lpad(regexp_extract(quarter, 'Q(\\d)', 1), 2, '0') AS week_label FROM facts""",
    ),
}
