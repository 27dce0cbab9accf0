"""Shared pieces of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

BW = """bw AS (
  SELECT p_brand AS product_id,
         CAST(l_shipdate AS DATE) + CAST(7 - isodow(CAST(l_shipdate AS DATE)) AS INTEGER) AS week_end,
         sum(l_quantity) AS quantity, sum(l_discount) AS discount, count(*) AS lines
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SR = (
    BW
    + """, grid AS (
  SELECT product_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM bw GROUP BY product_id),
sr AS (SELECT g.product_id, g.week_end, b.quantity AS demand FROM grid g LEFT JOIN bw b USING (product_id, week_end))"""
)

# sr with position from both ends and the number of rows
SRN = (
    SR
    + """, srn AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY week_end) AS pos,
         row_number() OVER (PARTITION BY product_id ORDER BY week_end DESC) AS rk,
         count(*) OVER (PARTITION BY product_id) AS n
  FROM sr)"""
)

QU = (
    BW
    + """, qu AS (
  SELECT product_id, qi, 'Q' || (qi % 4 + 1) || ' ' || lpad(CAST((qi // 4) % 100 AS VARCHAR), 2, '0') AS quarter, units,
         CAST(CASE CAST(split_part(product_id, '#', 2) AS INTEGER) % 3 WHEN 0 THEN 1.82 WHEN 1 THEN 1.56 ELSE 1.42 END AS DOUBLE) AS wos
  FROM (SELECT product_id, year(week_end) * 4 + quarter(week_end) - 1 AS qi, sum(quantity) AS units FROM bw GROUP BY 1, 2)),
qs AS (
  SELECT product_id, qi, quarter, units, wos, units * 3400.0 AS demand, units * 3500.0 AS supply,
         units * 3400.0 * (0.02 + 0.02 * (qi % 4 + 1)) AS balance,
         coalesce(lead(units * 3400.0) OVER (PARTITION BY product_id ORDER BY qi), units * 3400.0) / 13 * wos AS safety_stock
  FROM qu)"""
)

FACTS = (
    QU
    + """, facts AS (
  SELECT product_id, 'EffectiveDemand' AS attribute, quarter, qi, demand AS value FROM qs
  UNION ALL SELECT product_id, 'Yielded Supply', quarter, qi, supply FROM qs
  UNION ALL SELECT product_id, 'Safety Stock Target', quarter, qi, safety_stock FROM qs
  UNION ALL SELECT product_id, 'Safety Stock Target (WOS)', quarter, qi, wos FROM qs
  UNION ALL SELECT product_id, 'Total Projected Inventory Balance', quarter, qi, balance FROM qs)"""
)

_WEEK_LABEL = "'WW_' || lpad(CAST((week(week_end) - 1) % 52 + 1 AS VARCHAR), 2, '0')"

WQ_BODY = f""", wq AS (
  SELECT product_id, week_end, quantity, discount, lines,
         year(week_end) * 4 + quarter(week_end) - 1 AS qi,
         'Q' || quarter(week_end) || ' ' || lpad(CAST(year(week_end) % 100 AS VARCHAR), 2, '0') AS quarter,
         {_WEEK_LABEL} AS week_label,
         row_number() OVER (PARTITION BY product_id, year(week_end) * 4 + quarter(week_end) ORDER BY week_end) AS week_seq
  FROM bw)"""

WQ = BW + WQ_BODY

# plan inputs: one row per product, quarter and week
PI = (
    FACTS
    + WQ_BODY
    + """, dens AS (SELECT p_brand AS product_id, floor(round(avg(p_retailprice), 4)) AS density FROM part GROUP BY 1),
op AS (
  SELECT product_id, qi, quarter, demand, safety_stock,
         CASE WHEN lag(qi) OVER w = qi - 1 THEN lag(balance) OVER w END AS opening
  FROM qs WINDOW w AS (PARTITION BY product_id ORDER BY qi)),
pi AS (
  SELECT wq.product_id, wq.quarter, wq.qi, week_seq, week_label,
         density * (1 - discount / lines) AS b, quantity * 5 AS cap, safety_stock, demand, opening
  FROM wq JOIN op ON wq.product_id = op.product_id AND wq.qi = op.qi AND opening IS NOT NULL
          JOIN dens ON wq.product_id = dens.product_id)"""
)


def plan_ctes(source: str, out: str, lots: int = 5, min_lots: int = 20, ramp: int = 112, lo: str = "200000", hi: str = "900000") -> str:
    """Capacity plan of the week rows in `source`; result rows (week level) in `out`.

    Every cut from 0 up to the largest plan is listed and the least one under the upper edge
    kept.
    """
    k = out
    return f""", {k}_u AS (
  SELECT *, min(floor(cap / {lots}) + {ramp} * week_seq) OVER (
      PARTITION BY product_id, quarter ORDER BY week_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - {ramp} * week_seq AS u
  FROM {source}),
{k}_q AS (
  SELECT product_id, quarter, min(u) AS umin, max(u) AS umax, sum({lots} * b * u) AS best, sum({lots} * b * {min_lots}) AS least,
         max(safety_stock + demand - opening) + {lo} AS slo, max(safety_stock + demand - opening) + {hi} AS shi
  FROM {k}_u GROUP BY 1, 2),
{k}_cut AS (
  SELECT c.product_id, c.quarter, min(cut) AS cut
  FROM (SELECT q.product_id, q.quarter, q.cut, sum({lots} * b * greatest({min_lots}, u - cut)) AS total, any_value(shi) AS shi
        FROM (SELECT *, unnest(generate_series(0, CAST(umax - {min_lots} AS BIGINT))) AS cut FROM {k}_q
              WHERE umin >= {min_lots} AND best >= slo AND least <= shi) q
        JOIN {k}_u USING (product_id, quarter) GROUP BY 1, 2, 3) c
  WHERE total <= shi GROUP BY 1, 2),
{k}_p AS (
  SELECT w.*, c.cut, q.slo, q.shi, greatest({min_lots}, u - c.cut) AS p,
         CASE WHEN c.cut > 0 THEN greatest({min_lots}, u - c.cut + 1) ELSE u END AS raised
  FROM {k}_u w JOIN {k}_q q USING (product_id, quarter) LEFT JOIN {k}_cut c USING (product_id, quarter)),
{k}_s AS (
  SELECT *, sum({lots} * b * p) OVER (PARTITION BY product_id, quarter) AS base,
         sum({lots} * b * (raised - p)) OVER (PARTITION BY product_id, quarter ORDER BY week_seq
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back
  FROM {k}_p),
{k}_y AS (SELECT *, CASE WHEN back <= shi - base THEN raised ELSE p END AS y FROM {k}_s),
{k} AS (
  SELECT * EXCLUDE (ok), coalesce(ok, FALSE) AS feasible, CASE WHEN coalesce(ok, FALSE) THEN y * {lots} ELSE cap END AS wafers
  FROM (SELECT *, cut IS NOT NULL AND sum({lots} * b * y) OVER (PARTITION BY product_id, quarter) >= slo AS ok FROM {k}_y))"""


def r(expr: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def day(expr: str = "week_end") -> str:
    return f"strftime({expr}, '%Y-%m-%d')"
