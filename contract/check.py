"""Run queries beside their SQL in DuckDB and compare rows, columns and values.

    python -m contract.check [sf dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from contract.catalog import ALL
from demandflow.session import build_session


def sql_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    with duckdb.connect() as con:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            name = os.path.basename(path)[: -len(".parquet")]
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        return con.execute(sql).df()


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """First difference of two frames regardless of row and column order, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    columns = sorted(got.columns)
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in columns if got[c].dtype.kind != want[c].dtype.kind}
    rows = [
        sorted(tuple("NULL" if pd.isna(v) else repr(v) for v in row) for row in df[columns].itertuples(index=False, name=None))
        for df in (got.astype(object), want.astype(object))
    ]
    bad = [(a, b) for a, b in zip(*rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {dict(zip(columns, zip(*bad[0])))}"
    return f"types {kinds}" if kinds else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(ALL)
    spark = build_session("check", "local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        fn, sql = ALL[name]
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = "no sql" if sql is None else difference(got, sql_frame(sf_dir, sql)) or "ok"
        except Exception as error:  # report and go on with the next query
            took, verdict, got = time.time() - start, f"ERROR {" ".join(str(error).split())[:700]}", []
        failed += verdict not in ("ok", "no sql")
        print(f"{name:24s} {len(got):7d} rows {took:6.2f}s  {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
