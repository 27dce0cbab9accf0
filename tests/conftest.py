from __future__ import annotations

import datetime as dt
import os

import pytest

from demandflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        8,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixtures() -> str:
    return os.path.join(os.path.dirname(__file__), "fixtures")


SUNDAY = dt.date(1995, 1, 1)


def make_series(spark, **products):
    """Weekly series from lists of values (None for a gap), all starting on the same Sunday."""
    rows = [
        (name, SUNDAY + dt.timedelta(days=7 * i), None if v is None else float(v))
        for name, values in products.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "product_id string, week_end date, demand double")


def by_product(df, column):
    """Values of a column per product in week order."""
    out: dict[str, list] = {}
    order = [c for c in ("week_end", "step") if c in df.columns]
    for row in df.orderBy("product_id", *order).collect():
        out.setdefault(row["product_id"], []).append(row[column])
    return out
