"""Quarter labels, week labels and calendar parts as column expressions.

A quarter label reads `Q3 97`; a week label reads `WW_07`. Weeks end on Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS_PER_QUARTER = 13
CENTURY_PIVOT = 50
WEEK_LABELS_PER_YEAR = 52


def quarter_num_of(label: Column) -> Column:
    """Digit after `Q`, -1 when the label does not parse."""
    digit = F.regexp_extract(label, r"Q(\d)", 1)
    two_digit_year = F.regexp_extract(label, r" (\d{2})$", 1)
    parsed = (digit != "") & (two_digit_year != "")
    return F.when(parsed, digit.try_cast("int")).otherwise(F.lit(-1)).cast("int")


def quarter_year_of(label: Column) -> Column:
    """Four-digit year of the label, -1 when it does not parse."""
    digit = F.regexp_extract(label, r"Q(\d)", 1)
    yy = F.regexp_extract(label, r" (\d{2})$", 1)
    number = yy.try_cast("int")
    full = F.when(number >= CENTURY_PIVOT, number + 1900).otherwise(number + 2000)
    return F.when((digit != "") & (yy != ""), full).otherwise(F.lit(-1)).cast("int")


def strict_quarter_index(label: Column) -> Column:
    """`year * 4 + quarter - 1` for exactly `Q<1-4> <yy>` (outer blanks allowed), else null."""
    text = F.trim(label)
    q = F.regexp_extract(text, r"^Q([1-4])\s+(\d+)$", 1).try_cast("int")
    yy = F.regexp_extract(text, r"^Q([1-4])\s+(\d+)$", 2).try_cast("int")
    year = F.when(yy >= CENTURY_PIVOT, yy + 1900).otherwise(yy + 2000)
    return year * 4 + q - 1


def quarter_index(year: Column, quarter: Column) -> Column:
    """Running number of a quarter; consecutive quarters differ by one."""
    return year * 4 + quarter - 1


def quarter_label(index: Column) -> Column:
    """Label of a running quarter number."""
    year = F.floor(index / 4).cast("int")
    return F.format_string("Q%d %02d", (index % 4 + 1).cast("int"), (year % 100).cast("int"))


def quarter_index_of_date(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def week_start(year: Column, quarter: Column, week: Column) -> Column:
    """First day of a week of a quarter, seven-day steps from the quarter's first day.

    Null when the quarter is not 1-4 or the week is not 1-13.
    """
    valid = quarter.between(1, 4) & week.between(1, WEEKS_PER_QUARTER) & (year > 0)
    first = F.make_date(year, F.when(valid, quarter * 3 - 2), F.lit(1))
    return F.when(valid, F.date_add(first, (week - 1) * 7))


def week_end(day: Column) -> Column:
    """The Sunday that closes the week of `day`; a Sunday closes its own week."""
    return F.date_add(day, 6 - F.weekday(day))


def week_of_quarter(day: Column) -> Column:
    """1-13 from the ISO week number; ISO week 53 counts as 1."""
    return (F.weekofyear(day) - 1) % WEEKS_PER_QUARTER + 1


def date_features(day: Column) -> dict[str, Column]:
    """Calendar features of a date, keyed by column name."""
    q = F.quarter(day)
    woq = week_of_quarter(day)
    return {
        "quarter": q,
        "month": F.month(day),
        "week": F.weekofyear(day),
        "week_of_quarter": woq,
        "is_quarter_end": woq.isin(12, 13).cast("int"),
        "year": F.year(day),
        "day_of_year": F.dayofyear(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": F.weekday(day),
        "quarter_week_interaction": q * woq,
        "quarter_squared": q * q,
    }


def quarter_successors(label: Column, count: Column | int) -> Column:
    """Array of the `count` labels after `label`; empty when it is not `Q<1-4> <yy>`."""
    pattern = r"^Q([1-4])\s+(\d{2})$"
    q = F.regexp_extract(label, pattern, 1).try_cast("int")
    yy = F.regexp_extract(label, pattern, 2).try_cast("int")
    here = yy * 4 + q - 1
    steps = F.transform(
        F.sequence(F.lit(1), _as_int(count)),
        lambda k: F.format_string(
            "Q%d %02d", ((here + k) % 4 + 1).cast("int"), (F.floor((here + k) / 4) % 100).cast("int")
        ),
    )
    return F.when(here.isNotNull() & (_as_int(count) >= 1), steps).otherwise(_no_strings())


def week_label_number(label: Column) -> Column:
    """Number in `WW_nn` (any case), null outside 1-52 or for other text."""
    n = F.regexp_extract(F.upper(label), r"^WW_(\d{1,2})$", 1).try_cast("int")
    return F.when(n.between(1, WEEK_LABELS_PER_YEAR), n)


def week_label_successors(label: Column, count: Column | int) -> Column:
    """Array of the `count` week labels after `label`; 52 is followed by 01."""
    n = week_label_number(label)
    steps = F.transform(
        F.sequence(F.lit(1), _as_int(count)),
        lambda k: F.format_string("WW_%02d", ((n - 1 + k) % WEEK_LABELS_PER_YEAR + 1).cast("int")),
    )
    return F.when(n.isNotNull() & (_as_int(count) >= 1), steps).otherwise(_no_strings())


def parse_day_month_year(text: Column) -> Column:
    """Date of `dd-MM-yyyy`, tolerating a time after a blank; null for other text."""
    day = F.split(F.trim(text), " ").getItem(0)
    return F.try_to_timestamp(day, F.lit("d-M-yyyy")).cast("date")


def date_successors(text: Column, count: Column | int, step: int = 7) -> Column:
    """Array of `count` dates after `text`, `step` days apart, written `dd-MM-yyyy`."""
    start = parse_day_month_year(text)
    steps = F.transform(
        F.sequence(F.lit(1), _as_int(count)),
        lambda k: F.date_format(F.date_add(start, k * step), "dd-MM-yyyy"),
    )
    return F.when(start.isNotNull() & (_as_int(count) >= 1), steps).otherwise(_no_strings())


def _as_int(count: Column | int) -> Column:
    return count.cast("int") if isinstance(count, Column) else F.lit(int(count))


def _no_strings() -> Column:
    return F.array().cast("array<string>")
