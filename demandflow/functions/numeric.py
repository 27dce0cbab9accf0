"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """Double from text with thousands separators; blanks and other text give null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def normalize_label(text: Column) -> Column:
    """Header text without outer blanks, in upper case, for label matching."""
    return F.upper(F.trim(text))


def zero_floor(value: Column) -> Column:
    """Value, or 0 when it is negative or missing."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def nonneg_int(value: Column) -> Column:
    """Whole part of the value, 0 when it is negative or missing."""
    return F.floor(zero_floor(value)).cast("long")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Value limited to [low, high]; null stays null."""
    low_c = low if isinstance(low, Column) else F.lit(low)
    high_c = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low_c), high_c))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def shrink_to_mean(
    value: Column, mean: Column, std_pop: Column, count: Column, sensitivity: float = 0.5
) -> Column:
    """Pull a value towards the mean, the more the farther it lies from it.

    Unchanged with fewer than two observations or a spread under 1e-6.
    """
    z = (value - mean) / F.when(std_pop >= 1e-6, std_pop)
    pulled = mean + (value - mean) * (1 - sensitivity * F.tanh(F.abs(z) / 2))
    return F.when((count >= 2) & (std_pop >= 1e-6), pulled).otherwise(value)


def blend_weight(step: Column, rows: Column, cv: Column, flagged: Column) -> Column:
    """Weight of the tree model against the seasonal value; `step` counts from 0.

    `cv` is null when the history's mean is not positive; volatility rules then do not apply.
    """
    base = F.when(rows < 52, F.greatest(0.7 - step * 0.08, F.lit(0.3))).otherwise(
        F.greatest(0.8 - step * 0.05, F.lit(0.4))
    )
    near = F.greatest(0.6 - step * 0.1, F.lit(0.25))
    far = F.greatest(0.4 - (step - 8) * 0.05, F.lit(0.2))
    volatile = cv.isNotNull() & ((cv > 0.5) | flagged)
    return F.when(volatile, F.when(step > 8, far).otherwise(near)).otherwise(base)


def boundary_blend_weight(step: Column, observations: Column) -> Column:
    """Weight of the tree model in the capacity forecast; `step` counts from 0."""
    short = F.greatest(0.6 - step * 0.08, F.lit(0.2))
    return F.when(observations < 26, short).otherwise(F.greatest(0.8 - step * 0.05, F.lit(0.3)))


def recency_weight(rank_from_end: Column, length: Column, start: float) -> Column:
    """`exp` of an even grid from `start` (oldest) to 0 (newest, rank 1) over `length` points.

    With one point the grid is just `start`, which cancels once weights are normalised.
    """
    span = F.greatest(length - 1, F.lit(1))
    return F.exp(F.lit(start) * (rank_from_end - 1) / span)


def median_of(values: Column) -> Column:
    """Median of a short array, nulls left out; null when nothing is left."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (lower + upper) / 2
