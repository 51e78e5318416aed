"""Ratios and rounding that never divide by zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 when whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """Share in percent, rounded unless ``digits`` is None; 0 when whole is 0."""
    value = ratio(part, whole) * 100
    return value if digits is None else F.round(value, digits)


def whole_average(total: Column, count: Column) -> Column:
    """Average rounded half-even to an integer, 0 for an empty group."""
    return F.bround(ratio(total, count), 0).cast("long")
