"""Percentages, the three roundings, and number formatting.

``pyspark.sql.functions.round`` rounds the decimal text half-up and agrees with
none of the three, so it is not used anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100``; null instead of an error for an empty total."""
    return F.try_divide(part, total) * F.lit(100.0)


def grouped(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def fixed(value: Column, places: int) -> Column:
    """Text with ``places`` decimals, no separators."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def round_exact(value: Column, places: int) -> Column:
    """Round the exact binary value: 12.35 -> 12.3, 0.25 -> 0.2."""
    return fixed(value, places).cast("double")


def round_scaled(value: Column, places: int) -> Column:
    """Scale, round half to even, unscale: 12.35 -> 12.4, 0.25 -> 0.2."""
    factor = F.lit(10.0**places)
    return F.rint(value * factor) / factor


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
