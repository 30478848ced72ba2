"""Dates from Unix seconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_timestamp(seconds: Column) -> Column:
    """Naive UTC timestamp."""
    zero = F.lit(0)
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(
        zero, zero, zero, seconds
    )


def epoch_date(seconds: Column) -> Column:
    days = F.floor(seconds / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def epoch_month(seconds: Column) -> Column:
    """First day of the month."""
    return F.trunc(epoch_date(seconds), "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")
