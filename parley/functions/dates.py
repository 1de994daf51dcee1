"""Wall-clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.patterns import WEEKDAYS


def message_timestamp(
    day: Column,
    month: Column,
    year: Column,
    hour: Column,
    minute: Column,
    second: Column,
    meridiem: Column,
    date_order: str | Column = "DMY",
) -> Column:
    """Build a TIMESTAMP_NTZ from captured strings; null when out of range.

    ``date_order`` may be a column; there all but 'MDY' is day first.

    Numbers are put together directly instead of trying several date formats
    one after another: a failed format costs an exception per row.
    """
    if isinstance(date_order, Column):
        swapped = F.coalesce(date_order == "MDY", F.lit(False))
        day, month = F.when(swapped, month).otherwise(day), F.when(swapped, day).otherwise(month)
    elif date_order == "MDY":
        day, month = month, day
    elif date_order != "DMY":
        raise ValueError(f"date_order must be 'DMY' or 'MDY', got {date_order!r}")
    number = lambda c: c.try_cast("int")
    yy = number(year)
    full_year = (
        F.when(F.length(year) == 4, yy)
        .when((F.length(year) == 2) & (yy < 69), yy + 2000)
        .when(F.length(year) == 2, yy + 1900)
    )
    h = number(hour)
    half = F.upper(meridiem)
    full_hour = (
        F.when(F.coalesce(half, F.lit("")) == "", h)
        .when((h < 1) | (h > 12), F.lit(None))
        .otherwise(h % 12 + F.when(half == "PM", 12).otherwise(0))
    )
    sec = F.coalesce(number(second), F.lit(0))
    sec = F.when(sec < 60, sec)
    return F.try_make_timestamp_ntz(
        full_year, number(month), number(day), full_hour, number(minute), sec
    )


def weekday_name(number: Column) -> Column:
    """0 = Monday."""
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), (number + 1).cast("int"))


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour periods between two times, at least 1."""
    days = F.extract(F.lit("DAY"), end - start).cast("bigint")
    return F.greatest(days, F.lit(1).cast("bigint"))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM yyyy")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def one_decimal(number: Column) -> Column:
    return F.call_function("format_number", number, F.lit("0.0"))
