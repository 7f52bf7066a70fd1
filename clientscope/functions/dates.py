"""Calendar helpers. Month ends are the unit of every snapshot, window and report date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: str | Column) -> Column:
    """A date column from a ``yyyy-MM-dd`` literal, or the column itself cast to date."""
    return F.lit(value).cast("date") if isinstance(value, str) else value.cast("date")


def month_start(d: str | Column) -> Column:
    return F.trunc(day(d), "MM")


def shift_month_end(d: str | Column, months: int) -> Column:
    """Month end ``months`` away. ``add_months`` alone keeps the day of month, so it is wrapped in ``last_day``."""
    return F.last_day(F.add_months(day(d), months))


def window_start(d: str | Column, months: int) -> Column:
    """First month end inside a window of ``months`` month ends that closes at ``d``."""
    return shift_month_end(d, -(months - 1))


def int_day(d: str | Column) -> Column:
    """Date as a yyyyMMdd integer, the form some partition columns use."""
    return F.date_format(day(d), "yyyyMMdd").cast("int")


def in_month_to_date(col: Column, anchor: str | Column) -> Column:
    return col.between(month_start(anchor), day(anchor))


def in_previous_month(col: Column, anchor: str | Column) -> Column:
    return (col >= F.add_months(month_start(anchor), -1)) & (col < month_start(anchor))


def in_lookback(col: Column, anchor: str | Column, months: int) -> Column:
    """Between the month end ``months`` before the anchor and the anchor, both included."""
    return col.between(shift_month_end(anchor, -months), day(anchor))


def in_last_weeks(col: Column, anchor: str | Column, weeks: int) -> Column:
    return col.between(F.date_sub(day(anchor), 7 * weeks), day(anchor))


def calendar_month_bucket(col: Column, anchor: str | Column, months: int = 3) -> Column:
    """1 for the anchor's own calendar month up to the anchor, 2 for the month before it, and so on; else null."""
    bucket = F.when(in_month_to_date(col, anchor), F.lit(1))
    for k in range(1, months):
        start = F.add_months(month_start(anchor), -k)
        bucket = bucket.when(col.between(start, F.last_day(start)), F.lit(k + 1))
    return bucket


def month_end_bucket(col: Column, anchor: str | Column, months: int = 3) -> Column:
    """Same numbering with half-open intervals (previous month end, month end]."""
    bucket = F.when((col > shift_month_end(anchor, -1)) & (col <= day(anchor)), F.lit(1))
    for k in range(1, months):
        bucket = bucket.when(
            (col > shift_month_end(anchor, -(k + 1))) & (col <= shift_month_end(anchor, -k)), F.lit(k + 1)
        )
    return bucket
