"""Date buckets and named ranges."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, functions as F

GRAINS = ("day", "week", "month")


def bucket(day: Column, grain: str) -> Column:
    """Bucket start.  Weeks begin on Monday and are split at month starts."""
    if grain == "day":
        return day
    if grain == "week":
        return F.greatest(F.date_trunc("WEEK", day).cast("date"), F.trunc(day, "MM"))
    if grain == "month":
        return F.trunc(day, "MM")
    raise ValueError(f"grain must be one of {GRAINS}: {grain!r}")


def bucket_end(start: Column, grain: str = "week") -> Column:
    """Last day covered by a bucket as the comparison filters see it."""
    if grain == "day":
        return start
    if grain == "month":
        return F.last_day(start)
    return F.least(F.date_add(start, 6), F.last_day(start))


def week_monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def _months_begun(day: dt.date, size: int) -> dt.date:
    """First day of the block of ``size`` months (1, 3, 12) that holds the day."""
    return day.replace(month=day.month - (day.month - 1) % size, day=1)


LOWER_BOUNDS = {
    **{f"last{n}": (lambda day, n=n: day - dt.timedelta(days=n - 1)) for n in (7, 30)},
    **{name: (lambda day, n=n: _months_begun(day, n)) for name, n in (("mtd", 1), ("qtd", 3), ("ytd", 12))},
    "today": lambda day: day,
}


def range_bounds(
    name: str, as_of: dt.date, custom: tuple[dt.date, dt.date] | None = None
) -> tuple[dt.date, dt.date]:
    """Inclusive bounds of a named range; an incomplete custom range means last 30, an unknown name year to date."""
    if name == "custom" and custom and all(custom):
        return custom
    first_day = LOWER_BOUNDS.get("last30" if name == "custom" else name, LOWER_BOUNDS["ytd"])
    return first_day(as_of), as_of


def shift_months(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    year, month = index // 12, index % 12 + 1
    return dt.date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


def month_spine_bounds(as_of: dt.date, months_back: int = 13) -> tuple[dt.date, dt.date]:
    """First and last month of the P&L spine, both included."""
    return shift_months(as_of, -months_back).replace(day=1), as_of.replace(day=1)


def overlaps(start: Column, end: Column, lower, upper) -> Column:
    """Does [start, end] intersect the inclusive range [lower, upper]?"""
    return (end >= F.lit(lower)) & (start <= F.lit(upper))


def try_date(text: Column, fmt: str) -> Column:
    """Parse or NULL; never fails the job."""
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
