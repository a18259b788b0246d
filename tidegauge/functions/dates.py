"""Calendar column expressions: quarter ends, filing deadlines, list dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILING_DAYS = 45


def quarter_end(day: Column) -> Column:
    """The last day of the calendar quarter a date falls in."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def next_quarter_end(period: Column) -> Column:
    return F.last_day(F.add_months(period, 3))


def previous_quarter_end(period: Column) -> Column:
    return F.last_day(F.add_months(period, -3))


def quarter_label(period: Column) -> Column:
    """Q2 2026"""
    return F.concat(F.lit("Q"), F.quarter(period).cast("string"), F.lit(" "), F.year(period).cast("string"))


def _observed(day: Column) -> Column:
    # Saturday holidays are kept on the Friday before, Sunday ones on the Monday after.
    weekday = F.dayofweek(day)
    return F.when(weekday == 7, F.date_sub(day, 1)).when(weekday == 1, F.date_add(day, 1)).otherwise(day)


def _nth(year: Column, month: int, weekday: str, n: int) -> Column:
    before_first = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(before_first, weekday), 7 * (n - 1))


def holidays_of(year: Column) -> Column:
    """The eleven US federal holidays of a year, as kept (array of dates)."""
    fixed = lambda month, day: _observed(F.make_date(year, F.lit(month), F.lit(day)))
    return F.array(
        fixed(1, 1),
        _nth(year, 1, "MON", 3),
        _nth(year, 2, "MON", 3),
        F.next_day(F.make_date(year, F.lit(5), F.lit(24)), "MON"),  # the last Monday of May
        fixed(6, 19),
        fixed(7, 4),
        _nth(year, 9, "MON", 1),
        _nth(year, 10, "MON", 2),
        fixed(11, 11),
        _nth(year, 11, "THU", 4),
        fixed(12, 25),
    )


def filing_deadline(period: Column) -> Column:
    """45 days after a quarter end, moved on past weekends and federal holidays."""
    due = F.date_add(period, FILING_DAYS)
    is_business_day = lambda d: ~F.dayofweek(d).isin(1, 7) & ~F.array_contains(holidays_of(F.year(d)), d)
    return F.array_min(F.filter(F.sequence(due, F.date_add(due, 10)), is_business_day))


def list_date(deadline: Column, lag_days: int = 14) -> Column:
    """The first day a period's list could be read: some days after its deadline's month ends."""
    return F.date_add(F.last_day(deadline), lag_days)


def filed_date(text: Column) -> Column:
    """14-AUG-2024 as a date."""
    return F.to_date(text, "dd-MMM-yyyy")
