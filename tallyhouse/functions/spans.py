"""Half-open ranges of calendar days.

A period argument (a year, ``'1998-03'``, a week, a day) becomes such a range so that the filter is a plain
comparison on the date column, which Parquet statistics and partitions can prune.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DateSpan:
    """Days ``start <= d < end``."""

    start: date
    end: date

    def contains(self, moment: Column) -> Column:
        """Predicate on a ``timestamp_ntz`` column."""
        lower = F.lit(self.start).cast("timestamp_ntz")
        upper = F.lit(self.end).cast("timestamp_ntz")
        return (moment >= lower) & (moment < upper)

    def contains_day(self, day: Column) -> Column:
        """Predicate on a ``date`` column."""
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))

    def touches_year(self, year: Column) -> Column:
        """Predicate on a year column that holds for every day inside; lets whole year partitions be skipped."""
        return year.between(self.start.year, (self.end - timedelta(days=1)).year)

    def both(self, other: DateSpan | None) -> DateSpan:
        """The days in both ranges."""
        if other is None:
            return self
        start = max(self.start, other.start)
        return DateSpan(start, max(start, min(self.end, other.end)))

    def widened(self, days: int) -> DateSpan:
        return DateSpan(self.start - timedelta(days=days), self.end + timedelta(days=days))


def as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def day_span(value: date | str) -> DateSpan:
    day = as_date(value)
    return DateSpan(day, day + timedelta(days=1))


def year_span(year: int | str) -> DateSpan:
    return DateSpan(date(int(year), 1, 1), date(int(year) + 1, 1, 1))


def month_start(year_month: str) -> date:
    year, month = year_month.split("-")
    return date(int(year), int(month), 1)


def month_text(year_month: str) -> str:
    """``'1998-3'`` and ``'1998-03'`` as ``'1998-03'``."""
    return month_start(year_month).strftime("%Y-%m")


def week_text(year_week: str) -> str:
    """``'1998-1'`` and ``'1998-01'`` as ``'1998-01'``."""
    year, week = (int(part) for part in year_week.split("-"))
    return f"{year}-{week:02d}"


def month_span(year_month: str) -> DateSpan:
    start = month_start(year_month)
    end = date(start.year + start.month // 12, start.month % 12 + 1, 1)
    return DateSpan(start, end)


def week_span(year_week: str) -> DateSpan:
    """Days of a ``'YYYY-uu'`` week (Monday first; days before the first long week are week 00)."""
    year, week = (int(part) for part in year_week.split("-"))
    new_year = date(year, 1, 1)
    monday_of_new_year = new_year - timedelta(days=new_year.weekday())
    first_week = 1 if new_year.weekday() <= 3 else 0
    monday = monday_of_new_year + timedelta(days=7 * (week - first_week))
    whole_year = year_span(year)
    return DateSpan(max(monday, whole_year.start), min(monday + timedelta(days=7), whole_year.end))


def sunday_week_span(year: int | str, week: int | str) -> DateSpan:
    """Days of a Sunday-first week of a year (days before the first Sunday are week 0)."""
    new_year = date(int(year), 1, 1)
    first_sunday = new_year + timedelta(days=(6 - new_year.weekday()) % 7)
    sunday = first_sunday + timedelta(days=7 * (int(week) - 1))
    whole_year = year_span(year)
    start = max(sunday, whole_year.start)
    return DateSpan(start, max(start, min(sunday + timedelta(days=7), whole_year.end)))


def week_of_month_span(year: int | str, month: int | str, week: int | str) -> DateSpan:
    """Days of week 1 (days 1-7), 2 (8-14) ... 5 of a month."""
    whole_month = month_span(f"{int(year)}-{int(month)}")
    start = whole_month.start + timedelta(days=7 * (int(week) - 1))
    return DateSpan(start, max(start, min(start + timedelta(days=7), whole_month.end)))


def calendar_span(year: int | str | None, month: int | str | None) -> DateSpan | None:
    """Range for an optional year and an optional month within it; a month alone is no single range."""
    if year is None:
        return None
    return year_span(year) if month is None else month_span(f"{int(year)}-{int(month)}")
