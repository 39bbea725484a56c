"""Calendar expressions, including the two week numberings Spark has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and groupings that results must carry as they are.
WEEKDAYS_MONDAY_FIRST = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKDAYS_SUNDAY_FIRST = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
SEASON_MONTHS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}
HOLIDAYS = {"New Year's Day": (1, 1), "Independence Day": (7, 4), "Christmas Day": (12, 25)}


def _whole_weeks(day: Column, days_before_new_year: Column) -> Column:
    return F.floor((F.dayofyear(day) - 1 + days_before_new_year) / 7).cast("int")


def week_monday_first(day: Column) -> Column:
    """Week 0-53 of the calendar year, Monday first, week 1 being the first with four or more days.

    Not ``weekofyear``: that one moves early January into the last week of the year before.
    """
    lead = F.weekday(F.trunc(day, "year"))
    return _whole_weeks(day, lead) + F.when(lead <= 3, 1).otherwise(0)


def week_sunday_first(day: Column) -> Column:
    """Week 0-53 of the calendar year, Sunday first, week 1 starting on the first Sunday."""
    lead = F.dayofweek(F.trunc(day, "year")) - 1
    return _whole_weeks(day, lead) + F.when(lead == 0, 1).otherwise(0)


def year_week_number(day: Column) -> Column:
    """Year and Monday-first week as one integer, e.g. 199810; cheaper to shuffle than the text."""
    return F.year(day) * 100 + week_monday_first(day)


def year_week_label(number: Column) -> Column:
    """``199810`` as ``'1998-10'``."""
    return F.format_string("%d-%02d", F.floor(number / 100).cast("int"), F.pmod(number, F.lit(100)).cast("int"))


def year_month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_of_month(day: Column) -> Column:
    """1 for days 1-7, 2 for days 8-14, up to 5."""
    return F.ceil(F.dayofmonth(day) / 7).cast("int")


def weekday_label(day_of_week: Column) -> Column:
    """English name of a ``dayofweek`` number (1 = Sunday)."""
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS_SUNDAY_FIRST]), day_of_week)


def weekday_position(name: Column) -> Column:
    """1 for Monday up to 7 for Sunday, 0 for anything else and for NULL."""
    days = F.array(*[F.lit(day) for day in WEEKDAYS_MONDAY_FIRST])
    return F.coalesce(F.array_position(days, name), F.lit(0))


def season(day: Column) -> Column:
    months = F.month(day)
    expression = None
    for name, numbers in SEASON_MONTHS.items():
        branch = months.isin(numbers)
        expression = F.when(branch, name) if expression is None else expression.when(branch, name)
    return expression.otherwise("Unknown")


def holiday_name(day: Column) -> Column:
    """Name of the fixed-date holiday on this day, else NULL."""
    expression = None
    for name, (month, day_of_month) in HOLIDAYS.items():
        branch = (F.month(day) == month) & (F.dayofmonth(day) == day_of_month)
        expression = F.when(branch, name) if expression is None else expression.when(branch, name)
    return expression


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """The date, or NULL for parts that name no day (30 February)."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")
