"""Grouping keys: what is grouped on, how it is shown, and how an argument for it is read.

A key groups on a compact value (a date, an integer) and is turned into its text form only after the aggregation, so
shuffles carry 4-byte keys and the formatting runs once per group instead of once per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions import calendar, spans
from tallyhouse.functions.spans import DateSpan


def _unchanged(value: Any) -> Any:
    return value


@dataclass(frozen=True)
class Key:
    """``table`` is the base table of the column: ``orders``, ``items`` or ``products``.

    ``parse`` reads an argument as a compact value, ``stored`` as the value that a stored rollup carries.
    """

    table: str
    compact: Callable[[], Column]
    label: Callable[[Column], Column] = _unchanged
    parse: Callable[[Any], Any] = _unchanged
    span: Callable[[Any], DateSpan] | None = None
    stored: Callable[[Any], Any] = _unchanged


def order_column(name: str) -> Key:
    return Key("orders", lambda: F.col(name))


def item_column(name: str) -> Key:
    return Key("items", lambda: F.col(name))


def product_column(name: str) -> Key:
    return Key("products", lambda: F.col(name))


def order_day() -> Column:
    return F.to_date("orderDate")


DAY = Key("orders", order_day, parse=spans.as_date, span=spans.day_span, stored=spans.as_date)
WEEK = Key(
    "orders",
    lambda: calendar.year_week_number(order_day()),
    calendar.year_week_label,
    parse=lambda year_week: int(spans.week_text(year_week).replace("-", "")),
    span=spans.week_span,
    stored=spans.week_text,
)
MONTH = Key(
    "orders",
    lambda: F.trunc(order_day(), "month"),
    calendar.year_month_label,
    parse=spans.month_start,
    span=spans.month_span,
    stored=spans.month_text,
)
YEAR = Key("orders", lambda: F.year("orderDate"), parse=int, span=spans.year_span)
MONTH_OF_YEAR = Key("orders", lambda: F.month("orderDate"), parse=int)
WEEK_OF_MONTH = Key("orders", lambda: calendar.week_of_month(order_day()), parse=int)
DAY_OF_MONTH = Key("orders", lambda: F.dayofmonth("orderDate"), parse=int)
HOUR = Key("orders", lambda: F.hour("orderDate"), parse=int)
WEEKDAY = Key(
    "orders",
    lambda: F.dayofweek("orderDate"),
    calendar.weekday_label,
    parse=lambda name: {day: i for i, day in enumerate(calendar.WEEKDAYS_SUNDAY_FIRST, 1)}.get(name, 0),  # 0: no day
)
WEEKDAY_NUMBER = Key("orders", lambda: F.dayofweek("orderDate"), parse=int)
