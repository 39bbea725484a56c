"""When orders come in: weekdays, months, hours, seasons and holidays."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import calendar
from tallyhouse.functions.filters import given
from tallyhouse.functions.spans import sunday_week_span
from tallyhouse.operators import rollups
from tallyhouse.operators.rollups import rollup
from tallyhouse.sources.tables import SalesTables


def store_orders_by_weekday(tables: SalesTables, weekday: str | None = None) -> DataFrame:
    sums = rollup(tables, "OrdersPerWeekday", equals=given(Weekday=weekday))
    return sums.withColumnRenamed("NumberOfOrders", "totalOrders").orderBy("Weekday", "storeID")


def order_activity_over_time(tables: SalesTables, interval: str = "week") -> DataFrame:
    """Orders per store and ``day``, ``month`` or ``year``.

    Every other interval, ``week`` included, gives years.
    """
    grain = {"day": "period", "month": "month"}.get(interval, "year")
    sums = rollup(tables, "order_activity", ["storeID", grain])
    period = F.col(grain).cast("string") if grain == "year" else F.col(grain)
    return sums.select("storeID", period.alias("period"), "order_count").orderBy("storeID", "period")


def weekly_orders(tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None) -> DataFrame:
    """Orders per store, weekday, year and month; weekdays in calendar order."""
    sums = rollup(tables, "weekly_order_counts", equals=given(storeID=storeID, year=year, month=month))
    return sums.orderBy("storeID", calendar.weekday_position(F.col("weekday")), "year", "month")


def order_activity_per_month(tables: SalesTables, storeID: Any = None, year: Any = None) -> DataFrame:
    sums = rollup(tables, "order_activity_per_month", equals=given(storeID=storeID, year=year))
    return sums.orderBy("storeID", "year", "month")


def order_activity_per_hour(
    tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None, week: Any = None
) -> DataFrame:
    """Orders per hour of the day; ``week`` is the Sunday-first week of the year (0-53)."""
    equals = given(storeID=storeID, year=year, month=month)
    wanted = given(week=week)
    if not wanted:
        return rollup(tables, "order_activity_per_hour", ["hour"], equals).orderBy("hour")
    span = sunday_week_span(year, wanted["week"]) if "year" in equals else None
    per_day = rollup(tables, "order_activity_per_hour", ["year", "month", "day", "hour"], equals, span)
    day = calendar.date_from_parts(F.col("year"), F.col("month"), F.col("day"))
    return (
        per_day.filter(calendar.week_sunday_first(day) == int(wanted["week"]))
        .groupBy("hour")
        .agg(F.sum("order_count").alias("order_count"))
        .orderBy("hour")
    )


def avg_orders_per_hour(tables: SalesTables) -> DataFrame:
    return rollups.avg_orders_per_hour(tables).orderBy("storeID", "Hour")


def avg_orders_per_hour_utc(tables: SalesTables) -> DataFrame:
    return rollups.avg_orders_per_hour_utc(tables).orderBy("storeID", "Hour")


def order_trends(tables: SalesTables) -> DataFrame:
    """Orders per ``YYYY-MM`` month."""
    months = tables.orders().groupBy(F.trunc(F.to_date("orderDate"), "month").alias("_month"))
    counts = months.agg(F.count("orderID").alias("orderCount"))
    return counts.select(calendar.year_month_label(F.col("_month")).alias("month"), "orderCount").orderBy("month")


def _most_orders_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("TotalOrders"), "OrderDate", "storeID")


def seasonal_order_analysis(tables: SalesTables, top_n: int | None = None) -> DataFrame:
    day = F.col("OrderDate")
    return _most_orders_first(
        rollups.top_order_dates(tables, top_n).select(
            "OrderDate",
            "storeID",
            "TotalOrders",
            F.month(day).alias("Month"),
            F.dayofmonth(day).alias("Day"),
            calendar.season(day).alias("Season"),
        )
    )


def seasonal_order_details(tables: SalesTables, season: str, top_n: int | None = None) -> DataFrame:
    if not season:
        raise ValueError("a season is required")
    in_season = rollups.top_order_dates(tables, top_n).filter(calendar.season(F.col("OrderDate")) == F.lit(season))
    return _most_orders_first(in_season.select("OrderDate", "storeID", "TotalOrders"))


def holiday_order_analysis(tables: SalesTables, top_n: int | None = None) -> DataFrame:
    return (
        rollups.top_order_dates(tables, top_n)
        .filter(F.col("HolidayName").isNotNull())
        .select("OrderDate", "storeID", "TotalOrders", "HolidayName")
        .orderBy("HolidayName", "OrderDate", "storeID")
    )
