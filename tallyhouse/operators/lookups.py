"""Dimension lists and the distinct values that fill selection lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import calendar
from tallyhouse.functions.periods import order_day
from tallyhouse.operators.rollups import rollup
from tallyhouse.sources.tables import SalesTables


def _distinct_sorted(df: DataFrame, column: str, value: Column | None = None) -> DataFrame:
    chosen = F.col(column) if value is None else value.alias(column)
    return df.select(chosen).distinct().orderBy(column)


def store_locations(tables: SalesTables) -> DataFrame:
    return tables.stores.select("storeID", "latitude", "longitude", "city", "state")


def customer_locations(tables: SalesTables) -> DataFrame:
    return tables.customers.select("latitude", "longitude")


def overview(tables: SalesTables) -> DataFrame:
    """The product list."""
    return tables.products.select("Name", "Price", "Category", "Size", "Ingredients", "production_costs")


def only_years(tables: SalesTables) -> DataFrame:
    """Years with orders, as text."""
    years = rollup(tables, "order_activity", ["year"])
    return years.select(F.col("year").cast("string").alias("period")).orderBy("period")


def order_month(tables: SalesTables) -> DataFrame:
    """The month of every (store, month) with sales; a month appears once per store."""
    stored = tables.rollups.get("monthly_store_revenue")
    if stored is not None:
        return stored.select("orderMonth")
    months = tables.sold_orders().select("storeID", F.trunc(order_day(), "month").alias("month")).distinct()
    return months.select(calendar.year_month_label(F.col("month")).alias("orderMonth"))


def only_stores(tables: SalesTables) -> DataFrame:
    """Stores with sales."""
    return tables.rollups.get("PizzaSalesSummary", tables.sold_orders()).select("storeID").distinct()


def sales_trend_by_size_only_date(tables: SalesTables) -> DataFrame:
    """Days with sales."""
    stored = tables.rollups.get("daily_store_pizza_sales_with_size")
    if stored is not None:
        return _distinct_sorted(stored, "orderDate")
    return _distinct_sorted(tables.sold_orders(), "orderDate", order_day())


def popular_pizza_by_week_only_weeks(tables: SalesTables) -> DataFrame:
    """Weeks with sales, each once."""
    stored = tables.rollups.get("weekly_store_pizza_sales")
    if stored is not None:
        return stored.select("yearWeek").distinct()
    weeks = tables.sold_orders().select(calendar.year_week_number(order_day()).alias("week")).distinct()
    return weeks.select(calendar.year_week_label(F.col("week")).alias("yearWeek"))


def get_stores(tables: SalesTables) -> DataFrame:
    return _distinct_sorted(tables.stores, "storeID")


def get_years(tables: SalesTables) -> DataFrame:
    return rollup(tables, "weekly_order_counts", ["year"]).select("year").orderBy("year")


def get_months(tables: SalesTables) -> DataFrame:
    return rollup(tables, "weekly_order_counts", ["month"]).select("month").orderBy("month")
