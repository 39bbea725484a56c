"""Quantities, revenue and profit per store."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.filters import given
from tallyhouse.operators.rollups import rollup
from tallyhouse.sources.tables import SalesTables


def total_items_sold_per_store(tables: SalesTables) -> DataFrame:
    return rollup(tables, "store_pizza_sales", ["storeID"]).withColumnRenamed("Quantity", "totalItemsSold")


def store_sales_per_month(tables: SalesTables, orderMonth: str) -> DataFrame:
    """Items sold per store in one ``'YYYY-MM'`` month."""
    sums = rollup(tables, "store_pizza_sales", ["storeID"], {"orderMonth": orderMonth})
    return sums.withColumnRenamed("Quantity", "totalItemsSold").orderBy("storeID")


def store_revenue_and_profit_per_month(tables: SalesTables, orderMonth: str) -> DataFrame:
    month = rollup(tables, "monthly_store_revenue", equals={"orderMonth": orderMonth})
    return month.select("storeID", "totalRevenue", "totalProfit")


def total_revenue(tables: SalesTables) -> DataFrame:
    """Revenue per store from the items sold, highest first."""
    sums = rollup(tables, "monthly_store_revenue", ["storeID"])
    return sums.select("storeID", F.col("totalRevenue").alias("total_revenue")).orderBy(
        F.desc("total_revenue"), "storeID"
    )


def total_revenue_per_store(tables: SalesTables) -> DataFrame:
    """Revenue per store from the order totals, highest first.

    Totals are added up per store before the join, so a store holding much of the orders joins as one row.
    """
    per_store = tables.orders().groupBy("storeID").agg(F.sum("total").alias("totalRevenue"))
    return (
        tables.join_stores(per_store, tables.stores.select("storeID"))
        .select("storeID", "totalRevenue")
        .orderBy(F.desc("totalRevenue"), "storeID")
    )


def store_performance(
    tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None, week: Any = None
) -> DataFrame:
    """Sales per month, labelled ``YYYY-MM``."""
    equals = given(storeID=storeID, year=year, month=month, week=week)
    sums = rollup(tables, "store_performance", ["year", "month"], equals)
    return sums.select(F.format_string("%d-%02d", "year", "month").alias("date"), "total_sales").orderBy("date")


def sales_trends(tables: SalesTables, storeID: Any = None) -> DataFrame:
    trends = rollup(tables, "sales_trends", equals=given(storeID=storeID))
    return trends.orderBy("year", "month", "storeID")


def store_profitability(
    tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None, week: Any = None
) -> DataFrame:
    equals = given(storeID=storeID, year=year, month=month, week=week)
    return rollup(tables, "store_profitability", equals=equals).orderBy("storeID", "year", "month", "week")


def store_sales_comparison(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "daily_store_pizza_sales", ["ProductName", "storeID"])
    return sums.withColumnRenamed("Quantity", "TotalQuantity").orderBy("ProductName", "storeID")


def store_sales_comparison_weekly(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "weekly_store_pizza_sales")
    return sums.withColumnRenamed("Quantity", "TotalQuantity").orderBy("yearWeek", "PizzaName", "storeID")
