"""Products, categories and sizes: popularity, shares, costs and margins."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.filters import given
from tallyhouse.functions.numbers import percentage
from tallyhouse.operators.rollups import pizza_profit_analysis, rollup
from tallyhouse.sources.tables import SalesTables


def category_sales_comparison(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "PizzaSalesSummary").select("Category", "storeID", "NumberOfPizzasSold")
    return sums.orderBy("Category", "storeID")


def top_categories_per_store(tables: SalesTables) -> DataFrame:
    """The best-selling category of every store; all of them where several tie."""
    best_first = Window.partitionBy("storeID").orderBy(F.desc("NumberOfPizzasSold"))
    return (
        rollup(tables, "PizzaSalesSummary")
        .filter(F.col("storeID").isNotNull() & F.col("NumberOfPizzasSold").isNotNull())
        .withColumn("_place", F.rank().over(best_first))
        .filter(F.col("_place") == 1)
        .select("storeID", "Category", "NumberOfPizzasSold")
        .orderBy("storeID", "Category")
    )


def most_popular_products(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "product_order_frequency")
    return sums.orderBy(F.desc("Frequency"), "ProductName", "Category")


def popular_products_by_store(tables: SalesTables, storeID: Any) -> DataFrame:
    return rollup(tables, "total_items_sold", equals={"storeID": storeID})


def _all_frequencies(tables: SalesTables) -> Column:
    """Number of order items as a one-value subquery."""
    return rollup(tables, "product_order_frequency", []).scalar()


def category_order_share(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "product_order_frequency", ["Category"]).withColumnRenamed("Frequency", "TotalFrequency")
    share = percentage(F.col("TotalFrequency"), _all_frequencies(tables))
    return sums.withColumn("Percentage", share).orderBy(F.desc("TotalFrequency"), "Category")


def product_order_share(tables: SalesTables, category: str) -> DataFrame:
    """Products of one category with their share of the items of all categories."""
    sums = rollup(tables, "product_order_frequency", equals={"Category": category})
    share = percentage(F.col("Frequency"), _all_frequencies(tables))
    return sums.withColumn("Percentage", share).orderBy(F.desc("Percentage"), "ProductName")


def total_sales_per_category(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "PizzaSalesSummary", ["Category"])
    return sums.withColumnRenamed("NumberOfPizzasSold", "TotalPizzasSold").orderBy("Category")


def weekly_sales_distribution(tables: SalesTables) -> DataFrame:
    """Quantity per weekday number (1 = Sunday) and product."""
    sums = rollup(tables, "daily_store_pizza_sales", ["Weekday", "ProductName"])
    sums = sums.withColumnRenamed("Quantity", "TotalQuantity")
    return sums.orderBy("Weekday", "ProductName")


def sales_trend_by_size(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "daily_store_pizza_sales_with_size", ["orderDate", "Size"])
    return sums.withColumnRenamed("Quantity", "TotalQuantity").orderBy("orderDate", "Size")


def size_popularity(tables: SalesTables) -> DataFrame:
    sums = rollup(tables, "daily_store_pizza_sales_with_size", ["Size"])
    return sums.withColumnRenamed("Quantity", "TotalQuantity").orderBy(F.desc("TotalQuantity"), "Size")


def popular_pizza_by_week(tables: SalesTables, yearWeek: str) -> DataFrame:
    sums = rollup(tables, "weekly_store_pizza_sales", ["yearWeek", "PizzaName"], {"yearWeek": yearWeek})
    return sums.withColumnRenamed("Quantity", "TotalQuantity").orderBy(F.desc("TotalQuantity"), "PizzaName")


def total_profit_per_pizza(tables: SalesTables) -> DataFrame:
    return pizza_profit_analysis(tables).orderBy(F.desc("profit"), "SKU")


def _with_ratio(tables: SalesTables, name: str, ratio: Column) -> DataFrame:
    return pizza_profit_analysis(tables).select("SKU", "Name", "Size", "Price", "production_cost", ratio.alias(name))


def cost_structure_per_pizza(tables: SalesTables) -> DataFrame:
    share = F.round(F.try_divide("production_cost", "Price") * 100, 2)
    return _with_ratio(tables, "CostPercentage", share).orderBy("SKU", "Size")


def margin_analysis(tables: SalesTables) -> DataFrame:
    margin = F.round(F.try_divide(F.col("Price") - F.col("production_cost"), F.col("Price")) * 100, 2)
    return _with_ratio(tables, "ProfitMargin", margin).orderBy(F.desc("ProfitMargin"), "SKU")


def size_cost_efficiency(tables: SalesTables) -> DataFrame:
    efficiency = F.round(F.try_divide("profit", "production_cost"), 2)
    return _with_ratio(tables, "CostEfficiency", efficiency).orderBy("SKU", "Size")


def sales_data(tables: SalesTables) -> DataFrame:
    return rollup(tables, "monthly_product_sales").orderBy("product_name", "year", "month")


def category_sales(
    tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None, week: Any = None
) -> DataFrame:
    """Sales per category and product; rows without a category or product drop out, missing sales count as zero."""
    equals = given(storeID=storeID, year=year, month=month, week=week)
    sums = rollup(tables, "category_sales", ["category", "product_name"], equals)
    return (
        sums.dropna(subset=["category", "product_name"])
        .withColumn("total_sales", F.coalesce("total_sales", F.lit(0)))
        .orderBy("category", "product_name")
    )


def product_preferences(
    tables: SalesTables, storeID: Any = None, year: Any = None, month: Any = None, week: Any = None
) -> DataFrame:
    """The eight products ordered most often."""
    equals = given(storeID=storeID, year=year, month=month, week=week)
    sums = rollup(tables, "product_preferences", ["product_name"], equals)
    return sums.orderBy(F.desc("order_count"), "product_name").limit(8)


def total_quantity_per_product(tables: SalesTables) -> DataFrame:
    """Number of order items (not their quantity) per product name."""
    counts = rollup(tables, "product_order_frequency", ["ProductName"])
    return counts.select(F.col("ProductName").alias("productName"), F.col("Frequency").alias("totalQuantity")).orderBy(
        F.desc("totalQuantity"), "productName"
    )
