"""Every query by name, with the arguments it is registered under.

A key without a suffix runs with the operator's own defaults, that is over all stores and all time, unless an argument
is required.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.functions.numbers import decimals_as_double
from tallyhouse.operators import (
    activity,
    customers,
    heat,
    lookups,
    order_stats,
    products,
    rollups,
    shaping,
    store_sales,
)
from tallyhouse.operators.customers import Box
from tallyhouse.sources.tables import SalesTables
from tallyhouse.sources.tpch import tpch_tables

Query = Callable[[SparkSession, str], DataFrame]
Report = Callable[[SalesTables], DataFrame]

# The arguments of the registered keys.
STORE = 3
YEAR = 1998
MONTH = 3
WEEK_OF_MONTH = 2
WEEK_OF_YEAR = 10
YEAR_MONTH = "1998-03"
YEAR_WEEK = "1998-10"
DAY = "1998-03-05"
WEEKDAY = "Monday"
SEASON = "Winter"
CATEGORY = "PROMO"
TOP_DATES = 10
BOX = Box(sw_lat=30.0, sw_lng=-120.0, ne_lat=45.0, ne_lng=-80.0)
#: Five stores.
SMALL_BOX = Box(sw_lat=25.0, sw_lng=-125.0, ne_lat=27.9, ne_lng=-119.0)
ZOOMED = heat.Viewport(zoom=6, width=1200, height=800, origin_x=3000, origin_y=5800)
FINE_MONTHS, FINE_LIMITS = 1.0, (6, 4, 2)


def _with(operator: Callable[..., DataFrame], *args: Any, **arguments: Any) -> Report:
    return lambda tables: operator(tables, *args, **arguments)


LOOKUPS: dict[str, Report] = {
    "store_locations": lookups.store_locations,
    "customer_locations": lookups.customer_locations,
    "overview": lookups.overview,
    "only_years": lookups.only_years,
    "order_month": lookups.order_month,
    "only_stores": lookups.only_stores,
    "sales_trend_by_size_only_date": lookups.sales_trend_by_size_only_date,
    "popular_pizza_by_week_only_weeks": lookups.popular_pizza_by_week_only_weeks,
    "get_stores": lookups.get_stores,
    "get_years": lookups.get_years,
    "get_months": lookups.get_months,
}

STORE_SALES: dict[str, Report] = {
    "total_items_sold_per_store": store_sales.total_items_sold_per_store,
    "store_sales_per_month": _with(store_sales.store_sales_per_month, YEAR_MONTH),
    "store_revenue_and_profit_per_month": _with(store_sales.store_revenue_and_profit_per_month, YEAR_MONTH),
    "total_revenue": store_sales.total_revenue,
    "total_revenue_per_store": store_sales.total_revenue_per_store,
    "store_performance": store_sales.store_performance,
    "store_performance_year": _with(store_sales.store_performance, year=YEAR),
    "store_performance_week": _with(
        store_sales.store_performance, storeID=STORE, year=YEAR, month=MONTH, week=WEEK_OF_MONTH
    ),
    "sales_trends": store_sales.sales_trends,
    "sales_trends_store": _with(store_sales.sales_trends, storeID=STORE),
    "store_profitability": store_sales.store_profitability,
    "store_profitability_year": _with(store_sales.store_profitability, year=YEAR),
    "store_profitability_store_month": _with(store_sales.store_profitability, storeID=STORE, year=YEAR, month=MONTH),
    "store_sales_comparison": store_sales.store_sales_comparison,
    "store_sales_comparison_weekly": store_sales.store_sales_comparison_weekly,
}

ORDER_STATS: dict[str, Report] = {
    "daily_order_stats": _with(order_stats.stats, "daily"),
    "daily_order_stats_day": _with(order_stats.stats, "daily", DAY),
    "daily_average_order_value_per_store": _with(order_stats.average_order_value_per_store, "daily"),
    "daily_order_intensity_heatmap": _with(order_stats.order_intensity, "daily"),
    "daily_order_trends": _with(order_stats.order_trends, "daily"),
    "daily_order_trends_year": _with(order_stats.order_trends, "daily", YEAR),
    "daily_store_performance_benchmark": _with(order_stats.store_performance_benchmark, "daily"),
    "weekly_order_stats": _with(order_stats.stats, "weekly"),
    "weekly_order_stats_week": _with(order_stats.stats, "weekly", YEAR_WEEK),
    "weekly_average_order_value_per_store": _with(order_stats.average_order_value_per_store, "weekly"),
    "weekly_order_intensity": _with(order_stats.order_intensity, "weekly"),
    "weekly_order_trends": _with(order_stats.order_trends, "weekly"),
    "weekly_store_performance_benchmark": _with(order_stats.store_performance_benchmark, "weekly"),
    "monthly_order_stats": _with(order_stats.stats, "monthly"),
    "monthly_order_stats_month": _with(order_stats.stats, "monthly", YEAR_MONTH),
    "monthly_average_order_value_per_store": _with(order_stats.average_order_value_per_store, "monthly"),
    "monthly_order_intensity": _with(order_stats.order_intensity, "monthly"),
    "monthly_store_performance_benchmark": _with(order_stats.store_performance_benchmark, "monthly"),
    "monthly_order_trends": _with(order_stats.order_trends, "monthly"),
}

ACTIVITY: dict[str, Report] = {
    "store_orders_by_weekday": activity.store_orders_by_weekday,
    "store_orders_by_weekday_monday": _with(activity.store_orders_by_weekday, WEEKDAY),
    "order_activity_over_time": activity.order_activity_over_time,
    "order_activity_over_time_day": _with(activity.order_activity_over_time, "day"),
    "order_activity_over_time_month": _with(activity.order_activity_over_time, "month"),
    "weekly_orders": activity.weekly_orders,
    "weekly_orders_year": _with(activity.weekly_orders, year=YEAR),
    "weekly_orders_store_month": _with(activity.weekly_orders, storeID=STORE, year=YEAR, month=MONTH),
    "order_activity_per_month": activity.order_activity_per_month,
    "order_activity_per_month_store": _with(activity.order_activity_per_month, storeID=STORE, year=YEAR),
    "order_activity_per_hour": activity.order_activity_per_hour,
    "order_activity_per_hour_month": _with(activity.order_activity_per_hour, year=YEAR, month=MONTH),
    "order_activity_per_hour_week": _with(activity.order_activity_per_hour, year=YEAR, week=WEEK_OF_YEAR),
    "order_activity_per_hour_store_month": _with(activity.order_activity_per_hour, storeID=STORE, year=YEAR, month=MONTH),
    "avg_orders_per_hour": activity.avg_orders_per_hour,
    "avg_orders_per_hour_utc": activity.avg_orders_per_hour_utc,
    "order_trends": activity.order_trends,
    "seasonal_order_analysis": activity.seasonal_order_analysis,
    "seasonal_order_analysis_top": _with(activity.seasonal_order_analysis, TOP_DATES),
    "seasonal_order_details": _with(activity.seasonal_order_details, SEASON),
    "seasonal_order_details_top": _with(activity.seasonal_order_details, SEASON, TOP_DATES),
    "holiday_order_analysis": activity.holiday_order_analysis,
    "holiday_order_analysis_top": _with(activity.holiday_order_analysis, TOP_DATES),
}

PRODUCTS: dict[str, Report] = {
    "category_sales_comparison": products.category_sales_comparison,
    "top_categories_per_store": products.top_categories_per_store,
    "most_popular_products": products.most_popular_products,
    "popular_products_by_store": _with(products.popular_products_by_store, STORE),
    "category_order_share": products.category_order_share,
    "product_order_share": _with(products.product_order_share, CATEGORY),
    "total_sales_per_category": products.total_sales_per_category,
    "weekly_sales_distribution": products.weekly_sales_distribution,
    "sales_trend_by_size": products.sales_trend_by_size,
    "size_popularity": products.size_popularity,
    "popular_pizza_by_week": _with(products.popular_pizza_by_week, YEAR_WEEK),
    "total_profit_per_pizza": products.total_profit_per_pizza,
    "cost_structure_per_pizza": products.cost_structure_per_pizza,
    "margin_analysis": products.margin_analysis,
    "size_cost_efficiency": products.size_cost_efficiency,
    "sales_data": products.sales_data,
    "category_sales": products.category_sales,
    "category_sales_month": _with(products.category_sales, year=YEAR, month=MONTH),
    "category_sales_store_month": _with(products.category_sales, storeID=STORE, year=YEAR, month=MONTH),
    "product_preferences": products.product_preferences,
    "product_preferences_month": _with(products.product_preferences, year=YEAR, month=MONTH),
    "product_preferences_store_month": _with(products.product_preferences, storeID=STORE, year=YEAR, month=MONTH),
    "total_quantity_per_product": products.total_quantity_per_product,
}

CUSTOMERS: dict[str, Report] = {
    "unique_customers_per_store_table": customers.unique_customers_per_store_table,
    "top_customers": _with(customers.top_customers, STORE),
    "customers_with_orders": customers.customers_with_orders,
    "average_order_value": _with(customers.average_order_value, BOX, YEAR),
    "average_order_value_all_years": _with(customers.average_order_value, BOX),
    "top_customers_filtered": _with(customers.top_customers_filtered, BOX, YEAR),
    "top_customers_filtered_all_years": _with(customers.top_customers_filtered, BOX),
    "customer_loyalty": _with(customers.customer_loyalty, BOX, YEAR),
    "customer_loyalty_all_years": _with(customers.customer_loyalty, BOX),
    "customer_loyalty_fine": _with(
        customers.customer_loyalty, BOX, months=FINE_MONTHS, limits=FINE_LIMITS
    ),
    "customers_per_state": customers.customers_per_state,
    "stores_per_state": customers.stores_per_state,
}


def _heat_cells(tables: SalesTables, **arguments: Any) -> DataFrame:
    return heat.heat_grid(customers.customers_with_orders(tables), "order_count", **arguments)


SHAPING: dict[str, Report] = {
    "sales_by_month": lambda tables: shaping.sales_by_month(store_sales.sales_trends(tables)),
    "profit_by_month": lambda tables: shaping.sales_by_month(store_sales.store_profitability(tables)),
    "profit_split_by_month": lambda tables: shaping.profit_split_by_month(store_sales.store_profitability(tables)),
    "category_product_matrix": lambda tables: shaping.category_product_matrix(
        products.category_sales(tables), shaping.names_of(tables.products, "Name")
    ),
    "store_category_matrix": lambda tables: shaping.store_category_matrix(
        products.category_sales_comparison(tables), shaping.names_of(tables.products, "Category")
    ),
    "holiday_orders_per_store": lambda tables: shaping.holiday_orders_per_store(
        activity.holiday_order_analysis(tables)
    ),
    "seasonal_totals": lambda tables: shaping.seasonal_totals(activity.seasonal_order_analysis(tables)),
    "share_of_total": lambda tables: shaping.share_of_total(
        products.category_sales_comparison(tables), "NumberOfPizzasSold", "Category"
    ),
    "share_of_total_single_series": lambda tables: shaping.share_of_total(
        products.total_sales_per_category(tables), "TotalPizzasSold"
    ),
    "loyalty_profile": lambda tables: shaping.loyalty_profile(
        customers.customer_loyalty(tables, BOX, months=FINE_MONTHS, limits=FINE_LIMITS)
    ),
    "loyalty_profile_few_stores": lambda tables: shaping.loyalty_profile(
        customers.customer_loyalty(tables, SMALL_BOX, months=FINE_MONTHS, limits=FINE_LIMITS)
    ),
    "heat_grid": _heat_cells,
    "heat_grid_zoomed": _with(_heat_cells, view=ZOOMED),
    "heat_intensity": lambda tables: heat.heat_intensity(_heat_cells(tables)),
    "geo_bounds": lambda tables: heat.geo_bounds(tables.customers),
    "geo_bounds_stores": lambda tables: heat.geo_bounds(tables.stores),
}

ROLLUPS: dict[str, Report] = {
    "extended_orders": lambda tables: tables.extended_orders(),
    **{f"rollup_{name}": build for name, build in rollups.ROLLUPS.items()},
    "rollup_TopOrderDates_top": _with(rollups.top_order_dates, TOP_DATES),
}

REPORTS: dict[str, Report] = {
    **LOOKUPS,
    **STORE_SALES,
    **ORDER_STATS,
    **ACTIVITY,
    **PRODUCTS,
    **CUSTOMERS,
    **SHAPING,
    **ROLLUPS,
}


@lru_cache(maxsize=8)
def _opened(spark: SparkSession, directory: str) -> SalesTables:
    """Tables are opened once per session and directory."""
    return tpch_tables(spark, directory)


def _query(report: Report) -> Query:
    return lambda spark, directory: decimals_as_double(report(_opened(spark, directory)))


def queries() -> dict[str, Query]:
    return {name: _query(report) for name, report in REPORTS.items()}
