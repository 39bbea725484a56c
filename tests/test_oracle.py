"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from conftest import SMALL_DATA

import __spark_entry__ as registered
from tallyhouse.plans import catalog, oracle
from tools.compare import differences, duckdb_tables

# A filter on one store and half a month may find nothing in 6,000 items.
MAY_BE_EMPTY = {
    "daily_order_stats_day",
    "store_performance_week",
    "popular_pizza_by_week",
    "store_profitability_store_month",
    "weekly_orders_store_month",
    "order_activity_per_hour_store_month",
    "category_sales_store_month",
    "product_preferences_store_month",
    "holiday_order_analysis_top",
}

# SQL names the columns of a matrix by product; the smallest data lack two of the products.
ALL_PRODUCTS = "/root/testdata/sf0.01"
NEEDS_ALL_PRODUCTS = {"category_product_matrix"}


@pytest.fixture(scope="module")
def connections():
    return {directory: duckdb_tables(directory) for directory in (SMALL_DATA, ALL_PRODUCTS)}


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, connections, name):
    directory = ALL_PRODUCTS if name in NEEDS_ALL_PRODUCTS else SMALL_DATA
    found = differences(name, spark, connections[directory], directory)
    if name in MAY_BE_EMPTY and found == ["no rows"]:
        return
    assert found == []


def test_entry(spark):
    assert registered.entry(spark).columns == ["storeID", "totalRevenue"]
    assert registered.entry(spark).count() > 0
