"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL_DATA

from tallyhouse.plans import catalog


def plan(spark, name: str) -> str:
    return catalog.queries()[name](spark, SMALL_DATA)._jdf.queryExecution().executedPlan().toString()


def scans(text: str, table: str) -> list[str]:
    return re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", text)


def columns(scan: str) -> set[str]:
    return {name.split("#")[0] for name in scan.split(",") if name}


@pytest.mark.parametrize("name", list(catalog.REPORTS))
def test_no_python_and_no_cross_join(spark, no_broadcast, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "BroadcastExchange"):
        assert operator not in text


def test_only_used_columns_are_read(spark):
    text = plan(spark, "category_order_share")
    assert {frozenset(columns(scan)) for scan in scans(text, "lineitem")} == {frozenset(), frozenset({"l_partkey"})}
    assert columns(scans(plan(spark, "total_revenue_per_store"), "orders")[0]) == {
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
    }


@pytest.mark.parametrize(
    "name, lower, upper",
    [
        ("store_sales_per_month", "1998-03-01", "1998-04-01"),
        ("store_performance_year", "1998-01-01", "1999-01-01"),
        ("category_sales_month", "1998-03-01", "1998-04-01"),
        ("daily_order_stats_day", "1998-03-05", "1998-03-06"),
        ("popular_pizza_by_week", "1998-03-02", "1998-03-09"),
        ("daily_order_trends_year", "1998-01-01", "1999-01-01"),
        ("order_activity_per_hour_week", "1998-03-08", "1998-03-15"),
        ("store_performance_week", "1998-03-08", "1998-03-15"),
        ("customer_loyalty", "1997-12-31", "1999-01-02"),
    ],
)
def test_dates_are_pushed_to_the_scan(spark, name, lower, upper):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual(o_orderdate,{lower}T00:00)" in text
    assert f"LessThan(o_orderdate,{upper}T00:00)" in text


@pytest.mark.parametrize(
    "name", ["daily_order_intensity_heatmap", "weekly_average_order_value_per_store", "monthly_store_performance_benchmark"]
)
def test_items_are_not_read_for_order_counts(spark, name):
    assert scans(plan(spark, name), "lineitem") == []


def test_facts_are_read_once(spark):
    for name in ("store_profitability", "daily_order_stats", "top_categories_per_store", "category_product_matrix"):
        assert len(scans(plan(spark, name), "lineitem")) == 1, name


def test_top_k_does_not_sort_everything(spark):
    for name in ("product_preferences", "top_customers", "top_customers_filtered"):
        text = plan(spark, name)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_rankings_are_cut_before_their_shuffle(spark):
    for name in ("top_categories_per_store", "rollup_TopOrderDates_top"):
        assert "WindowGroupLimit" in plan(spark, name) and "Partial" in plan(spark, name)


def test_products_too_many_to_broadcast_are_summed_first(spark, no_broadcast):
    text = plan(spark, "total_quantity_per_product")
    lines = text.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    below = "\n".join(lines[join:])
    assert re.search(r"HashAggregate\(keys=\[SKU#\d+L\], functions=\[partial_count", below)


def test_large_store_table_is_joined_salted(spark, no_broadcast):
    assert re.search(r"SortMergeJoin \[storeID#\d+L, _salt#\d+\]", plan(spark, "extended_orders"))


@pytest.mark.parametrize("name", ["store_performance_year", "popular_pizza_by_week", "daily_order_stats_day"])
def test_items_of_other_dates_can_be_dropped_before_the_shuffle(spark, no_broadcast, name):
    settings = {
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert "might_contain" in plan(spark, name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# Shuffles with nothing broadcast: items and orders for their join, the aggregation, the sorting of the result. Reports
# by product name also sum per product and group, bring those sums and the products together, and sum again; the sums
# move twice on purpose, since partitioned by product alone a best-seller would be one task.
@pytest.mark.parametrize(
    "name, shuffles",
    [
        ("order_activity_per_month", 2),
        ("unique_customers_per_store_table", 2),
        ("total_quantity_per_product", 4),
        ("total_items_sold_per_store", 3),
        ("store_sales_comparison", 7),
        ("daily_order_stats", 4),
        ("daily_store_performance_benchmark", 3),
        ("customers_with_orders", 2),
    ],
)
def test_number_of_shuffles(spark, no_broadcast, name, shuffles):
    text = plan(spark, name)
    assert len(re.findall(r"Exchange (?:hash|range)partitioning", text)) == shuffles


@pytest.mark.parametrize("name", ["total_revenue", "store_profitability", "total_items_sold_per_store", "sales_trends"])
def test_items_are_summed_per_order_before_they_meet_orders(spark, name):
    """Products are small enough to broadcast, orders are not: the items' side of the join is an aggregate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        lines = plan(spark, name).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin [orderID" in line)
    assert re.search(r"HashAggregate\(keys=\[orderID#\d+L\]", "\n".join(lines[join:]))


def test_hourly_averages_read_orders_once(spark):
    for name in ("avg_orders_per_hour", "avg_orders_per_hour_utc"):
        assert len(scans(plan(spark, name), "orders")) == 1, name
