from __future__ import annotations

import pytest
from conftest import SMALL_DATA, rows

from tallyhouse.plans import catalog
from tallyhouse.sources import bucketed
from tallyhouse.sources.tpch import tpch_tables


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    spark.sql(f"CREATE DATABASE facts LOCATION '{tmp_path_factory.mktemp('facts')}'")
    yield "facts"
    spark.sql("DROP DATABASE facts CASCADE")


@pytest.fixture(scope="module")
def direct(spark):
    return tpch_tables(spark, SMALL_DATA)


@pytest.fixture(scope="module")
def facts(direct, database):
    return bucketed.write_facts(direct, database, 4)


@pytest.mark.parametrize("name", ["total_items_sold_per_store", "store_profitability_year", "weekly_order_stats"])
def test_same_result_without_a_shuffle_by_order(direct, facts, no_broadcast, name):
    report = catalog.REPORTS[name](facts)
    assert "hashpartitioning(orderID" not in report._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(report)) == sorted(rows(catalog.REPORTS[name](direct)))


def test_an_order_larger_than_a_bucket_is_stored_without_buckets(spark, direct):
    spark.sql("CREATE DATABASE crowded")
    try:
        with pytest.warns(UserWarning, match="without buckets"):
            stored = bucketed.write_facts(direct, "crowded", 1200)
        assert sorted(rows(catalog.REPORTS["total_items_sold_per_store"](stored))) == sorted(
            rows(catalog.REPORTS["total_items_sold_per_store"](direct))
        )
    finally:
        spark.sql("DROP DATABASE crowded CASCADE")


@pytest.fixture(scope="module")
def monthly(spark, direct, tmp_path_factory):
    spark.sql(f"CREATE DATABASE monthly LOCATION '{tmp_path_factory.mktemp('monthly')}'")
    yield bucketed.write_facts(direct, "monthly", 4, by_month=True)
    spark.sql("DROP DATABASE monthly CASCADE")


def item_scans(report):
    plan = report._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line and "monthly.order_items" in line]


@pytest.mark.parametrize("name", ["daily_order_stats_day", "popular_pizza_by_week", "store_profitability_year", "store_performance_week"])
def test_items_of_other_months_are_not_read(direct, monthly, no_broadcast, name):
    report = catalog.REPORTS[name](monthly)
    scans = item_scans(report)
    assert scans and all("_orderMonth" in scan.split("PartitionFilters: [")[1].split("]")[0] for scan in scans)
    assert "hashpartitioning(orderID" not in report._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(report)) == sorted(rows(catalog.REPORTS[name](direct)))


@pytest.mark.parametrize("name", ["total_items_sold_per_store", "weekly_order_stats", "store_performance"])
def test_items_by_month_serve_reports_of_all_time(direct, monthly, name):
    report = catalog.REPORTS[name](monthly)
    assert monthly.order_items.columns == direct.order_items.columns
    assert sorted(rows(report)) == sorted(rows(catalog.REPORTS[name](direct)))
