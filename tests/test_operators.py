"""Small tables with results worked out by hand."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import at, make_tables, rows
from pyspark.sql import functions as F

from tallyhouse.operators import activity, customers, lookups, order_stats, products, rollups, shaping, store_sales
from tallyhouse.operators.customers import Box

STORES = [("s1", 40.0, -75.0, "A", "PA"), ("s2", 41.0, -90.0, "B", "IL"), ("s3", 60.0, 10.0, "C", "NO")]
CUSTOMERS = [("c1", 40.1, -75.1), ("c2", 41.0, -90.4), ("c3", 10.0, 10.0)]
PRODUCTS = [
    ("p1", "Plain", "10.00", "Classic", "Small", "x", "4.0000"),
    ("p2", "Plain", "15.00", "Classic", "Large", "x", "5.0000"),
    ("p3", "Green", "0.00", "Vegetarian", "Small", "y", "0.0000"),
]
ORDERS = [
    (1, "c1", "s1", at("2021-02-03T12:00"), "30.00"),
    (2, "c1", "s1", at("2021-02-03T12:30"), "15.00"),
    (3, "c2", "s2", at("2021-12-25T03:00"), "20.00"),
    (4, "c2", "s1", at("2021-01-01T02:00"), "5.00"),
]
ITEMS = [(11, 1, "p1", 1), (12, 1, "p1", 1), (13, 1, "p3", 2), (21, 2, "p2", 1), (31, 3, "p1", 2)]
EVERYWHERE = Box(-90, -180, 90, 180)


@pytest.fixture(scope="module")
def tables(spark):
    return make_tables(spark, STORES, CUSTOMERS, PRODUCTS, ORDERS, ITEMS)


@pytest.fixture(scope="module")
def empty(spark):
    return make_tables(spark)


def test_order_totals_do_not_multiply_with_items(tables):
    got = rows(order_stats.stats(tables, "daily", "2021-02-03"))
    assert got == [("s1", date(2021, 2, 3), 2, 5, Decimal("22.500000"))]


def test_orders_without_items_count(tables):
    got = rows(order_stats.stats(tables, "monthly", "2021-01"))
    assert got == [("s1", "2021-01", 1, 0, Decimal("5.000000"))]


def test_weekly_stats_put_early_january_in_week_zero(tables):
    assert [row[1] for row in rows(order_stats.stats(tables, "weekly"))] == ["2021-00", "2021-05", "2021-51"]


def test_average_of_averages_is_unweighted(tables):
    got = dict(rows(order_stats.average_order_value_per_store(tables, "daily")))
    assert got["s1"] == Decimal("13.75")


def test_year_applies_to_daily_trends_only(tables):
    assert len(rows(order_stats.order_trends(tables, "daily", 2021))) == 3
    assert rows(order_stats.order_trends(tables, "daily", 1999)) == []
    with pytest.raises(ValueError):
        order_stats.order_trends(tables, "weekly", 2021)


def test_revenue_counts_items_and_totals_count_orders(tables):
    assert rows(store_sales.total_revenue(tables)) == [("s1", Decimal("35.0000")), ("s2", Decimal("20.0000"))]
    assert rows(store_sales.total_revenue_per_store(tables)) == [("s1", Decimal("50.00")), ("s2", Decimal("20.00"))]


def test_profit(tables):
    got = rows(store_sales.store_revenue_and_profit_per_month(tables, "2021-02"))
    assert got == [("s1", Decimal("35.0000"), Decimal("22.0000"))]


def test_all_means_no_filter(tables):
    assert rows(store_sales.store_performance(tables, storeID="all", year="2021")) == rows(
        store_sales.store_performance(tables)
    )


def test_several_filters(tables):
    got = rows(store_sales.store_performance(tables, storeID="s1", year=2021, month="2", week=1))
    assert got == [("2021-02", Decimal("35.0000"))]


def test_tied_top_categories_are_all_kept(spark):
    items = [(11, 1, "p1", 2), (12, 1, "p3", 2), (31, 3, "p1", 1)]
    tied = make_tables(spark, STORES, CUSTOMERS, PRODUCTS, ORDERS, items)
    assert rows(products.top_categories_per_store(tied)) == [
        ("s1", "Classic", 2),
        ("s1", "Vegetarian", 2),
        ("s2", "Classic", 1),
    ]


def test_zero_price_and_cost_give_null(tables):
    for operator in (products.cost_structure_per_pizza, products.margin_analysis, products.size_cost_efficiency):
        assert {row[0]: row[-1] for row in rows(operator(tables))}["p3"] is None
    assert {row[0]: row[-1] for row in rows(products.margin_analysis(tables))}["p1"] == Decimal("60.00")


def test_category_sales_drop_null_keys_and_fill_null_sums(spark, tables):
    stored = spark.createDataFrame(
        [("s1", 2021, 1, 1, "Classic", "A", None), ("s1", 2021, 1, 1, None, "B", Decimal("3.00"))],
        "storeID string, year int, month int, week int, category string, product_name string, total_sales decimal(18,2)",
    )
    got = rows(products.category_sales(tables.with_rollups({"category_sales": stored})))
    assert got == [("Classic", "A", Decimal("0.00"))]


def test_ties_at_the_limit_are_broken_by_key(spark):
    catalogue = [(f"k{i:02d}", f"N{i:02d}", "1.00", "C", "Small", "x", "0.5") for i in range(12)]
    items = [(i, 1, f"k{i:02d}", 1) for i in range(12)]
    tied = make_tables(spark, STORES, CUSTOMERS, catalogue, ORDERS, items)
    assert [row[0] for row in rows(products.product_preferences(tied))] == [f"N{i:02d}" for i in range(8)]
    orders = [(i, f"c{i:02d}", "s1", at("2021-01-01T00:00"), "1.00") for i in range(30)]
    guests = [(f"c{i:02d}", 0.0, 0.0) for i in range(30)]
    crowd = make_tables(spark, STORES, guests, PRODUCTS, orders, [])
    assert [row[0] for row in rows(customers.top_customers(crowd, "s1"))] == [f"c{i:02d}" for i in range(10)]
    assert [row[0] for row in rows(customers.top_customers_filtered(crowd, EVERYWHERE))] == [
        f"c{i:02d}" for i in range(25)
    ]


def test_shares_refer_to_all_categories(tables):
    assert rows(products.category_order_share(tables)) == [
        ("Classic", 4, Decimal("80.00")),
        ("Vegetarian", 1, Decimal("20.00")),
    ]
    assert rows(products.product_order_share(tables, "Vegetarian")) == [("Green", "Vegetarian", 1, Decimal("20.00"))]


def test_items_are_counted_not_their_quantity(tables):
    assert rows(products.total_quantity_per_product(tables)) == [("Plain", 4), ("Green", 1)]


def test_impossible_dates_fall_out_of_the_week_filter(spark, tables):
    stored = spark.createDataFrame(
        [("s1", 2021, 2, 30, 5, 7), ("s1", 2021, 2, 3, 5, 2)],
        "storeID string, year int, month int, day int, hour int, order_count bigint",
    )
    with_stored = tables.with_rollups({"order_activity_per_hour": stored})
    assert rows(activity.order_activity_per_hour(with_stored, week=5)) == [(5, 2)]
    assert rows(activity.order_activity_per_hour(with_stored)) == [(5, 9)]


def test_any_other_interval_gives_years(tables):
    assert rows(activity.order_activity_over_time(tables, "week")) == [("s1", "2021", 3), ("s2", "2021", 1)]
    assert rows(activity.order_activity_over_time(tables, "month"))[0] == ("s1", "2021-01", 1)


def test_weekdays_come_in_calendar_order(tables):
    assert [row[1] for row in rows(activity.weekly_orders(tables, storeID="s1"))] == ["Wednesday", "Friday"]


def test_hourly_average_uses_local_time(tables):
    assert rows(activity.avg_orders_per_hour_utc(tables)) == [
        (2, "s1", Decimal("0.5000")),
        (12, "s1", Decimal("1.0000")),
        (3, "s2", Decimal("1.0000")),
    ]
    # Five hours west of the meridian, 02:00 on New Year's Day is 21:00 of the day before; s2 is six hours west.
    assert rows(activity.avg_orders_per_hour(tables)) == [
        (7, "s1", Decimal("1.0000")),
        (21, "s1", Decimal("0.5000")),
        (21, "s2", Decimal("1.0000")),
    ]


def test_holidays(tables):
    assert rows(activity.holiday_order_analysis(tables)) == [
        (date(2021, 12, 25), "s2", 1, "Christmas Day"),
        (date(2021, 1, 1), "s1", 1, "New Year's Day"),
    ]
    assert len(rows(activity.seasonal_order_details(tables, "Winter"))) == 3
    with pytest.raises(ValueError):
        activity.seasonal_order_details(tables, "")


def test_top_dates_keep_the_busiest_days(tables):
    got = rows(rollups.top_order_dates(tables, 1).orderBy("storeID"))
    assert [row[:3] for row in got] == [(date(2021, 2, 3), "s1", 2), (date(2021, 12, 25), "s2", 1)]


def test_box_includes_its_border(tables):
    corner = Box(40.0, -90.0, 41.0, -75.0)
    assert [row[0] for row in rows(corner.stores(tables).select("storeID").orderBy("storeID"))] == ["s1", "s2"]
    inside = Box(40.00004, -90.0, 41.0, -75.0)
    assert [row[0] for row in rows(inside.stores(tables).select("storeID").orderBy("storeID"))] == ["s1", "s2"]


def test_second_average_is_weighted_by_orders(tables):
    got = {row[0]: row[1:] for row in rows(customers.average_order_value(tables, EVERYWHERE, 2021))}
    assert got["2021-05"] == (Decimal("22.500000"), Decimal("2.0000"))
    # The order of New Year's Day belongs to 2020 in local time.
    assert set(got) == {"2021-05", "2021-51"}
    assert "2020-53" in {row[0] for row in rows(customers.average_order_value(tables, EVERYWHERE, "all"))}


def test_window_form_of_the_weighted_average(tables):
    from pyspark.sql import Window

    from tallyhouse.functions import calendar

    week = calendar.year_week_label(calendar.year_week_number(F.to_date("adjustedOrderDate")))
    orders = tables.extended_orders().withColumn("week", week)
    counted = orders.withColumn("n", F.count("orderID").over(Window.partitionBy("customerID", "week")))
    want = {row[0]: row[1] for row in rows(counted.groupBy("week").agg(F.avg("n")))}
    got = {row[0]: float(row[2]) for row in rows(customers.average_order_value(tables, EVERYWHERE))}
    assert got == pytest.approx(want)


def test_loyalty_limits(spark):
    orders = [
        (i, customer, "s1", at("2021-01-02T00:00"), "1.00")
        for customer, first, count in (("a", 0, 181), ("b", 1000, 180), ("c", 2000, 121), ("d", 3000, 61), ("e", 4000, 60))
        for i in range(first, first + count)
    ]
    tables = make_tables(spark, STORES, [], PRODUCTS, orders, [])
    assert rows(customers.customer_loyalty(tables, EVERYWHERE)) == [("s1", 1, 2, 1, 1)]


def test_loyalty_profile_switches_above_five_stores(spark):
    schema = "storeID string, more_than_15 bigint, more_than_10 bigint, more_than_5 bigint, less_than_5 bigint"
    five = spark.createDataFrame([(f"s{i}", i, 0, 0, 1) for i in range(5)], schema)
    assert len(rows(shaping.loyalty_profile(five))) == 20
    six = spark.createDataFrame([(f"s{i}", i, 0, 0, 1) for i in range(6)], schema)
    got = {row[1]: (row[0], row[2]) for row in rows(shaping.loyalty_profile(six))}
    assert got == {
        "> 15 Orders": (None, 2.5),
        "> 10 Orders": (None, 0.0),
        "> 5 Orders": (None, 0.0),
        "< 5 Orders": (None, 1.0),
    }
    assert rows(shaping.loyalty_profile(five.limit(0))) == []


def test_monthly_series_sum_only_present_columns(spark, tables):
    months = shaping.sales_by_month(store_sales.store_profitability(tables))
    assert months.columns == ["year", "month", "date", "totalRevenue", "totalProfit"]
    assert rows(months.select("date", "totalRevenue")) == [
        ("Feb 2021", Decimal("35.0000")),
        ("Dec 2021", Decimal("20.0000")),
    ]
    split = rows(shaping.profit_split_by_month(store_sales.store_profitability(tables)))
    assert split[0] == ("Feb 2021", Decimal("22.0000"), Decimal("13.0000"))


def test_matrices_fill_with_zero(tables):
    matrix = shaping.category_product_matrix(products.category_sales(tables))
    assert matrix.columns == ["category", "Green", "Plain"]
    assert rows(matrix.orderBy("category")) == [
        ("Classic", Decimal("0.0000"), Decimal("55.0000")),
        ("Vegetarian", Decimal("0.0000"), Decimal("0.0000")),
    ]
    units = shaping.store_category_matrix(products.category_sales_comparison(tables), ["Classic", "Vegetarian"])
    assert rows(units.orderBy("storeID")) == [("s1", 3, 2), ("s2", 2, 0)]


def test_all_seasons_are_listed(tables):
    got = dict(rows(shaping.seasonal_totals(activity.seasonal_order_analysis(tables))))
    assert got == {"Winter": 4, "Spring": 0, "Summer": 0, "Fall": 0}


def test_shares_sum_to_a_hundred_per_series(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), (None, 2)], "s string, v bigint")
    got = rows(shaping.share_of_total(frame, "v", "s").orderBy("s", "v"))
    assert [row[2] for row in got] == [Decimal("100.00"), Decimal("25.00"), Decimal("75.00"), Decimal("100.00")]
    assert [row[2] for row in rows(shaping.share_of_total(frame, "v").orderBy("v"))] == [
        Decimal("9.09"),
        Decimal("18.18"),
        Decimal("27.27"),
        Decimal("45.45"),
    ]


def test_weeks_once_however_many_stores(tables):
    got = sorted(row[0] for row in rows(lookups.popular_pizza_by_week_only_weeks(tables)))
    assert got == ["2021-05", "2021-51"]


def test_months_once_per_store(tables):
    assert sorted(row[0] for row in rows(lookups.order_month(tables))) == ["2021-02", "2021-12"]


def test_empty_tables_give_empty_reports(empty):
    from tallyhouse.plans import catalog

    for name, report in catalog.REPORTS.items():
        got = rows(report(empty))
        if name.startswith("geo_bounds"):
            assert got == [(None,) * 4]
        elif name == "seasonal_totals":
            assert {row[1] for row in got} == {0}
        else:
            assert got == [], name


def test_prices_may_be_doubles(spark, tables):
    from dataclasses import replace

    as_doubles = tables.products.withColumn("Price", F.col("Price").cast("double")).withColumn(
        "production_costs", F.col("production_costs").cast("double")
    )
    got = rollups.rollup(replace(tables, products=as_doubles), "store_profitability")
    assert rows(got.orderBy("storeID")) == rows(rollups.rollup(tables, "store_profitability").orderBy("storeID"))


def test_product_totals_beyond_a_long(spark, no_broadcast):
    catalogue = [("p", "Gold", "99999999999999.99", "C", "Small", "x", "0.0000")]
    orders = [(1, "c", "s1", at("2021-01-01T00:00"), "1.00")]
    tables = make_tables(spark, STORES, [], catalogue, orders, [(1, 1, "p", 10**9)] * 2)
    assert rows(store_sales.total_revenue(tables)) == [("s1", Decimal("199999999999999980000000.0000"))]


def test_matrices_leave_no_sum_out(spark):
    from tallyhouse.operators import shaping

    sales = spark.createDataFrame([("s1", "A", 3), ("s1", "New", 4), ("s2", None, 5)], "storeID string, Category string, NumberOfPizzasSold long")
    got = shaping.store_category_matrix(sales, shaping.names_of(sales, "Category"))
    assert got.columns == ["storeID", "A", "New", "null"]
    assert sorted(map(tuple, got.collect())) == [("s1", 3, 4, 0), ("s2", 0, 0, 5)]
    assert sorted(shaping.store_category_matrix(sales).columns) == sorted(got.columns)
    with pytest.raises(Exception, match="no column for Category"):
        shaping.store_category_matrix(sales, ["A"]).collect()


def test_shares_of_a_busy_and_a_null_series(spark, no_broadcast):
    from tallyhouse.operators import shaping

    sales = spark.createDataFrame([("A", i % 2 + 1) for i in range(20)] + [(None, 1), (None, 3), ("null", 2)], "Category string, n long")
    got = {(r["Category"], r["n"]): float(r["percentage"]) for r in shaping.share_of_total(sales, "n", "Category").collect()}
    assert got == {("A", 1): 3.33, ("A", 2): 6.67, (None, 1): 25.0, (None, 3): 75.0, ("null", 2): 100.0}
