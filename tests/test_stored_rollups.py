"""Reports read from stored rollups equal those computed from the facts."""

from __future__ import annotations

import pytest
from conftest import SMALL_DATA, rows

from tallyhouse.operators import activity, order_stats, rollups, store_sales
from tallyhouse.operators.rollups import ITEM_SALES, ORDER_HOURS, ROLLUPS
from tallyhouse.plans import catalog
from tallyhouse.sources import parquet
from tallyhouse.sources.tpch import tpch_tables

REPORTS = {name: report for name, report in catalog.REPORTS.items() if not name.startswith("rollup_")}


@pytest.fixture(scope="module")
def direct(spark):
    return tpch_tables(spark, SMALL_DATA)


@pytest.fixture(scope="module")
def stored(direct, tmp_path_factory):
    return parquet.write_rollups(direct, str(tmp_path_factory.mktemp("rollups")))


@pytest.mark.parametrize("name", list(REPORTS))
def test_same_report_from_stored_rollups(direct, stored, name):
    want, got = REPORTS[name](direct), REPORTS[name](stored)
    assert got.columns == want.columns
    assert sorted(map(repr, rows(catalog.decimals_as_double(got)))) == sorted(
        map(repr, rows(catalog.decimals_as_double(want)))
    )


def test_every_rollup_is_stored(stored):
    assert set(stored.rollups) == {ITEM_SALES, ORDER_HOURS, *ROLLUPS} and stored.extended is not None


def test_item_sales_alone_serve_the_sales_reports(direct, stored):
    only_items = direct.with_rollups({ITEM_SALES: stored.rollups[ITEM_SALES]})
    for name in ("store_performance_week", "store_sales_per_month", "popular_pizza_by_week", "product_preferences"):
        assert rows(REPORTS[name](only_items)) == rows(REPORTS[name](direct)), name
    plan = REPORTS["store_performance_year"](only_items)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_read_back_by_name(direct, stored, tmp_path):
    directory = str(tmp_path / "some")
    names = ["store_performance", "order_activity"]
    written = parquet.write_rollups(direct, directory, names)
    again = parquet.read_rollups(direct, directory, names)
    for name in names:
        key = written.rollups[name].columns
        assert sorted(rows(again.rollups[name].select(*key))) == sorted(rows(written.rollups[name].select(*key)))


def test_base_tables_round_trip(spark, direct, tmp_path):
    from tallyhouse.sources.tables import SCHEMAS

    frames = {
        "stores": direct.stores,
        "customers": direct.customers,
        "products": direct.products,
        "orders": direct.orders(),
        "orderItems": direct.order_items,
    }
    for name, frame in frames.items():
        typed = [frame[field.name].cast(field.dataType).alias(field.name) for field in SCHEMAS[name].fields]
        frame.select(*typed).write.parquet(str(tmp_path / name))
    again = parquet.read_tables(spark, str(tmp_path))
    for name in ("total_revenue", "category_sales", "average_order_value", "daily_order_trends_year"):
        assert rows(REPORTS[name](again).drop("storeID")) == rows(REPORTS[name](direct).drop("storeID")), name


def test_jdbc_reads_facts_in_parallel_ranges(spark):
    from tallyhouse.sources import jdbc
    from tallyhouse.sources.tables import SCHEMAS

    calls = {}

    class Reader:
        def jdbc(self, url, table, *ranges, properties):
            calls[table] = (url, ranges, properties)
            return spark.createDataFrame([], SCHEMAS[table])

    class Session:
        read = Reader()

    tables = jdbc.read_tables(Session(), "jdbc:x", {"user": "u"}, (1, 100), 4)
    assert tables.orders().schema == SCHEMAS["orders"]
    assert set(calls) == set(SCHEMAS)
    options = {"fetchsize": "10000", "preferTimestampNTZ": "true", "user": "u"}
    assert calls["orders"] == ("jdbc:x", ("orderID", 1, 100, 4), options)
    assert calls["stores"][1] == ()


def plan_of(frame) -> str:
    spark = frame.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_storing_reads_the_facts_a_few_times_only(direct, monkeypatch):
    plans = []
    monkeypatch.setattr(parquet, "_write", lambda rollup, path: plans.append(plan_of(rollup)) or rollup)
    parquet.write_rollups(direct, "nowhere")
    # Stored tables stand in for themselves here, so only the plans that begin with facts count.
    fresh = plans[:3] + [text for text in plans[3:4] if "lineitem" not in text]
    assert sum("lineitem.parquet" in text for text in fresh) == 2
    assert sum(text.count("orders.parquet") for text in fresh) == 4


def test_rollups_of_stored_sums_read_no_facts(direct, stored):
    for name in ROLLUPS:
        if name not in ("top_customers_per_store", "pizza_profit_analysis"):
            only_sums = {n: stored.rollups[n] for n in (ITEM_SALES, ORDER_HOURS, "top_customers_per_store") if n != name}
            text = plan_of(ROLLUPS[name](parquet.replace(direct, extended=stored.extended).with_rollups(only_sums)))
            assert "lineitem.parquet" not in text and "/orders.parquet" not in text, name


@pytest.mark.parametrize(
    "name, year",
    [("store_sales_per_month", 1998), ("popular_pizza_by_week", 1998), ("daily_order_stats_day", 1998), ("daily_order_trends_year", 1998)],
)
def test_stored_rollups_are_pruned(stored, name, year):
    text = plan_of(REPORTS[name](stored))
    assert "_year#" in text.split("PartitionFilters: [")[1].split("]")[0] and f"{year}" in text
    if name == "store_sales_per_month":
        assert "GreaterThanOrEqual(orderDate,1998-03-01)" in text and "LessThan(orderDate,1998-04-01)" in text


def test_odd_arguments_mean_the_same_on_both_paths(direct, stored):
    calls = [
        lambda t: activity.store_orders_by_weekday(t, "Someday"),
        lambda t: store_sales.store_sales_per_month(t, "1998-3"),
        lambda t: order_stats.stats(t, "weekly", "1998-9"),
        lambda t: order_stats.stats(t, "monthly", "1998-3"),
        lambda t: rollups.rollup(t, "weekly_store_pizza_sales", equals={"yearWeek": "1998-9"}),
        lambda t: activity.order_activity_per_hour(t, year="1998", week="10"),
    ]
    only_sums = direct.with_rollups({n: stored.rollups[n] for n in (ITEM_SALES, ORDER_HOURS)})
    for i, call in enumerate(calls):
        want = sorted(map(repr, rows(call(direct))))
        assert bool(want) == (i > 0)
        assert sorted(map(repr, rows(call(stored)))) == want and sorted(map(repr, rows(call(only_sums)))) == want, i


def test_stored_local_times_are_followed(spark, direct, tmp_path):
    from pyspark.sql import functions as F

    later = direct.extended_orders().withColumn("adjustedOrderDate", F.expr("adjustedOrderDate + interval 400 days 3 hours"))
    later.write.parquet(str(tmp_path / "extendedorders"))
    moved = parquet.read_rollups(direct, str(tmp_path), ["extendedorders"])
    for name in ("customer_loyalty", "top_customers_filtered", "average_order_value", "avg_orders_per_hour"):
        assert rows(REPORTS[name](moved)) != rows(REPORTS[name](direct)), name
    first = {r[0]: r[2] for r in rows(REPORTS["top_customers_filtered_all_years"](direct))}
    for customer, _, at in rows(REPORTS["top_customers_filtered_all_years"](moved)):
        assert (at - first[customer]).days == 400


def test_jdbc_filters_meet_plain_columns(spark, direct, tmp_path):
    """A database column that has its type already is not cast, so a date filter reaches the reader."""
    from tallyhouse.functions.spans import year_span
    from tallyhouse.sources import jdbc
    from tallyhouse.sources.tables import SCHEMAS
    from pyspark.sql import functions as F

    direct.orders().withColumn("total", F.col("total").cast("decimal(10,2)")).write.parquet(str(tmp_path / "orders"))
    orders = jdbc.typed(spark.read.parquet(str(tmp_path / "orders")), SCHEMAS["orders"])
    assert orders.schema.simpleString() == SCHEMAS["orders"].simpleString()
    assert "GreaterThanOrEqual(orderDate,1998" in plan_of(orders.filter(year_span(1998).contains(F.col("orderDate"))))


def test_jdbc_reads_rollups_by_name(direct, stored):
    from tallyhouse.sources import jdbc

    class Reader:
        def jdbc(self, url, table, properties):
            assert properties["preferTimestampNTZ"] == "true"
            return stored.extended if table == "extendedorders" else stored.rollups[table]

    class Stores:
        class sparkSession:
            read = Reader()

    tables = jdbc.read_rollups(parquet.replace(direct, stores=Stores()), "jdbc:x", {}, ["order_activity", "extendedorders"])
    assert set(tables.rollups) == {"order_activity"} and tables.extended.columns[-1] == "adjustedOrderDate"
