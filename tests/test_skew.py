"""One store, customer, product and place hold a third of all rows, and nothing is small enough to broadcast."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import make_tables, rows

from tallyhouse.operators import activity, customers, products, rollups, store_sales
from tallyhouse.operators.customers import Box

BOX = Box(-90, -180, 90, 180)


def hot(draw, share, names):
    return names[0] if draw.random() < share else draw.choice(names)


@pytest.fixture(scope="module")
def data():
    draw = random.Random(11)
    stores = [(f"s{i}", 30.0 + i, -120.0 + 5 * i, f"c{i}", f"st{i % 3}") for i in range(9)]
    guests = [(f"c{i:03d}", 30.0 + i % 7 / 4, -120.0 + i % 5 / 4) for i in range(120)]
    catalogue = [
        (f"p{i}", f"N{i % 6}", f"{5 + i}.25", f"C{i % 2}", ("Small", "Large")[i % 2], "x", f"{1 + i / 8:.4f}")
        for i in range(12)
    ]
    orders = [
        (
            i,
            hot(draw, 0.33, [guest[0] for guest in guests]),
            hot(draw, 0.33, [store[0] for store in stores]),
            datetime(2021, 1, 1) + timedelta(hours=draw.randrange(24 * 365)),
            f"{draw.randrange(100, 9000) / 100:.2f}",
        )
        for i in range(3000)
    ]
    items = [
        (i, 7 if draw.random() < 0.33 else draw.randrange(3000), hot(draw, 0.33, [p[0] for p in catalogue]), draw.randint(1, 5))
        for i in range(9000)
    ]
    return stores, guests, catalogue, orders, items


@pytest.fixture
def tables(spark, data, no_broadcast):
    return make_tables(spark, *data)


def test_revenue_and_profit(tables, data):
    _, _, catalogue, orders, items = data
    store_of = {order[0]: order[2] for order in orders}
    price = {p[0]: (Decimal(p[2]), Decimal(p[6])) for p in catalogue}
    revenue, profit = defaultdict(Decimal), defaultdict(Decimal)
    for _, order, sku, quantity in items:
        revenue[store_of[order]] += quantity * price[sku][0]
        profit[store_of[order]] += quantity * (price[sku][0] - price[sku][1])
    assert dict(rows(store_sales.total_revenue(tables))) == revenue
    got = rollups.rollup(tables, "store_profitability", ["storeID"])
    assert {row[0]: (row[1], row[2]) for row in rows(got)} == {s: (revenue[s], profit[s]) for s in revenue}


def test_order_totals(tables, data):
    want = defaultdict(Decimal)
    for order in data[3]:
        want[order[2]] += Decimal(order[4])
    assert dict(rows(store_sales.total_revenue_per_store(tables))) == want


def test_item_counts(tables, data):
    name_of = {p[0]: p[1] for p in data[2]}
    assert dict(rows(products.total_quantity_per_product(tables))) == Counter(name_of[item[2]] for item in data[4])


def test_stores_with_sales(tables, data):
    from tallyhouse.operators import lookups

    store_of = {order[0]: order[2] for order in data[3]}
    assert {row[0] for row in rows(lookups.only_stores(tables))} == {store_of[item[1]] for item in data[4]}


def test_local_hours(tables, data):
    shift = {store[0]: timedelta(hours=store[2] // 15) for store in data[0]}
    hours, days = Counter(), defaultdict(set)
    for order in data[3]:
        local = order[3] + shift[order[2]]
        hours[(local.hour, order[2])] += 1
        days[order[2]].add(local.date())
    got = {row[:2]: float(row[2]) for row in rows(activity.avg_orders_per_hour(tables))}
    assert got == pytest.approx({key: n / len(days[key[1]]) for key, n in hours.items()}, abs=5.1e-5)


def test_loyalty_and_top_customers(tables, data):
    visits = Counter((order[1], order[2]) for order in data[3])
    want = defaultdict(lambda: [0, 0, 0, 0])
    for (_, store), n in visits.items():
        want[store][0 if n > 6 else 1 if n > 4 else 2 if n > 2 else 3] += 1
    got = rows(customers.customer_loyalty(tables, BOX, months=1.0, limits=(6, 4, 2)))
    assert {row[0]: list(row[1:]) for row in got} == want
    spent = Counter(order[1] for order in data[3])
    best = sorted(spent.items(), key=lambda pair: (-pair[1], pair[0]))[:25]
    assert [row[:2] for row in rows(customers.top_customers_filtered(tables, BOX))] == best


def test_proximity(tables, data):
    want = Counter(
        store[4]
        for store in data[0]
        for guest in data[1]
        if abs(store[1] - guest[1]) < 0.5 and abs(store[2] - guest[2]) < 0.5
    )
    assert dict(rows(customers.customers_per_state(tables))) == want


def test_hot_order_is_split_over_tasks(spark, data, no_broadcast):
    """The one join that must bring all items of an order together splits an order that dwarfs the others."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        report = store_sales.total_revenue(make_tables(spark, *data))
        report.collect()
        assert "SortMergeJoin(skew=true)" in report._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
