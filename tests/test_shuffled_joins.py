"""Items meet orders, and sums meet products, without being sorted where a task can hash its part of the other table."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from dataclasses import replace

import pytest
from conftest import SMALL_DATA, at, make_tables, rows

from tallyhouse.operators import rollups
from tallyhouse.plans import catalog
from tallyhouse.sources.tpch import tpch_tables


@contextmanager
def settings(spark, **values):
    """Settings by the last parts of their names."""
    names = {
        "broadcast": "spark.sql.autoBroadcastJoinThreshold",
        "advisory": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "skewed": "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "factor": "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
    }
    before = {names[key]: spark.conf.get(names[key]) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(names[key], str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rollup_category_sales", "rollup_product_preferences", "rollup_store_pizza_sales"])
def test_items_are_not_sorted_to_meet_their_orders(spark, name):
    size = tpch_tables(spark, SMALL_DATA).order_bytes
    with settings(spark, broadcast=size // 2):
        hashed = catalog.queries()[name](spark, SMALL_DATA)
        text, got = plan(hashed), Counter(rows(hashed))
    assert "ShuffledHashJoin [orderID" in text and "SortMergeJoin [orderID" not in text
    with settings(spark, broadcast=-1):
        plain = catalog.queries()[name](spark, SMALL_DATA)
        assert "SortMergeJoin [orderID" in plan(plain) and Counter(rows(plain)) == got


def test_too_large_for_a_task_is_sorted(spark):
    tables = tpch_tables(spark, SMALL_DATA)
    with settings(spark, broadcast=1000):  # a task's part of the orders is over the limit
        assert tables.order_bytes > 1000 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert "SortMergeJoin [orderID" in plan(rollups.rollup(tables, "category_sales"))


def test_a_giant_order_is_still_split(spark):
    items = [(i, 7 if i % 2 else i % 500, f"p{i % 3}", 1 + i % 4) for i in range(40_000)]
    tables = make_tables(
        spark,
        products=[(f"p{i}", f"N{i % 2}", f"{5 + i}.25", "C", "Small", "x", "1.0000") for i in range(3)],
        orders=[(i, "c", f"s{i % 5}", at("2021-03-05T10:00"), "9.00") for i in range(500)],
        items=items,
    )
    tables = replace(tables, order_items=tables.order_items.repartition(8), order_bytes=30_000, dimension_bytes={"products": 30_000})
    with settings(spark, broadcast=20_000, advisory="4k", skewed="4k", factor="1.2"):
        summed = rollups.rollup(tables, "category_sales")
        got = {(row.storeID, row.product_name): row.total_sales for row in summed.collect()}
        text = plan(summed)
    assert "ShuffledHashJoin(skew=true) [orderID" in text and "ShuffledHashJoin [SKU" in text
    expected = Counter()
    for _, order, sku, quantity in items:
        expected[f"s{order % 5}", f"N{int(sku[1]) % 2}"] += quantity * (500 + 100 * int(sku[1]) + 25)
    assert {key: int(total * 100) for key, total in got.items()} == expected
