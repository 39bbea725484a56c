"""Orders and order items stored in the same buckets of ``orderID``.

Joining them then needs no shuffle of either, which is the largest shuffle of every sales report. A bucket is read
by one task; with ``by_month`` items are also partitioned by the month of their order, so a report on a day, week, month or year
reads the items of its months only. Where a single order is too large a part of all items, these are stored without buckets, with a warning, and the join shuffles them.
"""

from __future__ import annotations

import warnings
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.spans import DateSpan
from tallyhouse.sources.tables import SalesTables


def _largest_order(order_items: DataFrame) -> tuple[int, int]:
    """Items of the largest order and of all orders; no shuffle where items are bucketed by order."""
    per_order = order_items.groupBy("orderID").agg(F.count("*").alias("items"))
    largest, total = per_order.agg(F.max("items"), F.sum("items")).first()
    return largest or 0, total or 0


#: Month of an item's order, as 12 * year + month; null for items without one.
ORDER_MONTH = "_orderMonth"


def _save(df: DataFrame, table: str, buckets: int) -> None:
    # One task per bucket, so that each bucket becomes one sorted file (of each month).
    spread = df.repartition(buckets, "orderID")
    writer = spread.write.mode("overwrite").bucketBy(buckets, "orderID").sortBy("orderID")
    (writer.partitionBy(ORDER_MONTH) if ORDER_MONTH in df.columns else writer).saveAsTable(table)


def _with_month(items: DataFrame, orders: DataFrame) -> DataFrame:
    month = (F.year("orderDate") * 12 + F.month("orderDate")).alias(ORDER_MONTH)
    return items.join(orders.select("orderID", month), "orderID", "left").select(*items.columns, ORDER_MONTH)


def _touches(span: DateSpan) -> Column:
    """Predicate on the partition column that holds for every day inside."""
    last = span.end - timedelta(days=1)
    return F.col(ORDER_MONTH).between(12 * span.start.year + span.start.month, 12 * last.year + last.month)


def write_facts(tables: SalesTables, database: str, buckets: int, by_month: bool = False) -> SalesTables:
    """Save ``orders`` and ``order_items`` as bucketed tables of ``database`` and return tables that read them."""
    _save(tables.orders(), f"{database}.orders", buckets)
    items = tables.order_items
    if by_month:  # the orders just stored: one side of this join is in its buckets already
        items = _with_month(items, tables.stores.sparkSession.table(f"{database}.orders"))
    _save(items, f"{database}.order_items", buckets)
    largest, total = _largest_order(tables.stores.sparkSession.table(f"{database}.order_items"))
    if largest > max(total // buckets, 1):
        warnings.warn(f"an order has {largest} of {total} items, more than a bucket should: items are stored without buckets", stacklevel=2)
        plain = items.write.mode("overwrite")
        (plain.partitionBy(ORDER_MONTH) if by_month else plain).saveAsTable(f"{database}.order_items")
    return read_facts(tables, database)


def read_facts(tables: SalesTables, database: str) -> SalesTables:
    """``tables`` with the facts read from the bucketed tables of ``database``."""
    spark: SparkSession = tables.stores.sparkSession
    orders = spark.table(f"{database}.orders")

    def order_source(span: DateSpan | None) -> DataFrame:
        return orders if span is None else orders.filter(span.contains(F.col("orderDate")))

    items = spark.table(f"{database}.order_items")
    if ORDER_MONTH not in items.columns:
        return replace(tables, order_items=items, order_source=order_source, item_source=None, order_bytes=None)

    def item_source(span: DateSpan | None) -> DataFrame:
        return (items if span is None else items.filter(_touches(span))).drop(ORDER_MONTH)

    return replace(tables, order_items=items.drop(ORDER_MONTH), order_source=order_source, item_source=item_source, order_bytes=None)
