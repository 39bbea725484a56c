"""Base tables and rollups as Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.joins import estimated_bytes
from tallyhouse.operators.rollups import ITEM_SALES, ORDER_HOURS, ROLLUPS, STORED_YEAR, item_sales, order_hours
from tallyhouse.sources.tables import EXTENDED_ORDERS, SCHEMAS, SCHEMAS_OF_EXTENDED, SalesTables

PARTITION_COLUMNS = ("year", "month")
#: Columns that a year can be read from, for rollups without ``year``: dates, and texts that begin with it.
DATED = ("orderDate", "OrderDate", "period", "adjustedOrderDate")
TEXTS_OF_YEAR = ("yearWeek", "weekYear", "orderMonth", "monthYear")


def read_tables(spark: SparkSession, directory: str, extended: bool = False) -> SalesTables:
    """Base tables from ``directory``/{stores, customers, products, orders, orderItems}, and ``extendedorders`` if it is stored there."""
    frames = {name: spark.read.schema(schema).parquet(f"{directory}/{name}") for name, schema in SCHEMAS.items()}
    tables = SalesTables.from_frames(
        frames["stores"],
        frames["customers"],
        frames["products"],
        frames["orders"],
        frames["orderItems"],
        spark.read.schema(SCHEMAS_OF_EXTENDED).parquet(f"{directory}/{EXTENDED_ORDERS}") if extended else None,
    )
    return replace(tables, order_bytes=estimated_bytes(frames["orders"]))


def _year_of(rollup: DataFrame) -> Column | None:
    """The year of a rollup's rows, if it has no column of that name but one that tells it."""
    if "year" in rollup.columns:
        return None
    for column in DATED:
        if column in rollup.columns:
            return F.year(column)
    for column in TEXTS_OF_YEAR:
        if column in rollup.columns:
            return F.substring(column, 1, 4).cast("int")
    return None


def _write(rollup: DataFrame, path: str) -> DataFrame:
    """Store unsorted, by year and month where the rollup has them, by ``_year`` where its period tells the year.

    The rebalance hint lets Spark split a crowded partition over several files and merge small ones.
    """
    year = _year_of(rollup)
    if year is not None:
        rollup = rollup.withColumn(STORED_YEAR, year)
    partitions = [column for column in (*PARTITION_COLUMNS, STORED_YEAR) if column in rollup.columns]
    writer = rollup.hint("rebalance", *partitions).write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return rollup.sparkSession.read.schema(rollup.schema).parquet(path).select(*rollup.columns)


def write_rollups(tables: SalesTables, directory: str, names: Iterable[str] | None = None) -> SalesTables:
    """Store rollups (all by default) below ``directory`` and return tables that read them.

    Items meet orders twice: for the stored item sales, which the sales rollups are added up from, and for the stored order hours,
    which serve counts of orders and order statistics. Local order times are stored as ``extendedorders``.
    """
    local = _write(tables.extended_orders(), f"{directory}/{EXTENDED_ORDERS}")
    stored = replace(tables, extended=local).with_rollups(
        {
            ITEM_SALES: _write(item_sales(tables), f"{directory}/{ITEM_SALES}"),
            ORDER_HOURS: _write(order_hours(tables), f"{directory}/{ORDER_HOURS}"),
        }
    )
    # The spending of each customer comes first: the number of customers is counted from it.
    for name in sorted(ROLLUPS if names is None else names, key=lambda name: name != "top_customers_per_store"):
        stored = stored.with_rollups({name: _write(ROLLUPS[name](stored), f"{directory}/{name}")})
    return stored


def read_rollups(tables: SalesTables, directory: str, names: Iterable[str]) -> SalesTables:
    """Tables that read the named stored rollups, ``extendedorders`` among them."""
    spark = tables.stores.sparkSession
    frames = {name: spark.read.parquet(f"{directory}/{name}") for name in names}
    extended = frames.pop(EXTENDED_ORDERS, None)
    return replace(tables.with_rollups(frames), extended=tables.extended if extended is None else extended)
