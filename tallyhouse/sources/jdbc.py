"""Base tables from a relational database over JDBC."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.sources.tables import EXTENDED_ORDERS, SCHEMAS, SCHEMAS_OF_EXTENDED, SalesTables

FACTS = ("orders", "orderItems", EXTENDED_ORDERS)


def typed(table: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema; one that has its type already stays a plain column, whose filters the database runs."""
    columns = []
    for field in schema:
        column = F.col(field.name)
        columns.append(column if table.schema[field.name].dataType == field.dataType else column.cast(field.dataType).alias(field.name))
    return table.select(*columns)


def read_tables(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    order_ids: tuple[int, int],
    partitions: int,
    fetch_size: int = 10_000,
    extended: bool = False,
) -> SalesTables:
    """Read the five tables; orders and items in ``partitions`` parallel ranges of ``orderID`` between ``order_ids``.

    Rows outside the bounds are read too, by the first and last range. Times are read without a zone, so that date filters meet a plain column and run in the
    database. ``extended`` reads the local order times from the table ``extendedorders`` too.
    """
    options = {"fetchsize": str(fetch_size), "preferTimestampNTZ": "true", **properties}

    def read(name: str) -> DataFrame:
        if name in FACTS:
            low, high = order_ids
            table = spark.read.jdbc(url, name, "orderID", low, high, partitions, properties=options)
        else:
            table = spark.read.jdbc(url, name, properties=options)
        return typed(table, SCHEMAS.get(name, SCHEMAS_OF_EXTENDED))

    return SalesTables.from_frames(
        read("stores"),
        read("customers"),
        read("products"),
        read("orders"),
        read("orderItems"),
        read(EXTENDED_ORDERS) if extended else None,
    )


def read_rollups(tables: SalesTables, url: str, properties: dict[str, str], names: Iterable[str], fetch_size: int = 10_000) -> SalesTables:
    """Tables that read the named rollups, ``extendedorders`` among them, from tables of the same names."""
    spark = tables.stores.sparkSession
    options = {"fetchsize": str(fetch_size), "preferTimestampNTZ": "true", **properties}
    frames = {name: spark.read.jdbc(url, name, properties=options) for name in names}
    extended = frames.pop(EXTENDED_ORDERS, None)
    return replace(tables.with_rollups(frames), extended=tables.extended if extended is None else typed(extended, SCHEMAS_OF_EXTENDED))
