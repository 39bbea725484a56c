"""Base tables derived from TPC-H-style tables.

Stores are suppliers, products are parts, order items are line items. Coordinates, store keys and clock times, which
the source lacks, are computed from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.joins import estimated_bytes
from tallyhouse.functions.numbers import MONEY
from tallyhouse.functions.spans import DateSpan
from tallyhouse.sources.tables import SalesTables


# The columns read, stated so that opening a table runs no job to look them up.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double",
}


def _coordinate(key: str, factor: int, modulus: int, steps: int, origin: int) -> Column:
    return F.lit(float(origin)) + ((F.col(key) * factor) % modulus).cast("double") / F.lit(float(steps))


def _size_label(size: Column) -> Column:
    return (
        F.when(size <= 12, "Small").when(size <= 25, "Medium").when(size <= 38, "Large").otherwise("Extra Large")
    )


def _stores(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("storeID"),
            _coordinate("s_suppkey", 7, 250, 10, 25).alias("latitude"),
            _coordinate("s_suppkey", 13, 550, 10, -125).alias("longitude"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
        )
    )


def _customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customerID"),
        _coordinate("c_custkey", 17, 2500, 100, 25).alias("latitude"),
        _coordinate("c_custkey", 29, 5500, 100, -125).alias("longitude"),
    )


def _products(part: DataFrame) -> DataFrame:
    price = F.col("p_retailprice").cast(MONEY)
    cost_percent = (30 + 5 * (F.col("p_partkey") % 5)).cast("decimal(3,0)")
    return part.select(
        F.col("p_partkey").alias("SKU"),
        F.col("p_name").alias("Name"),
        price.alias("Price"),
        F.col("p_type").alias("Category"),
        _size_label(F.col("p_size")).alias("Size"),
        F.col("p_brand").alias("Ingredients"),
        (price * cost_percent * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,4)").alias("production_costs"),
    )


def _orders(orders: DataFrame, store_count: Column) -> DataFrame:
    order, customer, zero = F.col("o_orderkey"), F.col("o_custkey"), F.lit(0)
    hour = ((order + customer) % 24).cast("int")
    return orders.select(
        order.alias("orderID"),
        customer.alias("customerID"),
        ((customer + order % 3) % store_count).alias("storeID"),
        (F.col("o_orderdate") + F.make_dt_interval(zero, hour, zero, zero)).alias("orderDate"),
        F.col("o_totalprice").cast(MONEY).alias("total"),
    )


def tpch_tables(spark: SparkSession, directory: str) -> SalesTables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")

    supplier, part, customer, orders = read("supplier"), read("part"), read("customer"), read("orders")
    store_count = supplier.agg(F.count("*")).scalar()

    def order_source(span: DateSpan | None) -> DataFrame:
        # Source dates are midnights and the clock time added is under a day, so the range holds for both.
        kept = orders if span is None else orders.filter(span.contains(F.col("o_orderdate")))
        return _orders(kept, store_count)

    return SalesTables(
        stores=_stores(supplier, read("nation"), read("region")),
        customers=_customers(customer),
        products=_products(part),
        order_items=read("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("orderItemID"),
            F.col("l_orderkey").alias("orderID"),
            F.col("l_partkey").alias("SKU"),
            F.col("l_quantity").cast("bigint").alias("Quantity"),
        ),
        order_source=order_source,
        dimension_bytes={"stores": estimated_bytes(supplier), "products": estimated_bytes(part)},
        order_bytes=estimated_bytes(orders),
    )
