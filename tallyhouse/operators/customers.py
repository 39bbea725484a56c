"""Customers: where they are, what they spend, how often they come back; and states."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import calendar
from tallyhouse.functions.filters import given
from tallyhouse.functions.numbers import exact_ratio, money_average
from tallyhouse.functions.spans import year_span
from tallyhouse.operators import rollups
from tallyhouse.operators.proximity import nearby_pair_counts
from tallyhouse.operators.rollups import rollup
from tallyhouse.sources.tables import SalesTables

NEARBY_DEGREES = 0.5


@dataclass(frozen=True)
class Box:
    """A latitude-longitude rectangle; the corners count with four decimals and belong to it."""

    sw_lat: float
    sw_lng: float
    ne_lat: float
    ne_lng: float

    def stores(self, tables: SalesTables) -> DataFrame:
        south, west, north, east = (round(v, 4) for v in (self.sw_lat, self.sw_lng, self.ne_lat, self.ne_lng))
        return tables.stores.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def unique_customers_per_store_table(tables: SalesTables) -> DataFrame:
    return rollups.unique_customers_per_store(tables).select("storeID", "uniqueCustomers")


def top_customers(tables: SalesTables, storeID: Any) -> DataFrame:
    """The ten customers who spent most at one store."""
    spent = rollup(tables, "top_customers_per_store", equals={"storeID": storeID})
    return spent.select("customerID", "total_spent").orderBy(F.desc("total_spent"), "customerID").limit(10)


def customers_with_orders(tables: SalesTables) -> DataFrame:
    """Order weight (orders / 25) and place of every customer with orders, for a heat map.

    Orders are counted per customer before the join, which then meets one row per customer on both sides.
    """
    counts = tables.orders().groupBy("customerID").agg(F.count("orderID").alias("_orders"))
    return counts.join(tables.customers, "customerID").select(
        exact_ratio(F.col("_orders"), F.lit(25), 4).alias("order_count"), "latitude", "longitude"
    )


def _orders_in_box(tables: SalesTables, box: Box, year: Any) -> DataFrame:
    wanted = given(year=year).get("year")
    return tables.extended_orders(None if wanted is None else year_span(wanted), box.stores(tables))


def average_order_value(tables: SalesTables, box: Box, year: Any = None) -> DataFrame:
    """Per week: average order value, and average over orders of the customer's number of orders in that week.

    A customer with n orders in a week contributes n rows of value n, so the second average is sum(n*n) / sum(n); that
    takes two aggregations and no window over the orders of a customer.
    """
    day = F.to_date("adjustedOrderDate")
    per_customer = (
        _orders_in_box(tables, box, year)
        .groupBy(calendar.year_week_number(day).alias("_week"), "customerID")
        .agg(F.count("orderID").alias("_n"), F.sum("total").alias("_total"))
    )
    # Squares of a very busy customer's count outgrow a long.
    count = F.col("_n").cast("decimal(14,0)")
    per_week = per_customer.groupBy("_week").agg(
        F.sum("_n").alias("_orders"), F.sum(count * count).alias("_squares"), F.sum("_total").alias("_total")
    )
    return per_week.select(
        calendar.year_week_label(F.col("_week")).alias("week"),
        money_average(F.col("_total"), F.col("_orders")).alias("avg_order_value"),
        exact_ratio(F.col("_squares"), F.col("_orders"), 4, whole_digits=28).alias("avg_order_count_per_customer"),
    ).orderBy("week")


def top_customers_filtered(tables: SalesTables, box: Box, year: Any = None) -> DataFrame:
    """The 25 customers with most orders at stores inside the box, with the date of their first one."""
    per_customer = (
        _orders_in_box(tables, box, year)
        .groupBy("customerID")
        .agg(F.count("orderID").alias("order_count"), F.min("adjustedOrderDate").alias("first_order_date"))
    )
    known = per_customer.join(tables.customers.select("customerID"), "customerID")
    return (
        known.select(F.col("customerID").alias("customer_id"), "order_count", "first_order_date")
        .orderBy(F.desc("order_count"), "customer_id")
        .limit(25)
    )


# Months the visits are spread over, and the visits per month that separate the buckets.
LOYALTY_MONTHS = 12.0
LOYALTY_LIMITS = (15, 10, 5)


def customer_loyalty(
    tables: SalesTables,
    box: Box,
    year: Any = None,
    months: float = LOYALTY_MONTHS,
    limits: tuple[float, float, float] = LOYALTY_LIMITS,
) -> DataFrame:
    """Customers per store by visits per month, in four buckets.

    The buckets keep their names under other ``limits``; the last one includes its upper limit.
    """
    visits = (
        _orders_in_box(tables, box, year)
        .groupBy("customerID", "storeID")
        .agg(F.count("orderID").alias("_visits"))
    )
    high, middle, low = (F.col("_visits") > limit * months for limit in limits)
    return visits.groupBy("storeID").agg(
        F.count_if(high).alias("more_than_15"),
        F.count_if(middle & ~high).alias("more_than_10"),
        F.count_if(low & ~middle).alias("more_than_5"),
        F.count_if(~low).alias("less_than_5"),
    )


def customers_per_state(tables: SalesTables) -> DataFrame:
    """Customers within half a degree of a store, by the store's state; near several stores counts several times."""
    return nearby_pair_counts(tables.customers, tables.stores, "state", NEARBY_DEGREES).withColumnRenamed(
        "pairs", "customerCount"
    )


def stores_per_state(tables: SalesTables) -> DataFrame:
    return tables.stores.groupBy("state").agg(F.count("storeID").alias("storeCount")).orderBy("state")
