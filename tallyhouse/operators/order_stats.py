"""Order statistics per store and day, week or month; ``grain`` is ``daily``, ``weekly`` or ``monthly``.

Averages here weigh every store-period row alike, as an average of averages does.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.filters import given
from tallyhouse.functions.numbers import count_average
from tallyhouse.functions.spans import year_span
from tallyhouse.operators.rollups import GRAINS, order_stats
from tallyhouse.sources.tables import SalesTables


def stats(tables: SalesTables, grain: str, period: Any = None) -> DataFrame:
    column, _ = GRAINS[grain]
    wanted = given(period=period).get("period")
    return order_stats(tables, grain, wanted).orderBy(column, "storeID")


def average_order_value_per_store(tables: SalesTables, grain: str) -> DataFrame:
    average = F.avg("AverageOrderValue").alias("avgOrderValue")
    return order_stats(tables, grain).groupBy("storeID").agg(average).orderBy("storeID")


def order_intensity(tables: SalesTables, grain: str) -> DataFrame:
    column, _ = GRAINS[grain]
    return order_stats(tables, grain).select("storeID", column, "NumberOfOrders").orderBy(column, "storeID")


def order_trends(tables: SalesTables, grain: str, year: Any = None) -> DataFrame:
    """All stores together per period; ``year`` applies to the daily grain."""
    column, _ = GRAINS[grain]
    wanted = given(year=year).get("year")
    if wanted is not None and grain != "daily":
        raise ValueError("a year can be chosen for daily trends only")
    rows = order_stats(tables, grain, span=None if wanted is None else year_span(wanted))
    return (
        rows.groupBy(column)
        .agg(
            F.sum("NumberOfOrders").alias("totalOrders"),
            F.sum("TotalItemsSold").alias("totalItemsSold"),
            F.avg("AverageOrderValue").alias("avgOrderValue"),
        )
        .orderBy(column)
    )


def store_performance_benchmark(tables: SalesTables, grain: str) -> DataFrame:
    return (
        order_stats(tables, grain)
        .groupBy("storeID")
        .agg(
            count_average(F.col("NumberOfOrders")).alias("avgNumberOfOrders"),
            F.avg("AverageOrderValue").alias("avgOrderValue"),
        )
        .orderBy("storeID")
    )
