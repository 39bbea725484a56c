"""Reshaping report rows into the series, matrices and shares that charts show."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import SEASON_MONTHS
from tallyhouse.functions.joins import join_dimension
from tallyhouse.functions.numbers import percentage

MONTHLY_MEASURES = ("total_sales", "totalRevenue", "totalProfit")


def sales_by_month(rows: DataFrame) -> DataFrame:
    """Those of the money columns that ``rows`` has, per month, labelled like ``Mar 1998`` and in order of time."""
    sums = [F.sum(name).alias(name) for name in MONTHLY_MEASURES if name in rows.columns]
    label = F.date_format(F.make_date("year", "month", F.lit(1)), "MMM yyyy")
    months = rows.groupBy("year", "month").agg(*sums).withColumn("date", label)
    present = [name for name in MONTHLY_MEASURES if name in rows.columns]
    return months.select("year", "month", "date", *present).orderBy("year", "month")


def profit_split_by_month(rows: DataFrame) -> DataFrame:
    """Monthly revenue split into profit and the rest."""
    months = sales_by_month(rows)
    return months.select(
        "date", F.col("totalProfit").alias("profit"), (F.col("totalRevenue") - F.col("totalProfit")).alias("other_revenue")
    )


def names_of(dimension: DataFrame, column: str) -> list[str]:
    """The different values of a dimension's column, in order, to be the columns of a matrix; at most ``spark.sql.pivotMaxValues``."""
    most = int(dimension.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    names = [row[0] for row in dimension.select(_shown(column)).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} different values of {column} cannot be columns")
    return sorted(names)


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null")).alias(column)


def _matrix(rows: DataFrame, row: str, column: str, value: str, columns: Sequence[Any] | None) -> DataFrame:
    """Sums per ``row`` and ``column``. A value that is not among given ``columns`` fails the query: no sum is left out."""
    shown = _shown(column)
    if columns is not None:
        complaint = F.raise_error(F.concat(F.lit(f"no column for {column} "), shown)).cast("string")
        shown = F.when(shown.isin(list(columns)), shown).otherwise(complaint).alias(column)
    pivot = rows.select(row, shown, value).groupBy(row).pivot(column, None if columns is None else list(columns)).agg(F.sum(value))
    return pivot.select(row, *[F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(name) for name in pivot.columns if name != row])


def category_product_matrix(rows: DataFrame, products: Sequence[str] | None = None) -> DataFrame:
    """Sales per category (rows) and product (columns), zero where there are none.

    Without ``products`` the column names are looked up first, in a job of their own that Spark limits to
    ``spark.sql.pivotMaxValues`` names.
    """
    return _matrix(rows, "category", "product_name", "total_sales", products)


def store_category_matrix(rows: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Units sold per store (rows) and category (columns), zero where there are none."""
    return _matrix(rows, "storeID", "Category", "NumberOfPizzasSold", categories)


def holiday_orders_per_store(rows: DataFrame) -> DataFrame:
    """Orders on holidays per store, with the alphabetically first holiday among them."""
    return rows.groupBy("storeID").agg(
        F.sum("TotalOrders").alias("total_orders"), F.min("HolidayName").alias("holiday")
    )


def seasonal_totals(rows: DataFrame) -> DataFrame:
    """Orders per season; all four seasons are listed."""
    totals = rows.groupBy(F.col("Season").alias("season")).agg(F.sum("TotalOrders").alias("_orders"))
    seasons = rows.sparkSession.createDataFrame([(name,) for name in SEASON_MONTHS], "season string")
    return seasons.join(totals, "season", "left").select(
        "season", F.coalesce("_orders", F.lit(0)).cast("bigint").alias("total_orders")
    )


def share_of_total(rows: DataFrame, value: str, series: str | None = None) -> DataFrame:
    """Adds each row's percentage of the total of its series, or of all rows.

    Totals are aggregated and joined back rather than taken over a window, which would bring a whole series into one
    task; the join spreads a series over several.
    """
    if series is None:
        total = rows.agg(F.sum(value)).scalar()
        return rows.withColumn("percentage", percentage(F.col(value), total))
    marked = rows.withColumn("_series", _shown(series)).withColumn("_none", F.col(series).isNull())
    totals = marked.groupBy("_series", "_none").agg(F.sum(value).alias("_total"))
    # All rows of a busy series meet one total: they are spread over tasks unless the totals can be broadcast.
    joined = join_dimension(marked, totals, ["_series", "_none"], rows.columns)
    return joined.withColumn("percentage", percentage(F.col(value), F.col("_total"))).drop("_series", "_none", "_total")


# Labels of the loyalty buckets by column.
LOYALTY_LABELS = {
    "more_than_15": "> 15 Orders",
    "more_than_10": "> 10 Orders",
    "more_than_5": "> 5 Orders",
    "less_than_5": "< 5 Orders",
}
LOYALTY_STORE_ROWS = 5


def loyalty_profile(rows: DataFrame) -> DataFrame:
    """Loyalty buckets as (storeID, bucket, value) rows.

    Up to five stores are listed one by one; for more of them there is one row per bucket, the mean over stores, with a
    NULL store. Which of the two holds is decided inside the plan from the number of stores.
    """
    buckets = F.array(
        *[F.struct(F.lit(label).alias("bucket"), F.col(name).alias("value")) for name, label in LOYALTY_LABELS.items()]
    )
    long = rows.select("storeID", F.inline(buckets))
    totals = long.groupBy("bucket").agg(F.sum("value").alias("_sum"), F.count("*").alias("_stores"))
    # Taking the sum along keeps this subquery's plan equal to the main one, so Spark runs the aggregation once.
    stores = totals.agg(F.max(F.struct("_stores", "_sum")).getField("_stores")).scalar()
    means = totals.filter(F.col("_stores") > LOYALTY_STORE_ROWS).select(
        F.lit(None).cast(rows.schema["storeID"].dataType).alias("storeID"),
        "bucket",
        (F.col("_sum") / F.col("_stores")).alias("value"),
    )
    single = long.filter(stores <= LOYALTY_STORE_ROWS).withColumn("value", F.col("value").cast("double"))
    return means.unionByName(single)
