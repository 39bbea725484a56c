"""The pre-aggregated tables behind the reports.

Most of them are sums over order items or orders, described by :class:`SumRollup`; :func:`rollup` computes one at its
full grain or at any coarser one, straight from the facts or by adding up a stored copy. The others (averages, distinct
counts, rankings) have a builder of their own.

What a rollup's columns are called is given; how they are derived is this library's reading of the names:

* sales are order items joined with their order and product, revenue is quantity times unit price, profit is quantity times
  (unit price - production cost);
* ``week`` next to ``month`` is the week of the month (days 1-7 are week 1), ``YYYY-uu`` weeks start on Monday;
* calendar parts are those of the order time as stored, except where a rollup says local time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import calendar
from tallyhouse.functions.filters import where_equal
from tallyhouse.functions.joins import fits_broadcast, join_shuffled
from tallyhouse.functions.numbers import PRICE, exact_ratio, money_average, price_units, sum_of_units
from tallyhouse.functions.periods import (
    DAY,
    DAY_OF_MONTH,
    HOUR,
    MONTH,
    MONTH_OF_YEAR,
    WEEK,
    WEEK_OF_MONTH,
    WEEKDAY,
    WEEKDAY_NUMBER,
    YEAR,
    Key,
    item_column,
    order_column,
    order_day,
    product_column,
)
from tallyhouse.functions.spans import DateSpan, calendar_span, week_of_month_span
from tallyhouse.sources.tables import SalesTables


@dataclass(frozen=True)
class SumRollup:
    """``keys`` by output column; ``measures`` maps an output column to the name of a measure.

    ``derived`` are further keys that follow from the day, which the rollup has in its column ``day``.
    """

    keys: Mapping[str, Key]
    measures: Mapping[str, str]
    derived: Mapping[str, Key] = field(default_factory=dict)
    day: str = "orderDate"

    def key(self, name: str) -> Key:
        return self.keys[name] if name in self.keys else self.derived[name]

    def reads(self, table: str, names: Iterable[str]) -> bool:
        return any(self.key(name).table == table for name in names)


ITEM_SALES = "item_sales"
STORE = order_column("storeID")
PERIOD_OF_STORE = {"storeID": STORE, "year": YEAR, "month": MONTH_OF_YEAR, "week": WEEK_OF_MONTH}

SUM_ROLLUPS: dict[str, SumRollup] = {
    "store_pizza_sales": SumRollup(
        {"storeID": STORE, "SKU": item_column("SKU"), "orderDate": DAY},
        {"Quantity": "quantity"},
        derived={"orderMonth": MONTH},
    ),
    "OrdersPerWeekday": SumRollup({"Weekday": WEEKDAY, "storeID": STORE}, {"NumberOfOrders": "orders"}),
    "order_activity": SumRollup(
        {"storeID": STORE, "period": DAY},
        {"order_count": "orders"},
        derived={"month": MONTH, "year": YEAR},
        day="period",
    ),
    "monthly_store_revenue": SumRollup(
        {"storeID": STORE, "orderMonth": MONTH}, {"totalRevenue": "revenue", "totalProfit": "profit"}
    ),
    "PizzaSalesSummary": SumRollup(
        {"storeID": STORE, "Category": product_column("Category")}, {"NumberOfPizzasSold": "quantity"}
    ),
    "daily_store_pizza_sales": SumRollup(
        {"orderDate": DAY, "ProductName": product_column("Name"), "storeID": STORE},
        {"Quantity": "quantity"},
        derived={"Weekday": WEEKDAY_NUMBER},
    ),
    "weekly_store_pizza_sales": SumRollup(
        {"yearWeek": WEEK, "PizzaName": product_column("Name"), "storeID": STORE}, {"Quantity": "quantity"}
    ),
    "top_customers_per_store": SumRollup(
        {"storeID": STORE, "customerID": order_column("customerID")}, {"total_spent": "spent"}
    ),
    "product_order_frequency": SumRollup(
        {"ProductName": product_column("Name"), "Category": product_column("Category")}, {"Frequency": "lines"}
    ),
    "total_items_sold": SumRollup(
        {"storeID": STORE, "Name": product_column("Name"), "size": product_column("Size")},
        {"total_items_sold_per_store": "quantity"},
    ),
    "daily_store_pizza_sales_with_size": SumRollup(
        {"orderDate": DAY, "Size": product_column("Size"), "storeID": STORE}, {"Quantity": "quantity"}
    ),
    "weekly_order_counts": SumRollup(
        {"storeID": STORE, "weekday": WEEKDAY, "year": YEAR, "month": MONTH_OF_YEAR}, {"order_count": "orders"}
    ),
    "order_activity_per_month": SumRollup(
        {"storeID": STORE, "year": YEAR, "month": MONTH_OF_YEAR}, {"order_count": "orders"}
    ),
    "order_activity_per_hour": SumRollup(
        {"storeID": STORE, "year": YEAR, "month": MONTH_OF_YEAR, "day": DAY_OF_MONTH, "hour": HOUR},
        {"order_count": "orders"},
    ),
    "monthly_product_sales": SumRollup(
        {"product_name": product_column("Name"), "year": YEAR, "month": MONTH_OF_YEAR}, {"total_sales": "revenue"}
    ),
    "store_performance": SumRollup(PERIOD_OF_STORE, {"total_sales": "revenue"}),
    "sales_trends": SumRollup(
        {"storeID": STORE, "year": YEAR, "month": MONTH_OF_YEAR}, {"total_sales": "revenue"}
    ),
    "category_sales": SumRollup(
        {
            **PERIOD_OF_STORE,
            "category": product_column("Category"),
            "product_name": product_column("Name"),
        },
        {"total_sales": "revenue"},
    ),
    "store_profitability": SumRollup(PERIOD_OF_STORE, {"totalRevenue": "revenue", "totalProfit": "profit"}),
    "product_preferences": SumRollup(
        {**PERIOD_OF_STORE, "product_name": product_column("Name")}, {"order_count": "lines"}
    ),
}

ORDER_MEASURES = {"orders": lambda: F.count("orderID"), "spent": lambda: F.sum("total")}

# Over single items: products of small whole numbers.
ITEM_MEASURES: dict[str, Callable[[], Column]] = {
    "quantity": lambda: F.sum("_quantity"),
    "lines": lambda: F.count("*"),
    "revenue": lambda: sum_of_units(F.col("_quantity") * F.col("_price")),
    "profit": lambda: sum_of_units(F.col("_quantity") * F.col("_margin")),
}
# Over items already summed per product, whose quantities may be large.
PRODUCT_MEASURES: dict[str, Callable[[], Column]] = {
    "quantity": lambda: F.sum("_quantity"),
    "lines": lambda: F.sum("_lines"),
    "revenue": lambda: F.sum(F.col("_quantity").cast("decimal(19,0)") * F.col("Price")),
    "profit": lambda: F.sum(F.col("_quantity").cast("decimal(19,0)") * (F.col("Price") - F.col("production_costs"))),
}
PRICED_MEASURES = {"revenue", "profit"}


def rollup(
    tables: SalesTables,
    name: str,
    keys: list[str] | None = None,
    equals: Mapping[str, Any] | None = None,
    within: DateSpan | None = None,
) -> DataFrame:
    """Rollup ``name`` summed to ``keys`` (all of its keys by default) over the rows where ``equals`` holds.

    ``within`` narrows the days that are read from the facts; the caller still filters what a stored rollup returns.

    Summing a sum again gives the same total, so the coarser grain is computed directly and the fine-grained table is
    never shuffled just to be added up.
    """
    spec = SUM_ROLLUPS[name]
    keys = list(spec.keys) if keys is None else keys
    equals = equals or {}
    span = _span(spec, equals)
    span = within if span is None else span.both(within)
    if name in tables.rollups:
        return _from_stored(tables.rollups[name], spec, keys, equals, span)
    if any(measure in ORDER_MEASURES for measure in spec.measures.values()):
        return _from_orders(tables, spec, keys, equals, span)
    return _from_sales(tables, spec, keys, equals, span)


#: The column that stored rollups without ``year`` and ``month`` are partitioned by.
STORED_YEAR = "_year"


def pruned(stored: DataFrame, span: DateSpan | None, day: str | None = None) -> DataFrame:
    """A stored rollup without the year partitions and, if it has the date column ``day``, the days outside a range."""
    if span is None:
        return stored
    if STORED_YEAR in stored.columns:
        stored = stored.filter(span.touches_year(F.col(STORED_YEAR)))
    return stored.filter(span.contains_day(F.col(day))) if day in stored.columns else stored


def _from_stored(
    stored: DataFrame, spec: SumRollup, keys: list[str], equals: Mapping[str, Any], span: DateSpan | None
) -> DataFrame:
    stored = pruned(stored, span, spec.day)
    equals = {name: spec.key(name).stored(value) for name, value in equals.items()}
    for name in {*keys, *equals} - set(spec.keys):
        key = spec.derived[name]
        stored = stored.withColumn("orderDate", F.col(spec.day)).withColumn(name, key.label(key.compact()))
    kept = where_equal(stored, equals)
    if set(keys) == set(spec.keys):
        return kept.select(*keys, *spec.measures)
    return kept.groupBy(*keys).agg(*[F.sum(measure).alias(measure) for measure in spec.measures])


def _span(spec: SumRollup, equals: Mapping[str, Any]) -> DateSpan | None:
    """The range of days the equality arguments imply, to be pushed into the scan of the orders."""
    if "year" in equals:
        if "month" in equals and "week" in equals:
            return week_of_month_span(equals["year"], equals["month"], equals["week"])
        return calendar_span(equals["year"], equals.get("month"))
    for name, value in equals.items():
        if spec.key(name).span is not None:
            return spec.key(name).span(value)
    return None


def _compact(key: str) -> str:
    return f"_key_{key}"


def _keep(df: DataFrame, spec: SumRollup, table: str, equals: Mapping[str, Any]) -> DataFrame:
    for name, value in equals.items():
        key = spec.key(name)
        if key.table == table:
            df = df.filter(key.compact() == F.lit(key.parse(value)))
    return df


def _compact_columns(spec: SumRollup, table: str, keys: list[str]) -> list[Column]:
    return [spec.key(key).compact().alias(_compact(key)) for key in keys if spec.key(key).table == table]


def _labelled(summed: DataFrame, spec: SumRollup, keys: list[str]) -> DataFrame:
    labels = [spec.key(key).label(F.col(_compact(key))).alias(key) for key in keys]
    return summed.select(*labels, *spec.measures)


def _from_orders(
    tables: SalesTables, spec: SumRollup, keys: list[str], equals: Mapping[str, Any], span: DateSpan | None
) -> DataFrame:
    hours = tables.rollups.get(ORDER_HOURS)
    if hours is not None and set(spec.measures.values()) == {"orders"}:
        counted = _keep(_stored_hours(hours, span), spec, "orders", equals)
        keyed = counted.select(*_compact_columns(spec, "orders", keys), "orders")
        sums = [F.sum("orders").alias(column) for column in spec.measures]
        return _labelled(keyed.groupBy(*map(_compact, keys)).agg(*sums), spec, keys)
    orders = _keep(tables.orders(span), spec, "orders", equals)
    measures = [ORDER_MEASURES[measure]().alias(column) for column, measure in spec.measures.items()]
    keyed = orders.select(*_compact_columns(spec, "orders", keys), "orderID", "total")
    return _labelled(keyed.groupBy(*map(_compact, keys)).agg(*measures), spec, keys)


def _from_sales(
    tables: SalesTables, spec: SumRollup, keys: list[str], equals: Mapping[str, Any], span: DateSpan | None
) -> DataFrame:
    touched = [*keys, *equals]
    stored = tables.rollups.get(ITEM_SALES)
    if stored is None and not (spec.reads("items", touched) or spec.reads("products", touched)):
        summed = _summed_per_order(tables, spec, keys, equals, span)
        if summed is not None:
            return _labelled(summed, spec, keys)
    if stored is not None:
        sales, measures = _stored_item_sales(stored, spec, keys, equals, span), PRODUCT_MEASURES
    else:
        measures = ITEM_MEASURES
        joined = spec.reads("orders", touched)
        sales = _keep(tables.items(span if joined else None), spec, "items", equals).select(
            "orderID", "SKU", *_compact_columns(spec, "items", keys), F.col("Quantity").alias("_quantity")
        )
        if joined:
            orders = _keep(tables.orders(span), spec, "orders", equals)
            all_orders = span is None and not spec.reads("orders", equals)
            keyed = orders.select("orderID", *_compact_columns(spec, "orders", keys))
            sales = join_shuffled(sales, keyed, "orderID", tables.order_bytes if all_orders else None)
    priced = any(measure in PRICED_MEASURES for measure in spec.measures.values())
    if priced or spec.reads("products", touched):
        price, cost = F.col("Price").cast(PRICE), F.col("production_costs").cast(PRICE)
        products = _keep(tables.products, spec, "products", equals).select(
            "SKU",
            *_compact_columns(spec, "products", keys),
            price.alias("Price"),
            cost.alias("production_costs"),
            price_units(price).alias("_price"),
            price_units(price - cost).alias("_margin"),
        )
        if fits_broadcast(products, tables.dimension_bytes.get("products")):
            sales = sales.join(F.broadcast(products), "SKU")
        else:
            if stored is None:
                sales, measures = _summed_per_product(sales, spec, keys), PRODUCT_MEASURES
            all_products = not spec.reads("products", equals)
            sales = join_shuffled(sales, products, "SKU", tables.dimension_bytes.get("products") if all_products else None)
    sums = [measures[measure]().alias(column) for column, measure in spec.measures.items()]
    return _labelled(sales.groupBy(*map(_compact, keys)).agg(*sums), spec, keys)


def _summed_per_order(
    tables: SalesTables, spec: SumRollup, keys: list[str], equals: Mapping[str, Any], span: DateSpan | None
) -> DataFrame | None:
    """Sums by order columns alone: items are added up per order before they meet the orders, so an order is one row however many
    items it has. None where that needs prices of products too many to broadcast, or no order is read."""
    if not spec.reads("orders", [*keys, *equals]):
        return None
    items = tables.items(span).select("orderID", "SKU", F.col("Quantity").alias("_quantity"))
    if any(measure in PRICED_MEASURES for measure in spec.measures.values()):
        price, cost = F.col("Price").cast(PRICE), F.col("production_costs").cast(PRICE)
        products = tables.products.select("SKU", price_units(price).alias("_price"), price_units(price - cost).alias("_margin"))
        if not fits_broadcast(products, tables.dimension_bytes.get("products")):
            return None
        items = items.join(F.broadcast(products), "SKU")
    elif "quantity" not in spec.measures.values():
        return None
    per_order = items.groupBy("orderID").agg(
        *(ITEM_MEASURES[measure]().alias(f"_{column}") for column, measure in spec.measures.items())
    )
    orders = _keep(tables.orders(span), spec, "orders", equals)
    met = per_order.join(orders.select("orderID", *_compact_columns(spec, "orders", keys)), "orderID")
    sums = [F.sum(f"_{column}").cast(per_order.schema[f"_{column}"].dataType).alias(column) for column in spec.measures]
    return met.groupBy(*map(_compact, keys)).agg(*sums)


ORDER_HOURS = "order_hours"


def order_hours(tables: SalesTables) -> DataFrame:
    """Orders, their items and their total per store, day and hour.

    Not a report: stored, it serves every count of orders and all three grains of order statistics.
    """
    items = tables.order_items.groupBy("orderID").agg(F.sum("Quantity").alias("_items"))
    return (
        tables.orders()
        .select("orderID", "storeID", "total", order_day().alias("day"), F.hour("orderDate").alias("hour"))
        .join(items, "orderID", "left")
        .groupBy("storeID", "day", "hour")
        .agg(
            F.count("orderID").alias("orders"),
            F.sum(F.coalesce("_items", F.lit(0))).alias("items"),
            F.sum("total").alias("total"),
            F.count("total").alias("totals"),
        )
        .withColumn("year", F.year("day"))
    )


def _stored_hours(hours: DataFrame, span: DateSpan | None) -> DataFrame:
    """Stored hours with an ``orderDate``, so that every calendar key can be taken from them."""
    if span is not None:
        hours = hours.filter(span.touches_year(F.col("year")) & span.contains_day(F.col("day")))
    zero = F.lit(0)
    moment = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(zero, F.col("hour"), zero, zero)
    return hours.drop("year").withColumn("orderDate", moment)


def item_sales(tables: SalesTables) -> DataFrame:
    """Quantity and number of items per store, product and day.

    Not a report: the one join of items with orders that every sales rollup can be added up from once it is stored.
    """
    orders = tables.orders().select("orderID", "storeID", order_day().alias("orderDate"))
    items = tables.order_items.select("orderID", "SKU", "Quantity")
    return (
        join_shuffled(items, orders, "orderID", tables.order_bytes)
        .groupBy("storeID", "SKU", "orderDate")
        .agg(F.sum("Quantity").alias("Quantity"), F.count("*").alias("Lines"))
        .withColumn("year", F.year("orderDate"))
    )


def _stored_item_sales(
    stored: DataFrame, spec: SumRollup, keys: list[str], equals: Mapping[str, Any], span: DateSpan | None
) -> DataFrame:
    if span is not None:
        stored = stored.filter(span.touches_year(F.col("year")) & span.contains_day(F.col("orderDate")))
    for table in ("orders", "items"):
        stored = _keep(stored, spec, table, equals)
    return stored.select(
        "SKU",
        *_compact_columns(spec, "orders", keys),
        *_compact_columns(spec, "items", keys),
        F.col("Quantity").alias("_quantity"),
        F.col("Lines").alias("_lines"),
    )


def _summed_per_product(sales: DataFrame, spec: SumRollup, keys: list[str]) -> DataFrame:
    """Items added up per product and group, for products too many to broadcast.

    A best-seller then enters the join with one row per group instead of one per item.
    """
    own_keys = [_compact(key) for key in keys if spec.key(key).table != "products"]
    return sales.groupBy("SKU", *own_keys).agg(F.sum("_quantity").alias("_quantity"), F.count("*").alias("_lines"))


# --- order statistics -------------------------------------------------------------------------------------------------

GRAINS: dict[str, tuple[str, Key]] = {"daily": ("orderDate", DAY), "weekly": ("weekYear", WEEK), "monthly": ("monthYear", MONTH)}


def order_stats(
    tables: SalesTables, grain: str, period: Any = None, span: DateSpan | None = None
) -> DataFrame:
    """Per store and period: number of orders, items sold, average order value.

    ``period`` chooses one period. ``span`` limits the days and should begin and end with whole periods.
    Items are added up per order before the join, so an order's total counts once however many items it has; orders
    without items count with zero items.
    """
    column, key = GRAINS[grain]
    name = f"{grain}_store_order_stats"
    days = span if period is None else key.span(period)
    shown = ("storeID", column, "NumberOfOrders", "TotalItemsSold", "AverageOrderValue")
    if name in tables.rollups:
        stored = pruned(tables.rollups[name], days, column if grain == "daily" else None)
        return where_equal(stored, {} if period is None else {column: key.stored(period)}).select(*shown)
    if ORDER_HOURS in tables.rollups:
        summed = (
            _stored_hours(tables.rollups[ORDER_HOURS], days)
            .groupBy("storeID", key.compact().alias("_period"))
            .agg(*(F.sum(c).alias(f"_{c}") for c in ("orders", "items", "total", "totals")))
        )
        return summed.select(
            "storeID",
            key.label(F.col("_period")).alias(column),
            F.col("_orders").alias("NumberOfOrders"),
            F.col("_items").alias("TotalItemsSold"),
            money_average(F.col("_total"), F.col("_totals")).cast("decimal(22,6)").alias("AverageOrderValue"),
        )
    orders = tables.orders(days).select(
        "orderID", "storeID", "total", key.compact().alias("_period")
    )
    items = tables.items(days).groupBy("orderID").agg(F.sum("Quantity").alias("_items"))
    return (
        orders.join(items, "orderID", "left")
        .groupBy("storeID", "_period")
        .agg(
            F.count("orderID").alias("NumberOfOrders"),
            F.sum(F.coalesce("_items", F.lit(0))).alias("TotalItemsSold"),
            F.avg("total").alias("AverageOrderValue"),
        )
        .select(
            "storeID",
            key.label(F.col("_period")).alias(column),
            "NumberOfOrders",
            "TotalItemsSold",
            "AverageOrderValue",
        )
    )


# --- the rest ---------------------------------------------------------------------------------------------------------


def _stored_or(tables: SalesTables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return tables.rollups[name] if name in tables.rollups else build()


def unique_customers_per_store(tables: SalesTables) -> DataFrame:
    def build() -> DataFrame:
        if "top_customers_per_store" in tables.rollups:  # a row for each customer of a store
            return tables.rollups["top_customers_per_store"].groupBy("storeID").agg(F.count("customerID").alias("uniqueCustomers"))
        customers = F.count_distinct("customerID").alias("uniqueCustomers")
        return tables.orders().groupBy("storeID").agg(customers)

    return _stored_or(tables, "unique_customers_per_store", build)


def top_order_dates(tables: SalesTables, top_n: int | None = None) -> DataFrame:
    """Orders per store and day with the day's holiday; ``top_n`` keeps the busiest days of each store."""

    def build() -> DataFrame:
        if ORDER_HOURS in tables.rollups:
            hours = tables.rollups[ORDER_HOURS]
            days = hours.groupBy(F.col("day").alias("OrderDate"), "storeID").agg(F.sum("orders").alias("TotalOrders"))
        else:
            days = tables.orders().groupBy(order_day().alias("OrderDate"), "storeID").agg(F.count("orderID").alias("TotalOrders"))
        return (
            days.withColumn("HolidayName", calendar.holiday_name(F.col("OrderDate")))
        )

    days = _stored_or(tables, "TopOrderDates", build).select("OrderDate", "storeID", "TotalOrders", "HolidayName")
    if top_n is None:
        return days
    busiest_first = Window.partitionBy("storeID").orderBy(F.desc("TotalOrders"), "OrderDate")
    return days.withColumn("_place", F.row_number().over(busiest_first)).filter(F.col("_place") <= top_n).drop("_place")


HOURS = range(24)


def _hours_per_day(orders: DataFrame, moment: str) -> DataFrame:
    """Orders of each hour, a column each, per store and day; ``hnull`` counts orders without a time."""
    hour = F.hour(moment)
    counts = [F.count_if(hour == h).alias(f"h{h}") for h in HOURS]
    return orders.groupBy("storeID", F.to_date(moment).alias("_day")).agg(*counts, F.count_if(hour.isNull()).alias("hnull"))


def _average_per_hour(per_day: DataFrame) -> DataFrame:
    """Orders of each hour divided by the days on which the store had any order, from one row per store and day."""
    columns = [*(f"h{h}" for h in HOURS), "hnull"]
    per_store = per_day.groupBy("storeID").agg(*(F.sum(c).alias(c) for c in columns), F.count("_day").alias("_days"))
    hours = [F.struct(F.lit(h).alias("Hour"), F.col(f"h{h}").alias("_orders")) for h in HOURS]
    hours.append(F.struct(F.lit(None).cast("int").alias("Hour"), F.col("hnull").alias("_orders")))
    average = exact_ratio(F.col("_orders"), F.col("_days"), 4).alias("AvgOrdersPerHour")
    return per_store.select("storeID", "_days", F.inline(F.array(*hours))).filter("_orders > 0").select("Hour", "storeID", average)


def _stored_hours_per_day(hours: DataFrame) -> DataFrame:
    counts = [F.sum(F.when(F.col("hour") == h, F.col("orders")).otherwise(0)).alias(f"h{h}") for h in HOURS]
    no_hour = F.sum(F.when(F.col("hour").isNull(), F.col("orders")).otherwise(0)).alias("hnull")
    return hours.groupBy("storeID", F.col("day").alias("_day")).agg(*counts, no_hour)


def _local(per_day: DataFrame, tables: SalesTables) -> DataFrame:
    """Hours per local day: a store's zone moves each hour of a day by whole hours, some of them to the day before or after."""
    zones = tables.stores.select("storeID", tables.zone_hours().alias("_shift"))
    shifted = tables.join_stores(per_day, zones, ["_day"])
    counts = F.array(*(F.col(f"h{h}") for h in HOURS))
    moved = shifted.select("storeID", "_day", "_shift", "hnull", F.posexplode(counts).alias("_hour", "_orders")).filter(
        (F.col("_orders") > 0) | ((F.col("_hour") == 0) & (F.col("hnull") > 0))
    )
    at = F.col("_hour") + F.col("_shift")
    local_day, local_hour = F.date_add("_day", F.floor(at / 24).cast("int")), F.pmod(at, F.lit(24))
    counted = [F.sum(F.when(local_hour == h, F.col("_orders")).otherwise(0)).alias(f"h{h}") for h in HOURS]
    no_hour = F.sum(F.when(F.col("_hour") == 0, F.col("hnull")).otherwise(0)).alias("hnull")
    return moved.groupBy("storeID", local_day.alias("_day")).agg(*counted, no_hour)


def avg_orders_per_hour(tables: SalesTables) -> DataFrame:
    """By local time of the store."""

    def build() -> DataFrame:
        if tables.extended is not None:
            return _average_per_hour(_hours_per_day(tables.extended_orders(), "adjustedOrderDate"))
        return _average_per_hour(_local(_per_day(tables), tables))

    return _stored_or(tables, "AvgOrdersPerHour", build)


def _per_day(tables: SalesTables) -> DataFrame:
    hours = tables.rollups.get(ORDER_HOURS)
    return _hours_per_day(tables.orders(), "orderDate") if hours is None else _stored_hours_per_day(hours)


def avg_orders_per_hour_utc(tables: SalesTables) -> DataFrame:
    return _stored_or(tables, "AvgOrdersPerHourUTC", lambda: _average_per_hour(_per_day(tables)))


def pizza_profit_analysis(tables: SalesTables) -> DataFrame:
    """Unit profit per product."""

    def build() -> DataFrame:
        profit = F.col("Price") - F.col("production_costs")
        return tables.products.select(
            "SKU", "Name", "Size", "Price", F.col("production_costs").alias("production_cost"), profit.alias("profit")
        )

    return _stored_or(tables, "pizza_profit_analysis", build)


def _sum_builder(name: str) -> Callable[[SalesTables], DataFrame]:
    return lambda tables: rollup(tables, name)


def _stats_builder(grain: str) -> Callable[[SalesTables], DataFrame]:
    return lambda tables: order_stats(tables, grain)


ROLLUPS: dict[str, Callable[[SalesTables], DataFrame]] = {
    **{name: _sum_builder(name) for name in SUM_ROLLUPS},
    **{f"{grain}_store_order_stats": _stats_builder(grain) for grain in GRAINS},
    "unique_customers_per_store": unique_customers_per_store,
    "TopOrderDates": top_order_dates,
    "AvgOrdersPerHour": avg_orders_per_hour,
    "AvgOrdersPerHourUTC": avg_orders_per_hour_utc,
    "pizza_profit_analysis": pizza_profit_analysis,
}
