"""The five base tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions.joins import SALTS, join_dimension
from tallyhouse.functions.spans import DateSpan

_MONEY = T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "stores": _schema(
        storeID=T.StringType(),
        latitude=T.DoubleType(),
        longitude=T.DoubleType(),
        city=T.StringType(),
        state=T.StringType(),
    ),
    "customers": _schema(customerID=T.StringType(), latitude=T.DoubleType(), longitude=T.DoubleType()),
    "products": _schema(
        SKU=T.StringType(),
        Name=T.StringType(),
        Price=_MONEY,
        Category=T.StringType(),
        Size=T.StringType(),
        Ingredients=T.StringType(),
        production_costs=T.DecimalType(18, 4),
    ),
    "orders": _schema(
        orderID=T.LongType(),
        customerID=T.StringType(),
        storeID=T.StringType(),
        orderDate=T.TimestampNTZType(),
        total=_MONEY,
    ),
    "orderItems": _schema(
        orderItemID=T.LongType(), orderID=T.LongType(), SKU=T.StringType(), Quantity=T.LongType()
    ),
}

EXTENDED_ORDERS = "extendedorders"
SCHEMAS_OF_EXTENDED = _schema(
    orderID=T.LongType(), customerID=T.StringType(), storeID=T.StringType(), total=_MONEY, adjustedOrderDate=T.TimestampNTZType()
)

MAX_ZONE_SHIFT_DAYS = 1


@dataclass(frozen=True)
class SalesTables:
    """Base tables, plus stored rollups that operators read instead of the facts when they are given.

    ``order_source(span)`` returns the orders of a range of days (all of them for ``None``), so that a source can push the
    range into its own scan. ``item_source(span)``, where given, returns items that include all of the orders of those days. ``dimension_bytes`` states the size of a dimension where the estimate of its plan
    would be far off, as for one that is itself a join.

    ``extended`` are stored orders with their local time ``adjustedOrderDate``; without them it is computed from the store's
    longitude. ``order_bytes`` is the size of all orders where they are shuffled to meet the items, None where it is unknown or they
    need no shuffle. ``salts`` is over how many tasks a busy store is spread in a join with stores too many to broadcast.

    Keys are unique in stores, customers, products and orders, and every order item names an existing order and
    product.
    """

    stores: DataFrame
    customers: DataFrame
    products: DataFrame
    order_items: DataFrame
    order_source: Callable[[DateSpan | None], DataFrame]
    dimension_bytes: Mapping[str, int] = field(default_factory=dict)
    rollups: Mapping[str, DataFrame] = field(default_factory=dict)
    extended: DataFrame | None = None
    salts: int = SALTS
    item_source: Callable[[DateSpan | None], DataFrame] | None = None
    order_bytes: int | None = None

    @classmethod
    def from_frames(
        cls,
        stores: DataFrame,
        customers: DataFrame,
        products: DataFrame,
        orders: DataFrame,
        order_items: DataFrame,
        extended: DataFrame | None = None,
    ) -> SalesTables:
        def order_source(span: DateSpan | None) -> DataFrame:
            return orders if span is None else orders.filter(span.contains(F.col("orderDate")))

        return cls(stores, customers, products, order_items, order_source, extended=extended)

    def with_rollups(self, rollups: Mapping[str, DataFrame]) -> SalesTables:
        return replace(self, rollups={**self.rollups, **rollups})

    def orders(self, span: DateSpan | None = None) -> DataFrame:
        return self.order_source(span)

    def items(self, span: DateSpan | None = None) -> DataFrame:
        """Items to be joined with ``orders(span)``: all of theirs, and maybe others."""
        return self.order_items if span is None or self.item_source is None else self.item_source(span)

    def sold_orders(self) -> DataFrame:
        """Orders that have at least one item.

        Item rows are reduced to their order keys before the shuffle, so an order with very many items weighs no more than
        another in the join.
        """
        return self.orders().join(self.order_items.select("orderID").distinct(), "orderID", "left_semi")

    def join_stores(self, fact: DataFrame, stores: DataFrame, spread: list[str] | None = None) -> DataFrame:
        """Inner join with all stores, or with some of them, whose size is then estimated anew."""
        size = self.dimension_bytes.get("stores")
        return join_dimension(fact, stores, "storeID", spread, size, self.salts)

    def zone_hours(self) -> Column:
        """By how many hours a store's local time differs, from its longitude."""
        return F.floor(F.col("longitude") / 15).cast("int")

    def extended_orders(self, span: DateSpan | None = None, stores: DataFrame | None = None) -> DataFrame:
        """Orders with ``adjustedOrderDate``: as stored, else the order time shifted to the zone of the store's longitude.

        ``span`` limits the adjusted date. ``stores`` may be a filtered subset of the stores; orders of the others drop out.
        """
        chosen = self.stores if stores is None else stores
        if self.extended is not None:
            kept = self.extended if span is None else self.extended.filter(span.contains(F.col("adjustedOrderDate")))
            kept = kept.select("orderID", "customerID", "storeID", "total", "adjustedOrderDate")
            return kept if stores is None else self.join_stores(kept, chosen.select("storeID"), ["orderID"])
        zones = chosen.select("storeID", self.zone_hours().alias("_shift"))
        around = None if span is None else span.widened(MAX_ZONE_SHIFT_DAYS)
        zero = F.lit(0)
        extended = self.join_stores(self.orders(around), zones, ["orderID"]).select(
            "orderID",
            "customerID",
            "storeID",
            "total",
            (F.col("orderDate") + F.make_dt_interval(zero, F.col("_shift"), zero, zero)).alias("adjustedOrderDate"),
        )
        return extended if span is None else extended.filter(span.contains(F.col("adjustedOrderDate")))
