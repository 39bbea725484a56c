"""Retail sales analytics as Spark DataFrame operators.

Every operator takes a :class:`~tallyhouse.sources.tables.SalesTables` (stores, customers, products,
orders, order items) and returns a lazy ``DataFrame``; nothing is collected on the driver.
"""

from tallyhouse.sources.tables import SalesTables

__all__ = ["SalesTables"]
