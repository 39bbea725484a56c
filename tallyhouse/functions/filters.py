"""Optional equality filters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def given(**values: Any) -> dict[str, Any]:
    """The arguments that ask for a filter: ``None``, ``''`` and ``'all'`` do not."""
    return {name: value for name, value in values.items() if value not in (None, "", "all")}


def where_equal(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df
