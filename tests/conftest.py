from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyhouse.sources.tables import SCHEMAS, SalesTables  # noqa: E402

SMALL_DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """No table counts as small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def make_tables(spark, stores=(), customers=(), products=(), orders=(), items=()) -> SalesTables:
    """Base tables from plain tuples; money may be given as text."""

    def frame(name, rows):
        schema = SCHEMAS[name]
        money = [i for i, field in enumerate(schema.fields) if field.dataType.typeName() == "decimal"]
        cleaned = [
            tuple(Decimal(v) if i in money and v is not None else v for i, v in enumerate(row)) for row in rows
        ]
        return spark.createDataFrame(cleaned, schema)

    return SalesTables.from_frames(
        frame("stores", stores),
        frame("customers", customers),
        frame("products", products),
        frame("orders", orders),
        frame("orderItems", items),
    )


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def rows(frame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]
