"""Queries that SQL can express, row by row; and that every query of the list is registered."""

import re

import duckdb
import pytest

import __spark_entry__ as registered
from tallyhouse.llm import registry

DATA = "/root/testdata/sf0.001"


def test_all_ten_are_registered():
    names = registered.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    result = connection.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = registry.queries()[name](spark, DATA).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
