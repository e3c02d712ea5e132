"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import queries as registry
from tools.compare import compare, connect

WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def tables(folder) -> duckdb.DuckDBPyConnection:
    return connect(folder)


def test_only_named_queries_lack_sql():
    assert set(registry.QUERIES) - set(registry.SQL) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, tables, name):
    df = entry.queries()[name](spark, folder)
    if name in WITHOUT_SQL:
        assert df.count() > 0
    else:
        assert compare(df, tables.sql(entry.oracle_sql()[name])) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "window_no", "mean_value", "min_value", "max_value", "mean_k", "start_t", "label"]
