"""The library's operators on the test tables, each with the SQL that states its result.

``QUERIES`` maps a name to ``(spark, table_folder) -> DataFrame``; ``SQL`` holds the
statement for those that plain SQL can express.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


MODULES = (
    "columns", "alignment", "resampling", "windowing", "labelling", "sampling", "features", "evaluation", "sources", "live",
    "plans",
)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"queries.{module}")
