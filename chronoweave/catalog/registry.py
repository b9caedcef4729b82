"""Where queries register: a function of the views, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.catalog.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable:
    """Registers a function of `Views` under its name; `views` are the common tables that the SQL uses."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            SQL[f.__name__] = f"WITH {views} {sql}" if views else sql
        return f

    return add
