"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.context import CheckModel, model, tidy
from checks.oracle import statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a function of the model as a query, its floating columns rounded, with its SQL."""

    def add(fn: Callable[[CheckModel], DataFrame]):
        QUERIES[name] = lambda spark, folder: tidy(fn(model(spark, folder)))
        if sql is not None:
            ORACLES[name] = statement(sql)
        return fn

    return add
