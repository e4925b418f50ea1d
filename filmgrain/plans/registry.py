"""Query registry: a Spark plan over the driver tables and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filmgrain.plans.sqltext import with_views
from filmgrain.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register ``fn(views) -> DataFrame`` under ``name``. ``views`` are the SQL views the
    twin needs; they are put in front of it as common table expressions."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add
