"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferryload.plans import business, cataloging, expressions, joining, loading, logs, quality, reconciling
from ferryload.plans.tables import Tables

MODULES = [loading, joining, expressions, quality, reconciling, logs, business, cataloging]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, folder: query(Tables(spark, folder))

    return {name: bind(query) for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
