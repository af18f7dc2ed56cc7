"""All queries and SQL texts of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.plans import assembly_queries, catalogue_queries, data_queries, function_queries, mapper_queries, more_queries, search_queries

MODULES = [search_queries, catalogue_queries, more_queries, mapper_queries, function_queries, assembly_queries, data_queries]


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
