"""Queries of the general data-preparation operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.nested import page_tables
from catalith.operators.timestamps import normalise_timestamps
from catalith.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per air text that gives one instant or one full date."""
    times = normalise_timestamps(table(spark, sf_dir, "episodes_raw"), table(spark, sf_dir, "feeds"))
    return times.filter(F.col("status") == "ok").select(F.col("id").alias("row_id"), "aired_norm")


def p1_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where no feed declares an order of day and month: records alone show in which order a feed writes."""
    feeds = table(spark, sf_dir, "feeds").withColumn("date_order", F.lit(None).cast("string"))
    times = normalise_timestamps(table(spark, sf_dir, "episodes_raw"), feeds)
    return times.filter(F.col("status") == "ok").select(F.col("id").alias("row_id"), "aired_norm")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode titles, voice actors and theme ranges of the pages with their positions."""
    return page_tables(table(spark, sf_dir, "anime_pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_undeclared": p1_undeclared, "p6_found": p6_found}
SQL: dict[str, str] = {}
