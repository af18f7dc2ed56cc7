"""Counts and reports over catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_histogram(df: DataFrame, year: str = "year") -> DataFrame:
    """(year, n) in order of the year, unknown last."""
    return df.groupBy(F.coalesce(F.col(year).cast("string"), F.lit("Unknown")).alias("year")).agg(F.count("*").alias("n")).orderBy(F.col("year").try_cast("int").asc_nulls_last())


def era(year: Column) -> Column:
    return F.when(year.isNull(), "Unknown").when(year < 1980, "before 1980").when(year < 2000, "1980-1999").when(year < 2010, "2000-2009").when(year < 2020, "2010-2019").otherwise("2020 on")


def field_changes(diff: DataFrame, k: int = 10) -> DataFrame:
    """(field, n) of the fields changed most often, equal ones by name."""
    return diff.select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(k)


def issue_report(issues: DataFrame) -> DataFrame:
    """(kind, severity, n) over exploded issues."""
    return issues.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def compliance(results: DataFrame) -> DataFrame:
    """(total, valid, percent) over rows with a number of errors."""
    return results.agg(F.count("*").alias("total"), F.sum((F.col("errors") == 0).cast("int")).alias("valid")).withColumn("percent", F.round(100.0 * F.col("valid") / F.nullif(F.col("total"), F.lit(0)), 2))


def success_rate(ok: Column) -> Column:
    return F.round(100.0 * F.avg(ok.cast("int")), 2)


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, n) over explicit upper bounds, the last bucket open."""
    bucket = F.lit(float("inf"))
    for b in reversed(bounds):
        bucket = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(bucket)
    return df.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def collection_info(df: DataFrame) -> DataFrame:
    """(column, type, n) of a table with its exact count."""
    spark, n = df.sparkSession, df.count()
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), n) for f in df.schema.fields], "column string, type string, n bigint")
