"""Records read from and written to JSON files, and lookups in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions.text import stable_id
from catalith.operators.dedup import keep_last
from catalith.runtime import shuffle_partitions


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


def read_database(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a catalogue: JSON lines by the suffix ``.jsonl``, else one document whose rows stand under ``data``."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    record = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([T.StructField("data", T.ArrayType(record))])).option("multiLine", True).json(path).select(F.explode("data").alias("r")).select("r.*")


def read_stage(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a stage file written as a list, as lines, as one object or under ``data``."""
    record = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    inner = T.StructType([*record.fields, T.StructField("data", T.ArrayType(record))])
    raw = spark.read.schema(inner).option("multiLine", not path.endswith(".jsonl")).json(path)
    own = F.struct(*[F.col(f"`{f.name}`") for f in record.fields])
    return raw.select(F.explode(F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.array(own))).alias("r")).select("r.*")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Like read_stage, but a missing or broken file gives no rows."""
    try:
        return read_stage(spark, path, schema).filter(F.lit(True))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def by_stable_id(df: DataFrame, position_col: str, urls: str = "sources", title: str = "title", kind: str = "type") -> DataFrame:
    """One row a stable id, the last of them."""
    return keep_last(df.withColumn("stable_id", stable_id(F.col(urls), F.col(title), F.col(kind))), ["stable_id"], position_col)


def at_position(df: DataFrame, position: int, position_col: str) -> DataFrame:
    return df.filter(F.col(position_col) == position)


def by_title(df: DataFrame, title: str, position_col: str, strict: bool = False, column: str = "title") -> DataFrame:
    """The first exact match without regard to case, else the only partial one; strictly, several of either raise."""
    low, wanted = F.lower(F.col(column)), title.lower()
    found, n = df.agg(F.count_if(low == wanted), F.count_if(low.contains(wanted))).first()  # one scan of one column
    if found:
        if strict and found > 1:
            raise Ambiguous(title)
        return df.filter(low == wanted).orderBy(position_col).limit(1)
    if n == 1:
        return df.filter(low.contains(wanted))
    if strict:
        raise Ambiguous(title) if n else NotFound(title)
    return df.limit(0)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields are left out, letters stay as they are."""
    df.write.mode(mode).json(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def align(requests: DataFrame, results: DataFrame, url: str = "url", position: str = "pos", status: str = "status_code", success: str = "success", order: str | None = None) -> DataFrame:
    """One row a request in its order, with the result of its URL; failed, missing and blocked ones have none.

    Of several results of a URL the first by ``order`` stands, of equal ones that whose JSON comes first.
    """
    usable = results.filter(F.col(success) & ~F.col(status).isin(403, 404, 405))
    result = F.struct(*[c for c in results.columns if c != url])
    first = usable.groupBy(url).agg(F.min_by(result, F.struct(*([order] if order else []), F.to_json(result))).alias("result"))
    return requests.join(first, url, "left").orderBy(position)


def blocked(results: DataFrame, status: str = "status_code") -> DataFrame:
    return results.filter(F.col(status).isin(403, 405))


def failed_for_now(results: DataFrame, success: str = "success", error: str = "error", words: tuple[str, ...] = ("timeout", "connection", "net::err", "temporar")) -> DataFrame:
    return results.filter(~F.col(success) & reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(error), F.lit(""))).contains(w) for w in words]))


def pages_to_rows(pages: DataFrame, data_col: str = "data", page_col: str = "page") -> DataFrame:
    """Rows of landed result pages in order; what follows a short page was never fetched, so nothing is cut."""
    return pages.select(page_col, F.posexplode(data_col).alias("pos", "row")).select(page_col, "pos", "row.*")


def services(names: list[str], only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """``only`` wins over ``skip``; neither takes all."""
    return [n for n in names if (n in only if only else not (skip and n in skip))]


def with_sources(base: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Base rows with each source as one struct column; an absent row of a source is null."""
    for name, df in sources.items():
        packed = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
        base = base.join(packed, key, "left")
    return base


def numbered(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Rows numbered in an order that is unique, without one task for all: by ranges, then by the ranges' sizes."""
    n = shuffle_partitions(df.sparkSession)  # a stated number is never coalesced, so that every job cuts the same ranges
    parts = df.repartitionByRange(n, F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    within = parts.withColumn(name, F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    sizes = {r["_p"]: r["n"] for r in within.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row a partition
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    if not start:
        return within.drop("_p")
    table = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
    return within.withColumn(name, F.col(name) + F.try_element_at(table, F.col("_p"))).drop("_p")
