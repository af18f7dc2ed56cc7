"""Writing: upsert and partial updates of point tables kept as Parquet, and their life cycle.

Plain Parquet has no MERGE: a new version is made by an anti-join and a union and swapped in by renaming the settings
over the old ones, so readers see the old or the new table and a lost executor costs only its tasks.  The version before
stays for those who are still reading it, and goes when the next one is made.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.dedup import keep_last, require_unique


@dataclass
class BatchResult:
    total: int = 0
    successful: int = 0
    failed: int = 0
    duplicates_removed: int = 0
    errors: list[str] = field(default_factory=list)


def upsert(old: DataFrame, new: DataFrame, key: str, position: str | None = None) -> DataFrame:
    """The new rows, of one key the last, and the old ones they don't replace."""
    rows = keep_last(new, [key], position).drop(position) if position else new
    return old.join(rows.select(key), key, "left_anti").unionByName(rows)


def update_vectors(points: DataFrame, updates: DataFrame, policy: str = "last_wins", key: str = "point_id", name: str = "vector_name", vector: str = "vector", position: str = "pos") -> DataFrame:
    """Named vectors of points replaced; ``points`` keeps them in a column each, ``updates`` one a row."""
    once = require_unique(updates, [key, name]) if policy == "fail" else keep_last(updates, [key, name], position)
    names = [c for c in points.columns if c != key and c.endswith("_vector")]
    wide = once.groupBy(key).agg(*[F.max_by(vector, F.when(F.col(name) == n, F.lit(1))).alias(f"new_{n}") for n in names])
    return points.join(wide, key, "left").select(*[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in points.columns])


def update_payload(points: DataFrame, updates: DataFrame, mode: str = "merge", key: str = "point_id", payload: str = "payload", position: str = "pos") -> DataFrame:
    """Payload maps merged key by key (a later update wins) or overwritten by the last update."""
    if mode == "overwrite":
        new = keep_last(updates, [key], position).select(key, F.col(payload).alias("new"))
        return points.join(new, key, "left").withColumn(payload, F.coalesce("new", payload)).drop("new")
    parts = updates.select(key, position, F.explode(payload).alias("k", "v"))
    new = keep_last(parts, [key, "k"], position).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("new"))
    old_only = F.map_filter(payload, lambda k, _: ~F.coalesce(F.map_contains_key("new", k), F.lit(False)))
    merged = points.join(new, key, "left").withColumn(payload, F.when(F.col("new").isNull(), F.col(payload)).otherwise(F.map_concat(old_only, "new")))
    return merged.select(*points.columns)


def usable_payload(payload: Column) -> Column:
    return F.coalesce(F.size(payload) > 0, F.lit(False))


class Collection:
    """A point table in a folder: its settings beside its rows, each version in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/settings.json"))

    def settings(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/settings.json", wholetext=True).first()[0])

    def _write_settings(self, settings: dict) -> None:
        """Written beside and renamed over the old ones: a reader finds the old or the new settings, never a part."""
        new, place = self._path(f"{self.path}/settings.json.new"), self._path(f"{self.path}/settings.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(settings).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, place, how)

    def create(self, schema: str, dims: dict[str, int], distance: str = "cosine", idf: bool = True) -> None:
        """Create the table, or check that the one there fits."""
        wanted = {"schema": schema, "dims": dims, "distance": distance, "idf": idf}
        if self.exists():
            have = {k: v for k, v in self.settings().items() if k != "version"}
            if have != wanted:
                raise ValueError(f"the collection differs in {', '.join(k for k in wanted if have.get(k) != wanted[k])}")
            return
        self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/v0")
        self._write_settings(wanted | {"version": 0})

    def read(self) -> DataFrame:
        s = self.settings()
        return self.spark.read.schema(s["schema"]).parquet(f"{self.path}/v{s['version']}")

    def replace(self, df: DataFrame) -> None:
        """Write the next version, point the settings to it, drop the one before the last."""
        s = self.settings()
        df.write.mode("overwrite").parquet(f"{self.path}/v{s['version'] + 1}")
        self._write_settings(s | {"version": s["version"] + 1})
        self._fs.delete(self._path(f"{self.path}/v{s['version'] - 1}"), True)

    def add(self, rows: DataFrame, key: str = "id", position: str | None = None) -> BatchResult:
        total = rows.count()
        if not total:
            return BatchResult()
        distinct = rows.select(key).distinct().count()
        if distinct < total and position is None:
            raise ValueError(f"{total - distinct} rows repeat a key: a position has to tell which is the last")
        self.replace(upsert(self.read(), rows, key, position))
        return BatchResult(total, distinct, 0, total - distinct)

    def clear(self) -> None:
        self.replace(self.read().limit(0))

    def delete(self) -> bool:
        return bool(self._fs.delete(self._path(self.path), True))


def reindex(records: DataFrame, collection: Collection, to_points: Callable[[DataFrame], DataFrame], usable: Column, position: str | None = None) -> BatchResult:
    """A collection made anew from records: unusable ones are skipped and counted, the rest turned into points and swapped in.

    ``to_points`` gives the collection's columns, vectors included; readers keep the old version until the new one stands.
    """
    counts = records.agg(F.count("*").alias("all"), F.count_if(usable).alias("good")).first()
    collection.replace(upsert(collection.read().limit(0), to_points(records.filter(usable)), "id", position))
    stored = collection.read().count()
    return BatchResult(counts["all"], stored, counts["all"] - counts["good"])
