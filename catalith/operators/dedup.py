"""Duplicates by key, tier, spelling and meaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.arrays import sorted_union


class DuplicateKey(ValueError):
    pass


def keep_last(df: DataFrame, keys: list[str], position_col: str) -> DataFrame:
    """Of rows of one key the last; an aggregate with a map side, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position_col)).alias("r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows unchanged; DuplicateKey if a key repeats."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise DuplicateKey(f"repeated key in {', '.join(keys)}")
    return df


def duplicates_removed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().agg((F.sum("count") - F.count("*")).alias("duplicates_removed"))


def real_season(season: Column) -> Column:
    return F.coalesce(season.isin("SPRING", "SUMMER", "FALL", "WINTER"), F.lit(False))


def duplicate_tier(year: Column, season: Column) -> Column:
    """1: year and season known or both unknown, 2: season unknown, 3: year unknown."""
    known = real_season(season)
    return F.when(year.isNotNull() & ~known, 2).when(year.isNull() & known, 3).otherwise(1)


def tiered_duplicates(df: DataFrame, title: str = "title", kind: str = "type", year: str = "year", season: str = "season") -> DataFrame:
    """(tier, n, title, type, year, season) of every group of two or more, by the tier's key."""
    tier = duplicate_tier(F.col(year), F.col(season))
    keyed = df.select(tier.alias("tier"), F.col(title).alias("title"), F.col(kind).alias("type"), F.when(tier != 3, F.col(year)).alias("year"), F.when(tier != 2, F.col(season)).alias("season"))
    return keyed.groupBy("tier", "title", "type", "year", "season").agg(F.count("*").alias("n")).filter("n > 1")


def tier_report(df: DataFrame) -> DataFrame:
    """(tier, groups, redundant) over the groups found."""
    return df.groupBy("tier").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("redundant"))


def merge_groups(df: DataFrame, keys: list[str], order_col: str, fill: list[str], largest: list[str], unions: list[str], empty: tuple[str, ...] = ("", "UNKNOWN")) -> DataFrame:
    """One row a group: first value that says something, largest number, sorted union of lists.

    The rule is associative, so it is an aggregate and needs no fold over a collected group; only lists are collected,
    as sets.
    """
    says = lambda c: F.when(~F.col(c).isin(*empty), F.col(c))
    aggregates = [F.coalesce(F.min_by(F.when(says(c).isNotNull(), F.struct(F.col(c).alias("v"))), F.when(says(c).isNotNull(), F.col(order_col))).getField("v"), F.min_by(F.col(c), F.col(order_col))).alias(c) for c in fill]
    aggregates += [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in largest]
    aggregates += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(c), F.array().cast("array<string>")))))).alias(c) for c in unions]
    return df.groupBy(*keys).agg(F.min(order_col).alias(order_col), *aggregates)


def merge_pair(a: DataFrame, b: DataFrame, key: str, fill: list[str], largest: list[str], unions: list[str], empty: tuple[str, ...] = ("", "UNKNOWN")) -> DataFrame:
    """Rows of ``a`` enriched by those of ``b`` with the same key."""
    says = lambda c: F.when(~c.isin(*empty), c)
    x, y = a.alias("x"), b.alias("y")
    pick = {c: F.coalesce(says(F.col(f"x.{c}")), says(F.col(f"y.{c}")), F.col(f"x.{c}")) for c in fill}
    pick |= {c: F.greatest(F.coalesce(F.col(f"x.{c}"), F.lit(0)), F.coalesce(F.col(f"y.{c}"), F.lit(0))) for c in largest}
    pick |= {c: sorted_union(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in unions}
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "left").select(*[pick.get(c, F.col(f"x.{c}")).alias(c) for c in a.columns])


def pick_by_source(relations: DataFrame, url_key: str, source: str, position: str) -> DataFrame:
    """Of relations of one URL: the first of the best source, else the last of the second, else the first of any."""
    place = F.when(F.col(source) == "mal", 0).when(F.col(source) == "animeplanet", 1).when(F.col(source) == "animeschedule", 2).otherwise(3)
    rank = F.struct(place, F.when(F.col(source) == "animeplanet", -F.col(position)).otherwise(F.col(position)))
    rest = [c for c in relations.columns if c != url_key]
    best = relations.groupBy(url_key).agg(F.min_by(F.struct(*rest), rank).alias("r"), F.min(position).alias("first_seen"))
    return best.select(url_key, *[F.col(f"r.{c}").alias(c) for c in rest], "first_seen")


def script_language(value: str) -> str | None:
    """A stand-in for a language detector: what the script tells."""
    if re.search("[\u3040-\u30ff]", value):
        return "ja"
    for language, letters in (("zh", "[\u4e00-\u9fff]"), ("ko", "[\uac00-\ud7af]"), ("ru", "[\u0400-\u04ff]"), ("latin", "[A-Za-z]")):
        if re.search(letters, value):
            return language
    return None


def distinct_by_meaning(df: DataFrame, values_col: str, vectors_col: str, threshold: float = 0.85, language: Callable[[str], str | None] | None = None) -> DataFrame:
    """Array values in order, each kept if no kept one is more similar than the threshold; values without a vector by spelling.

    With ``language`` values are compared within their language only, and stand by language in order of appearance, those
    of an unknown one last.
    """

    def by_language(values: list, vectors: list | None) -> list:
        groups: dict = {}
        for i, v in enumerate(values):
            groups.setdefault(language(v) if v else None, []).append(i)
        order = [k for k in groups if k is not None] + [None] * (None in groups)
        return [v for k in order for v in thin([values[i] for i in groups[k]], None if vectors is None else [vectors[i] for i in groups[k]])]

    def thin(values: list, vectors: list) -> list:
        kept, units, seen = [], [], set()
        for v, x in zip(values, vectors if vectors is not None else [None] * len(values)):
            key = (v or "").strip().lower()
            if not key or key in seen:
                continue
            if x is not None and (n := float(np.linalg.norm(u := np.asarray(x, float)))) > 0:
                u = u / n
                if any(len(w) == len(u) and float(u @ w) > threshold for w in units):
                    continue
                units.append(u)
            kept.append(v)
            seen.add(key)
        return kept

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{values_col: [None if v is None else (by_language if language else thin)(list(v), x) for v, x in zip(b[values_col], b[vectors_col])]})

    return df.mapInPandas(run, df.schema)
