"""Joins the catalogue needs beyond equality: enrichment, snapshot diff, prefixes, best match, as-of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import url_key


def enrich_left(base: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """The base rows with the columns of each side by key; sides hold one row a key, Spark picks the join by their size."""
    return reduce(lambda d, s: d.join(s, key, "left"), sides, base)


def last_known(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key with the last non-null value of every column by position."""
    rest = [c for c in df.columns if c not in (key, position)]
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in rest])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, change, fields): removed, added, changed or identical rows with the names of changed fields."""
    a, b = old.select(key, *[F.col(c).alias(f"o_{c}") for c in compare], F.lit(True).alias("o_")), new.select(key, *[F.col(c).alias(f"n_{c}") for c in compare], F.lit(True).alias("n_"))
    fields = F.filter(F.array(*[F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in compare]), lambda f: f.isNotNull())
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("n_").isNull(), "removed").when(F.col("o_").isNull(), "added").when(F.size(fields) > 0, "changed").otherwise("identical")
    return both.select(key, change.alias("change"), F.when(change == "changed", fields).otherwise(F.array().cast("array<string>")).alias("fields"))


def not_yet_known(urls: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is in no known row, compared in normal form."""
    keyed = urls.withColumn("_key", url_key(F.col(url)))
    return keyed.join(known.select(url_key(F.col(url)).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def prefix_matches(left: DataFrame, right: DataFrame, left_col: str, right_col: str, order_col: str, lengths: tuple[int, ...]) -> DataFrame:
    """The first right row of which the left value is a prefix, or the other way round.

    ``lengths`` are the lengths prefixes may have: every value is cut to them, and equal cuts meet in an equality join.
    """
    cuts = lambda c: F.explode(F.array_distinct(F.filter(F.array(*[F.when(F.length(c) >= n, F.substring(c, 1, n)) for n in lengths], ), lambda x: x.isNotNull())))
    a = left.withColumn("_cut", cuts(F.col(left_col)))
    b = right.withColumn("_cut", cuts(F.col(right_col)))
    met = a.join(b, "_cut").filter((F.col("_cut") == F.col(left_col)) | (F.col("_cut") == F.col(right_col)))
    rest = [c for c in right.columns]
    return met.groupBy(*left.columns).agg(F.min_by(F.struct(*rest), order_col).alias("r")).select(*left.columns, *[F.col(f"r.{c}").alias(c) for c in rest])


def best_match(scored: DataFrame, query: str, candidate: str, position: str, at_once: float = 0.9, accept: float = 0.7) -> DataFrame:
    """Per query the first candidate that is good at once, else the best one that is acceptable."""
    s = F.round("score", 9)
    rank = F.struct((s >= at_once).cast("int"), F.when(s >= at_once, F.lit(0.0)).otherwise(s), -F.col(position))
    best = scored.groupBy(query).agg(F.max_by(F.struct(candidate, "score"), rank).alias("m"))
    return best.select(query, F.col(f"m.{candidate}").alias(candidate), F.col("m.score").alias("score")).filter(F.round("score", 9) >= accept)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "HIGH").otherwise("LOW")


def validated(score: Column, same_role: Column, shared_actor: Column) -> Column:
    """Whether a match stands: above 0.9 at once, else with a tenth more for a shared actor above 0.5, or 0.3 with one role."""
    raised = score + F.when(shared_actor, 0.1).otherwise(0.0)
    return (score > 0.9) | (raised > 0.5) | ((raised > 0.3) & same_role)


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], stretch: int = 86_400) -> DataFrame:
    """The last right values at or before each left row, by one union and windows instead of a range join.

    Windows run within stretches of so many seconds, so a key of any number of rows is split by time; what a stretch
    leaves behind is carried into the later ones from one row a key and stretch.
    """
    at = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (stretch * 1_000_000))
    a = left.select("*", F.col(left_ts).alias("_ts"), at(left_ts).alias("_part"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(
        *[F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_ts).alias("_ts"), at(right_ts).alias("_part"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values]
    )
    whole = a.unionByName(b)
    left_behind = whole.groupBy(key, "_part").agg(*[F.max_by(f"_{v}", F.when((F.col("_side") == 0) & F.col(f"_{v}").isNotNull(), F.col("_ts"))).alias(f"_{v}") for v in values])
    parts_before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = left_behind.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), *[F.last(f"_{v}", ignorenulls=True).over(parts_before).alias(f"_carried_{v}") for v in values])
    before = Window.partitionBy(key, "_part").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = whole.select("*", *[F.last(f"_{v}", ignorenulls=True).over(before).alias(f"_last_{v}") for v in values]).filter("_side = 1")
    joined = filled.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_part").eqNullSafe(F.col("_of")), "left")
    return joined.select(*left.columns, *[F.coalesce(f"_last_{v}", f"_carried_{v}").alias(v) for v in values])


def k_hop(edges: DataFrame, start: list, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hop) of what a few nodes reach within some hops, each at its least hop; one join a hop."""
    seen = edges.sparkSession.createDataFrame([(s,) for s in start], f"node {edges.schema[src].dataType.simpleString()}").withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        front = seen.filter(F.col("hop") == h - 1).join(edges, F.col("node") == F.col(src)).select(F.col(dst).alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionByName(front).groupBy("node").agg(F.min("hop").alias("hop"))
    return seen
