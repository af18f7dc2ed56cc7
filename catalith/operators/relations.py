"""Relations between titles from several sources, in one table, each address once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import enums, text
from catalith.operators.dedup import pick_by_source

COLUMNS = ("anime_id", "url", "title", "relation", "source", "pos")


def from_mal(df: DataFrame) -> DataFrame:
    """Relations to other shows; (anime_id, relations array<struct<relation, entry array<struct<type, name, url>>>>)."""
    r = df.select("anime_id", F.posexplode("relations").alias("i", "r")).select("anime_id", "i", "r.relation", F.posexplode("r.entry").alias("j", "e"))
    return r.filter("e.type = 'anime'").select("anime_id", F.col("e.url").alias("url"), F.col("e.name").alias("title"), "relation", F.lit("mal").alias("source"), (F.col("i") * 1000 + F.col("j")).cast("bigint").alias("pos"))


def sources_from_mal(df: DataFrame) -> DataFrame:
    """Relations to what a show was made from."""
    r = df.select("anime_id", F.posexplode("relations").alias("i", "r")).select("anime_id", "i", "r.relation", F.posexplode("r.entry").alias("j", "e"))
    return r.filter("e.type <> 'anime'").select("anime_id", F.col("e.url").alias("url"), F.col("e.name").alias("title"), "relation")


def from_planet(df: DataFrame) -> DataFrame:
    r = df.select("anime_id", F.posexplode("related_anime").alias("pos", "r"))
    return r.select("anime_id", F.col("r.url").alias("url"), text.planet_title(F.col("r.title")).alias("title"), enums.planet_relation(F.col("r.relation_type"), F.col("r.relation_subtype")).alias("relation"), F.lit("animeplanet").alias("source"), (F.lit(1_000_000) + F.col("pos")).cast("bigint").alias("pos"))


def from_schedule(df: DataFrame) -> DataFrame:
    """(anime_id, relations map<string,array<string>>), categories in order of the alphabet."""
    r = df.select("anime_id", F.explode(F.array_sort(F.map_entries("relations"))).alias("c")).select("anime_id", F.col("c.key").alias("category"), F.posexplode("c.value").alias("pos", "route"))
    return r.select("anime_id", F.concat(F.lit("https://animeschedule.net/anime/"), "route").alias("url"), text.route_title(F.col("route")).alias("title"), enums.schedule_relation(F.col("category")).alias("relation"), F.lit("animeschedule").alias("source"), (F.lit(2_000_000) + F.col("pos")).cast("bigint").alias("pos"))


def from_anilist(df: DataFrame) -> DataFrame:
    r = df.select("anime_id", F.posexplode("edges").alias("pos", "e"))
    return r.select("anime_id", F.concat(F.lit("https://anilist.co/anime/"), F.col("e.node.id").cast("string")).alias("url"), F.coalesce(F.col("e.node.title.romaji"), F.col("e.node.title.english")).alias("title"), enums.graph_relation(F.col("e.relation_type")).alias("relation"), F.lit("anilist").alias("source"), (F.lit(3_000_000) + F.col("pos")).cast("bigint").alias("pos"))


def from_anidb(df: DataFrame) -> DataFrame:
    """None: this source's relations carry no addresses.  The table has the columns of the others."""
    return df.filter(F.lit(False)).select("anime_id", *[F.lit(None).cast("string").alias(c) for c in ("url", "title", "relation")], F.lit("anidb").alias("source"), F.lit(0).cast("bigint").alias("pos"))


def mal_base(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(myanimelist\.net/anime/\d+)", 1), F.lit(""))


def from_offline(urls: DataFrame, known: DataFrame) -> DataFrame:
    """Related addresses of the offline record (anime_id, url, pos) that no source has, with what the address tells."""
    keyed = urls.withColumn("_k", text.url_key(F.col("url"))).join(known.select("anime_id", text.url_key(F.col("url")).alias("_k")).distinct(), ["anime_id", "_k"], "left_anti").drop("_k")
    base = keyed.withColumn("_m", mal_base(F.col("url"))).join(known.select("anime_id", mal_base(F.col("url")).alias("_m")).filter("_m is not null").distinct(), ["anime_id", "_m"], "left_anti").drop("_m")
    title = text.title_from_url(F.col("url"))
    return base.select("anime_id", "url", F.when(title == "Unknown", text.fallback_title(F.col("url"))).otherwise(title).alias("title"), text.relation_from_url(F.col("url")).alias("relation"), F.lit("offline").alias("source"), (F.lit(4_000_000) + F.col("pos")).cast("bigint").alias("pos"))


def all_relations(mal: DataFrame, planet: DataFrame, schedule: DataFrame, anilist: DataFrame, offline: DataFrame) -> DataFrame:
    """Every related address once, by the order of the sources; offline ones only where no source has them."""
    union = mal.select(*COLUMNS).unionByName(planet.select(*COLUMNS)).unionByName(schedule.select(*COLUMNS)).unionByName(anilist.select(*COLUMNS))
    keyed = union.filter("url is not null").withColumn("key", F.concat_ws("\t", F.col("anime_id").cast("string"), text.url_key(F.col("url"))))
    once = pick_by_source(keyed, "key", "source", "pos").select(*COLUMNS)
    return once.unionByName(from_offline(offline, union).select(*COLUMNS))
