"""Records assembled from stages and sources, and the points and texts made of them.

``SCHEMA`` is the assembled record: one row with nested characters and episodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions import arrays, enums, text
from catalith.functions.numbers import deterministic_id

EPISODE = "struct<id:string,episode_number:int,title:string,title_japanese:string,title_romaji:string,synopsis:string,description:string,aired:string,filler:boolean,recap:boolean>"
CHARACTER = "struct<id:string,name:string,name_native:string,roles:array<string>,nicknames:array<string>,description:string,attributes:map<string,string>,anime_ids:array<string>,images:array<string>>"
SCHEMA = f"""id string, title string, title_english string, title_japanese string, type string, status string, episode_count int, synopsis string, background string, genres array<string>, tags array<string>,
 demographics array<string>, synonyms array<string>, sources array<string>, images struct<covers:array<string>,posters:array<string>,banners:array<string>>, trailers array<struct<source:string,thumbnail:string>>,
 characters array<{CHARACTER}>, episodes array<{EPISODE}>"""
# Readers by audience, as a text should call them; fixed values.
AUDIENCES = {"Shounen": "Shounen (young male audience)", "Shoujo": "Shoujo (young female audience)", "Seinen": "Seinen (adult male audience)", "Josei": "Josei (adult female audience)", "Kids": "Kids (children)"}


def _list(c: Column, kind: str = "string") -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.length(F.trim(value)) > 0, F.concat(F.lit(f"{label}: "), value))


def _joined(label: str, values: Column) -> Column:
    return _labelled(label, F.array_join(arrays.clean_strings(_list(values)), ", "))


def envelope(df: DataFrame) -> DataFrame:
    """Any payload as anime, episodes, characters and extras; missing parts are empty."""
    have = set(df.columns)
    parts = {"anime": None, "episodes": "array<string>", "characters": "array<string>", "extras": "map<string,string>"}
    empty = {"array<string>": F.array().cast("array<string>"), "map<string,string>": F.create_map().cast("map<string,string>")}
    pick = [F.col(n) if n in have and k is None else F.coalesce(F.col(n), empty[k]) if n in have and df.schema[n].dataType.simpleString() == k else F.col(n) if n in have else (empty[k] if k else F.lit(None).cast("string")) for n, k in parts.items()]
    return df.select(*[c for c in df.columns if c not in parts], *[p.alias(n) for p, n in zip(pick, parts)])


def anime_text() -> Column:
    """The sections of a record joined by bars, empty ones left out."""
    audience = F.transform(_list(F.col("demographics")), lambda d: enums.lookup(AUDIENCES, d, None))
    expanded = F.transform(F.arrays_zip(_list(F.col("demographics")).alias("d"), audience.alias("a")), lambda z: F.coalesce(z["a"], z["d"]))
    sections = [
        F.concat_ws(" | ", _labelled("Title", F.col("title")), _labelled("English", F.col("title_english")), _labelled("Japanese", F.col("title_japanese")), _joined("Also", F.col("synonyms"))),
        _labelled("Synopsis", F.col("synopsis")),
        _labelled("Background", F.col("background")),
        _joined("Genres", F.concat(_list(F.col("genres")), expanded)),
        _joined("Tags", F.col("tags")),
        F.concat_ws(" | ", _labelled("Type", F.col("type")), _labelled("Status", F.col("status"))),
    ]
    return F.concat_ws(" || ", *[F.nullif(s, F.lit("")) for s in sections])


def character_text(c: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(c["attributes"], F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(" | ", _labelled("Name", c["name"]), _joined("Roles", c["roles"]), _labelled("Native", c["name_native"]), _joined("Nicknames", c["nicknames"]), _labelled("Background", c["description"]), F.nullif(F.array_join(pairs, " | "), F.lit("")))


def episode_text(e: Column) -> Column:
    flags = F.array_join(F.filter(F.array(F.when(e["filler"], "Filler"), F.when(e["recap"], "Recap")), lambda x: x.isNotNull()), ", ")
    body = F.concat_ws(" | ", F.concat(F.lit("Episode "), e["episode_number"].cast("string")), F.nullif(e["title"], F.lit("")), F.nullif(e["synopsis"], F.lit("")))
    return F.when(flags != "", F.concat(body, F.lit(" ("), flags, F.lit(")"))).otherwise(body)


def rerank_text() -> Column:
    """The plain text a pair model reads."""
    return F.concat_ws(" ", "title", "title_english", "title_japanese", "synopsis", "background", F.array_join(_list(F.col("genres")), " "), F.array_join(_list(F.col("tags")), " "), F.array_join(_list(F.col("demographics")), " "))


def image_urls() -> Column:
    return arrays.ordered_distinct(_list(F.col("images.covers")), _list(F.col("images.posters")), _list(F.col("images.banners")), F.transform(_list(F.col("trailers"), "struct<source:string,thumbnail:string>"), lambda t: t["thumbnail"]))


def points(records: DataFrame) -> DataFrame:
    """(id, entity_type, anime_id, text, images) of every record, its characters and its episodes."""
    anime = records.select("id", F.lit("anime").alias("entity_type"), F.col("id").alias("anime_id"), anime_text().alias("text"), image_urls().alias("images"))
    c, e = F.col("c"), F.col("e")
    cast = records.select(F.col("id").alias("anime_id"), F.explode("characters").alias("c")).select(
        F.coalesce(c["id"], deterministic_id(F.concat_ws("_", "anime_id", c["name"]))).alias("id"), F.lit("character").alias("entity_type"), "anime_id", character_text(c).alias("text"), arrays.ordered_distinct(_list(c["images"])).alias("images")
    )
    shown = records.select(F.col("id").alias("anime_id"), F.explode("episodes").alias("e")).select(
        F.coalesce(e["id"], deterministic_id(F.concat_ws("_", "anime_id", e["episode_number"].cast("string")))).alias("id"), F.lit("episode").alias("entity_type"), "anime_id", episode_text(e).alias("text"), F.array().cast("array<string>").alias("images")
    )
    return anime.unionByName(cast).unionByName(shown)


def with_anime_id(ids: Column, anime_id: Column) -> Column:
    """The list with the id at its end unless it is in it; repeats already there stay."""
    return F.when(F.array_contains(_list(ids), anime_id), ids).otherwise(F.concat(_list(ids), F.array(anime_id)))


# --- stages ---------------------------------------------------------------------------------------------------------------
def overwrite_filled(base: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """Base rows with every stage value that says something: scalars not blank, lists and maps not empty."""
    side = stage.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in stage.columns if c != key])
    joined = base.join(side, key, "left")
    out = []
    for c in base.columns:
        if c == key or c not in stage.columns:
            out.append(F.col(c))
            continue
        s, kind = F.col(f"_s_{c}"), stage.schema[c].dataType
        filled = F.size(s) > 0 if isinstance(kind, (T.ArrayType, T.MapType)) else (F.length(s) > 0) if isinstance(kind, T.StringType) else s.isNotNull()
        out.append(F.when(filled, s).otherwise(F.col(c)).alias(c))
    extra = [F.col(f"_s_{c}").alias(c) for c in stage.columns if c not in base.columns]
    return joined.select(*out, *extra)


def merge_episodes(base: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Episodes of both by number: missing and blank fields of the base filled, unmatched ones appended."""
    rest = [c for c in base.columns if c not in keys]
    side = stage.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in stage.columns if c in rest])
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if isinstance(base.schema[c].dataType, T.StringType) else F.col(c)
    return base.join(side, keys, "full_outer").select(*keys, *[F.coalesce(blank(c), F.col(f"_s_{c}")).alias(c) if f"_s_{c}" in side.columns else F.col(c) for c in rest])


def finish(df: DataFrame, order: list[str]) -> DataFrame:
    """Defaults, notes on what had to be assumed, and the columns in their order; others are left out."""
    title, count = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Unknown Title")), F.coalesce(F.col("episode_count").try_cast("int"), F.lit(0))
    notes = [F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title missing"), F.when(F.col("type").isNull(), "type assumed"), F.when(F.col("status").isNull(), "status assumed")]
    done = df.withColumns({"title": title, "type": F.coalesce("type", F.lit("UNKNOWN")), "status": F.coalesce("status", F.lit("UNKNOWN")), "episode_count": count, "notes": F.filter(F.array(*notes), lambda n: n.isNotNull())})
    return done.select(*[c for c in [*order, "notes"] if c in done.columns])


def stage_episodes(driver: DataFrame, kitsu: DataFrame, anisearch: DataFrame, key: str = "episode_number") -> DataFrame:
    """The main source's episodes with the titles, pictures and synopses of two others by number."""
    k = kitsu.select(key, *[F.col(c).alias(f"k_{c}") for c in kitsu.columns if c != key])
    a = anisearch.select(key, F.col("title").alias("a_title"))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    joined = driver.join(k, key, "left").join(a, key, "left")
    return joined.select(*[c for c in driver.columns if c not in ("title", "synopsis")], first(F.col("title"), F.col("k_title"), F.col("a_title")).alias("title"), first(F.col("synopsis"), F.col("k_synopsis")).alias("synopsis"), "k_thumbnail")


def merge_themes(offline: DataFrame, external: DataFrame, genres: DataFrame, key: str = "id") -> DataFrame:
    """(id, name, description) of themes by name without regard to case, none that is a genre, the first description kept."""
    both = offline.withColumn("_o", F.lit(0)).unionByName(external.withColumn("_o", F.lit(1)))
    named = both.withColumn("_n", F.lower(F.trim("name"))).join(genres.select(key, F.lower(F.trim("genre")).alias("_n")), [key, "_n"], "left_anti")
    order = F.struct("_o", "pos")
    return named.groupBy(key, "_n").agg(F.min_by("name", order).alias("name"), F.min_by("description", F.when(F.col("description").isNotNull(), order)).alias("description")).drop("_n")


def statistics_map(df: DataFrame, sources: dict[str, Column]) -> Column:
    """A map of the sources' figures, without those that have none."""
    metrics = ("score", "scored_by", "rank", "popularity_rank", "members", "favorites")
    has = lambda s: F.coalesce(*[s.getField(m).cast("double") for m in metrics]).isNotNull()
    return arrays.drop_null_entries({n: F.when(has(s), s) for n, s in sources.items()})


def synopsis_by_rank(anidb: Column, mal: Column, schedule: Column, kitsu: Column, planet: Column, anilist: Column) -> Column:
    """The best source's synopsis, cleaned of what that source adds."""
    bare = lambda c: F.regexp_replace(c, r"(?i)\s*(?:\(source:[^)]*\)|\[written by [^\]]*\])\s*$", "")
    return text.first_synopsis(F.regexp_replace(anidb, r"https?://\S+\s*\[([^\]]*)\]", "$1"), bare(mal), text.tags_to_spaces(schedule), bare(kitsu), planet, F.regexp_replace(anilist, r"<[^>]*>", ""))
