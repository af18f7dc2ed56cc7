"""Source records as canonical records: one projection a source, typed in and typed out.

Input columns carry the source's names; a column the input lacks counts as null, so a mapper reads what is there.
Nested values stay nested and nothing is exploded; null entries vanish when a record is written as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.functions import enums, text
from catalith.functions.arrays import drop_null_entries, ordered_distinct
from catalith.functions.dates import airing_status, fuzzy_date, parse_date, season_of, year_of
from catalith.functions.numbers import percent_score, scaled_score

STRINGS, COMPANY = "array<string>", "array<struct<name:string,sources:array<string>>>"
STATISTICS = "struct<score:double,scored_by:bigint,rank:bigint,popularity:bigint,members:bigint,favorites:bigint>"
# Locales of voice actors; fixed values.
LOCALES = {
    "ja_jp": "Japanese", "ja": "Japanese", "en": "English", "en_us": "English", "pt_br": "Portuguese (BR)", "es": "Spanish", "es_la": "Spanish (LA)", "ko": "Korean", "de": "German",
    "it": "Italian", "fr": "French", "zh": "Chinese", "zh_cn": "Chinese", "ru": "Russian", "pl": "Polish", "hu": "Hungarian", "he": "Hebrew", "th": "Thai",
}


def fit(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as another type, structs by the names of their fields; a field that is missing is null."""
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(column, lambda x: fit(x, have.elementType, want.elementType))
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        parts = [(fit(column.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(want, T.MapType) and isinstance(have, T.StructType):  # objects read as structs
        entries = F.array(*[F.struct(F.lit(n).alias("k"), fit(column.getField(n), have[n].dataType, want.valueType).alias("v")) for n in have.fieldNames()])
        return F.when(column.isNotNull(), F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())))
    return column if have == want else column.cast(want)


class Fields:
    """Columns of an input by dotted name, as the type asked for; null where absent."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def __call__(self, path: str, kind: str = "string") -> Column:
        column, schema, want = None, self.schema, T.StructType.fromDDL(f"x {kind}")[0].dataType
        for part in path.split("."):
            if not isinstance(schema, T.StructType) or part not in schema.fieldNames():
                return F.lit(None).cast(want)
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            schema = schema[part].dataType
        return fit(column, schema, want)

    def array(self, path: str, element: str = "string") -> Column:
        return F.coalesce(self(path, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def _statistics(score: Column, **counts: Column) -> Column:
    names = ("scored_by", "rank", "popularity", "members", "favorites")
    return F.struct(score.cast("double").alias("score"), *[counts.get(n, F.lit(None)).cast("bigint").alias(n) for n in names]).cast(STATISTICS)


def _one(value: Column) -> Column:
    return F.filter(F.array(value), lambda v: v.isNotNull() & (v != ""))


def has_statistics(s: Column) -> Column:
    return F.coalesce(*[s.getField(n).cast("double") for n in ("score", "scored_by", "rank", "popularity", "members", "favorites")]).isNotNull()


def _companies(entries: Column) -> Column:
    return F.transform(entries, lambda c: F.struct(c["name"].alias("name"), F.array(c["source"]).alias("sources")))


def _relations(entries: Column, named: str) -> Column:
    """Related entries with their kind of relation."""
    return F.transform(entries, lambda e: F.struct(enums.RELATION.normalise(e[named]).alias("relation"), e["title"].alias("title"), e["source"].alias("source")))


def mal_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    related = f.array("related_entries", "struct<relation:string,title:string,source:string,entry_type:string,is_anime:boolean>")
    score = _statistics(f("score", "double"), **{n: f(n, "bigint") for n in ("scored_by", "rank", "popularity", "members", "favorites")})
    nothing = F.lower(F.coalesce(f("background"), F.lit(""))).contains("no background information")
    return df.select(
        f("title").alias("title"), f("title_english").alias("title_english"), f("title_japanese").alias("title_japanese"), f.array("synonyms").alias("synonyms"),
        enums.MEDIA_TYPE.normalise(f("type")).alias("type"), enums.STATUS.normalise(f("status")).alias("status"), enums.MATERIAL.normalise(f("source_material")).alias("source_material"),
        enums.RATING.normalise(f("rating")).alias("rating"), f("year", "int").alias("year"), enums.SEASON.normalise(f("season")).alias("season"),
        F.coalesce(f("episode_count", "int"), F.lit(0)).alias("episode_count"), f("duration", "int").alias("duration"), f("synopsis").alias("synopsis"),
        F.when(~nothing, f("background")).alias("background"), f.array("genres").alias("genres"), f.array("themes").alias("themes"), f.array("demographics").alias("demographics"),
        *[_companies(f.array(n, "struct<name:string,source:string>")).alias(n) for n in ("producers", "licensors", "studios")],
        _relations(F.filter(related, lambda e: e["is_anime"]), "relation").alias("related_anime"),
        F.transform(F.filter(related, lambda e: ~e["is_anime"]), lambda e: F.struct(enums.MATERIAL_RELATION.normalise(e["relation"]).alias("relation"), e["title"].alias("title"), e["source"].alias("source"))).alias("related_source_material"),
        F.map_from_entries(F.transform(f.array("external_sources", "struct<name:string,source:string>"), lambda x: F.struct(F.lower(x["name"]), x["source"]))).alias("external_sources"),
        F.transform(f.array("streaming", "struct<name:string,source:string>"), lambda x: F.struct(x["name"].alias("platform"), x["source"].alias("source"))).alias("streaming_sources"),
        F.array(f("source")).alias("sources"), drop_null_entries({"mal": F.when(has_statistics(score), score)}).alias("statistics"),
        F.struct(parse_date(f("aired_from")).alias("from"), parse_date(f("aired_to")).alias("to")).alias("aired_dates"),
    )


def _roles(own: Column, *ographies: Column) -> Column:
    """Distinct roles in order of the alphabet."""
    entries = F.concat(own, *[F.transform(F.filter(o, lambda e: e["role"].isNotNull()), lambda e: e["role"]) for o in ographies])
    return F.array_sort(F.array_distinct(F.transform(entries, lambda r: enums.ROLE.normalise(r))))


def _attributes(info: Column) -> Column:
    return F.map_filter(info, lambda _, v: v.isNotNull() & (v != ""))


OGRAPHY, ACTOR = "struct<title:string,role:string,sources:array<string>>", "struct<name:string,language:string>"


def mal_character(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return df.select(
        f("name").alias("name"), f("name_native").alias("name_native"), f("description").alias("description"), f("favorites", "bigint").alias("favorites"), f.array("nicknames").alias("nicknames"),
        ordered_distinct(f.array("images")).alias("images"), _roles(F.array().cast(STRINGS), f.array("animeography", OGRAPHY)).alias("roles"), f.array("animeography", OGRAPHY).alias("animeography"),
        f.array("mangaography", OGRAPHY).alias("mangaography"), f.array("voice_actors", ACTOR).alias("voice_actors"), _attributes(f("character_info", "map<string,string>")).alias("attributes"),
        f("spoilers", "map<string,string>").alias("spoilers"), F.array(f("source")).alias("sources"),
    )


def mal_episode(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return df.select(
        f("episode_number", "int").alias("episode_number"), f("title").alias("title"), f("title_japanese").alias("title_japanese"), f("title_romaji").alias("title_romaji"), parse_date(f("aired")).alias("aired"),
        f("duration", "int").alias("duration"), f("synopsis").alias("synopsis"), F.coalesce(f("filler", "boolean"), F.lit(False)).alias("filler"), F.coalesce(f("recap", "boolean"), F.lit(False)).alias("recap"),
        F.lit(None).cast("double").alias("score"), f("anime_id").alias("anime_id"), _one(f("url")).alias("sources"),
    )


def anilist_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    tags = f.array("tags", "struct<name:string,description:string,category:string,is_adult:boolean>")
    studios = f.array("studios", "struct<node:struct<id:bigint,name:string,is_animation_studio:boolean>>")
    links = F.filter(f.array("external_links", "struct<url:string,site:string,type:string>"), lambda x: (F.length(x["url"]) > 0) & (F.length(x["site"]) > 0))
    names = lambda test: F.transform(F.filter(tags, test), lambda t: t["name"])
    themed = lambda t: F.coalesce(t["category"].startswith("Theme-"), F.lit(False))
    company = lambda own: F.transform(F.filter(studios, lambda e: e["node"]["is_animation_studio"] == own), lambda e: F.struct(e["node"]["name"].alias("name"), F.array(F.concat(F.lit("https://anilist.co/studio/"), e["node"]["id"].cast("string"))).alias("sources")))
    mal = F.when(f("id_mal", "bigint").isNotNull(), F.concat(F.lit("https://myanimelist.net/anime/"), f("id_mal")))
    return df.select(
        F.coalesce(f("title.romaji"), F.lit("")).alias("title"), f("title.english").alias("title_english"), f("title.native").alias("title_japanese"), f("description").alias("synopsis"),
        enums.MEDIA_TYPE.normalise(f("format")).alias("type"), F.when(f("source").isNotNull(), enums.MATERIAL.normalise(f("source"))).alias("source_material"), enums.STATUS.normalise(f("status")).alias("status"),
        F.coalesce(f("episodes", "int"), F.lit(0)).alias("episode_count"), (f("duration", "int") * 60).alias("duration"), f("is_adult", "boolean").alias("nsfw"), f("season_year", "int").alias("year"),
        enums.SEASON.normalise(f("season")).alias("season"), f("country_of_origin").alias("country_of_origin"),
        F.filter(F.array(F.concat(F.lit("https://anilist.co/anime/"), f("id")), mal), lambda u: u.isNotNull()).alias("sources"), f.array("genres").alias("genres"), f.array("synonyms").alias("synonyms"),
        names(lambda t: t["is_adult"]).alias("content_warnings"), names(lambda t: ~t["is_adult"] & F.coalesce(t["category"] == "Demographic", F.lit(False))).alias("demographics"),
        F.transform(F.filter(tags, lambda t: ~t["is_adult"] & themed(t)), lambda t: F.struct(t["name"].alias("name"), t["description"].alias("description"))).alias("themes"),
        names(lambda t: ~t["is_adult"] & ~F.coalesce(t["category"] == "Demographic", F.lit(False)) & ~themed(t)).alias("tags"), company(True).alias("studios"), company(False).alias("producers"),
        F.transform(F.filter(links, lambda x: x["type"] == "STREAMING"), lambda x: F.struct(x["site"].alias("platform"), x["url"].alias("source"))).alias("streaming_sources"),
        F.map_from_entries(F.transform(F.filter(links, lambda x: x["type"].isin("INFO", "SOCIAL")), lambda x: F.struct(F.lower(x["site"]), x["url"]))).alias("external_sources"),
        F.when((f("trailer.site") == "youtube") & f("trailer.id").isNotNull(), F.concat(F.lit("https://youtu.be/"), f("trailer.id"))).alias("trailer"),
        _one(F.coalesce(F.nullif(f("cover_image.extra_large"), F.lit("")), f("cover_image.large"))).alias("covers"), _one(f("banner_image")).alias("banners"),
        F.create_map(F.lit("anilist"), _statistics(percent_score(f("average_score", "double")), members=f("popularity", "bigint"), favorites=f("favourites", "bigint"))).alias("statistics"),
        F.timestamp_seconds(f("next_airing_episode.airing_at", "bigint")).alias("next_episode_at"),
    )


def anilist_character(df: DataFrame) -> DataFrame:
    f = Fields(df)
    born = fuzzy_date(f("node.date_of_birth.year", "int"), f("node.date_of_birth.month", "int"), f("node.date_of_birth.day", "int"))
    given = drop_null_entries({"gender": f("node.gender"), "age": f("node.age"), "blood_type": f("node.blood_type"), "date_of_birth": born})
    parsed = F.map_filter(F.coalesce(f("node.description_attributes", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(given, k))
    voices = F.filter(f.array("voice_actor_roles", "struct<voice_actor:struct<name:struct<full:string>,language_v2:string>>"), lambda v: F.length(v["voice_actor"]["name"]["full"]) > 0)
    return df.select(
        F.coalesce(f("node.name.full"), F.lit("")).alias("name"), f("node.name.native").alias("name_native"), f.array("node.name.alternative").alias("name_variations"),
        f.array("node.name.alternative_spoiler").alias("nicknames"), f("node.description_prose").alias("description"), f("node.favourites", "bigint").alias("favorites"),
        F.array(enums.ROLE.normalise(f("role"))).alias("roles"), _one(f("node.image.large")).alias("images"), F.map_concat(parsed, given).alias("attributes"),
        F.transform(voices, lambda v: F.struct(v["voice_actor"]["name"]["full"].alias("name"), v["voice_actor"]["language_v2"].alias("language"))).alias("voice_actors"),
        F.array(F.coalesce(f("node.site_url"), F.concat(F.lit("https://anilist.co/character/"), f("node.id")))).alias("sources"),
    )


def kitsu_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    a = lambda path, kind="string": f(f"attributes.{path}", kind)
    start = a("startDate")
    score = _statistics(scaled_score(a("averageRating"), 0.1), rank=a("ratingRank", "bigint"), popularity=a("popularityRank", "bigint"), members=a("userCount", "bigint"), favorites=a("favoritesCount", "bigint"))
    return df.select(
        F.coalesce(a("canonicalTitle"), a("titles.en_jp"), a("titles.en"), F.lit("Unknown")).alias("title"), a("titles.en").alias("title_english"), a("titles.ja_jp").alias("title_japanese"),
        text.strip_markup(a("synopsis")).alias("synopsis"), enums.MEDIA_TYPE.normalise(a("subtype")).alias("type"), enums.STATUS.normalise(a("status")).alias("status"), enums.RATING.normalise(a("ageRating")).alias("rating"),
        season_of(start).alias("season"), year_of(start).alias("year"), F.coalesce(a("episodeCount", "int"), F.lit(0)).alias("episode_count"), (a("episodeLength", "int") * 60).alias("duration"),
        a("nsfw", "boolean").alias("nsfw"), f.array("attributes.abbreviatedTitles").alias("synonyms"), f.array("genres").alias("genres"), _one(F.concat(F.lit("https://kitsu.app/anime/"), F.coalesce(a("slug"), f("id")))).alias("sources"),
        F.create_map(F.lit("kitsu"), score).alias("statistics"), _one(a("posterImage.original")).alias("covers"), _one(a("coverImage.original")).alias("banners"),
    )


def kitsu_character(df: DataFrame) -> DataFrame:
    f = Fields(df)
    c = lambda path, kind="string": f(f"character.attributes.{path}", kind)
    voices = f.array("voices", "struct<attributes:struct<locale:string>,person:struct<attributes:struct<name:string>>>")
    language = lambda l: F.coalesce(enums.lookup(LOCALES, F.lower(l)), F.nullif(l, F.lit("")))  # noqa: E731, E741
    return df.select(
        F.coalesce(c("canonicalName"), c("name")).alias("name"), c("names.ja_jp").alias("name_native"), f.array("character.attributes.otherNames").alias("name_variations"),
        text.strip_markup(c("description")).alias("description"), F.array(enums.ROLE.normalise(f("attributes.role"))).alias("roles"), _one(c("image.original")).alias("images"),
        F.transform(voices, lambda v: F.struct(v["person"]["attributes"]["name"].alias("name"), language(v["attributes"]["locale"]).alias("language"))).alias("voice_actors"),
        _one(F.concat(F.lit("https://kitsu.app/characters/"), c("slug"))).alias("sources"),
    )


def kitsu_episode(df: DataFrame) -> DataFrame:
    f = Fields(df)
    a = lambda path, kind="string": f(f"attributes.{path}", kind)
    number = F.coalesce(a("number", "int"), F.lit(0))
    url = F.when(f("anime_slug").isNotNull() & (number > 0), F.concat(F.lit("https://kitsu.app/anime/"), f("anime_slug"), F.lit("/episodes/"), number.cast("string")))
    return df.select(
        number.alias("episode_number"), F.coalesce(a("canonicalTitle"), a("titles.en_us"), a("titles.en_jp"), F.concat(F.lit("Episode "), number.cast("string"))).alias("title"), a("titles.ja_jp").alias("title_japanese"),
        F.coalesce(F.nullif(a("synopsis"), F.lit("")), a("description")).alias("synopsis"), parse_date(a("airdate")).alias("aired"), (a("length", "int") * 60).alias("duration"), a("seasonNumber", "int").alias("season_number"), _one(url).alias("sources"),
    )


def _real_date(value: Column) -> Column:
    return F.when(~F.coalesce(value.startswith("0001-01-01"), F.lit(True)) & (value != ""), value)


def schedule_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    first = lambda name: F.try_element_at(f.array(name, "map<string,string>"), F.lit(1))["name"]
    sites = F.coalesce(f("websites", "map<string,string>"), F.create_map().cast("map<string,string>"))
    full = lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
    cross = F.transform(F.filter(F.array(*[F.try_element_at(sites, F.lit(s)) for s in ("mal", "aniList", "kitsu", "animePlanet", "anidb")]), lambda u: u.isNotNull()), full)
    score = _statistics(scaled_score(f("stats.average_score"), 0.1), scored_by=f("stats.rating_count", "bigint"), rank=f("stats.tracked_rating", "bigint"), members=f("stats.tracked_count", "bigint"))
    return df.select(
        f("title").alias("title"), f("names.english").alias("title_english"), f("names.native").alias("title_japanese"), f.array("names.synonyms").alias("synonyms"), text.tags_to_spaces(f("description")).alias("synopsis"),
        enums.MEDIA_TYPE.normalise(first("media_types")).alias("type"), enums.MATERIAL.normalise(first("sources")).alias("source_material"), enums.STATUS.normalise(f("status")).alias("status"),
        F.coalesce(f("episodes", "int"), F.lit(0)).alias("episode_count"), (f("length_min", "int") * 60).alias("duration"), f("year", "int").alias("year"), enums.SEASON.normalise(f("season.season")).alias("season"),
        F.transform(f.array("genres", "map<string,string>"), lambda g: g["name"]).alias("genres"), parse_date(_real_date(f("premier"))).alias("premier"),
        F.when(_real_date(f("delayed_from")).isNotNull(), F.struct(_real_date(f("delayed_from")).alias("from"), _real_date(f("delayed_until")).alias("until"), f("delayd_reason").alias("reason"))).alias("hiatus"),
        F.concat(F.array(F.concat(F.lit("https://animeschedule.net/anime/"), f("route"))), cross).alias("sources"),
        drop_null_entries({"animeschedule": F.when(f("stats.rating_count", "bigint") > 0, score)}).alias("statistics"),
    )


def anisearch_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    score = _statistics(f("statistics.score", "double"), rank=f("statistics.rank", "bigint"))
    return df.select(
        F.coalesce(F.nullif(f("title"), F.lit("")), f("title_japanese"), F.lit("")).alias("title"), f("title_japanese").alias("title_japanese"), f.array("synonyms").alias("synonyms"), enums.MEDIA_TYPE.normalise(f("type")).alias("type"),
        enums.MATERIAL.normalise(f("source_material")).alias("source_material"), airing_status(f("start_date"), f("end_date"), F.current_timestamp()).alias("status"), year_of(f("start_date")).alias("year"), season_of(f("start_date")).alias("season"),
        f("synopsis").alias("synopsis"), f.array("genres").alias("genres"), f.array("tags").alias("tags"), F.when(f("studio").isNotNull(), F.array(F.struct(f("studio").alias("name"), _one(f("studio_url")).alias("sources")))).alias("studios"),
        F.transform(f.array("anime_relations", "struct<relation_type:string,title:string,url:string>"), lambda r: F.struct(enums.RELATION.normalise(r["relation_type"]).alias("relation"), r["title"].alias("title"), r["url"].alias("source"))).alias("related_anime"),
        _one(f("cover_image")).alias("covers"), _one(f("url")).alias("sources"), drop_null_entries({"anisearch": F.when(has_statistics(score), score)}).alias("statistics"),
    )


def anisearch_character(df: DataFrame) -> DataFrame:
    f = Fields(df)
    roles, ography = f.array("anime_roles", "struct<title:string,url:string,role:string>"), f.array("anime_ography", "struct<title:string,url:string,role:string>")
    return df.select(
        f("name").alias("name"), f("name_native").alias("name_native"), f("description").alias("description"), f("favorites", "bigint").alias("favorites"),
        ordered_distinct(F.array(f("image")), f.array("screenshot_images"), f.array("picture_images")).alias("images"), _roles(F.filter(F.array(f("role")), lambda r: r.isNotNull()), roles).alias("roles"),
        F.filter(F.when(F.size(ography) > 0, ography).otherwise(roles), lambda o: F.length(o["title"]) > 0).alias("animeography"), f.array("voice_actors", ACTOR).alias("voice_actors"), _attributes(f("attributes", "map<string,string>")).alias("attributes"), _one(f("source")).alias("sources"),
    )


def anisearch_episode(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return df.select(
        f("episode_number", "int").alias("episode_number"), F.coalesce(F.nullif(f("title"), F.lit("")), F.concat(F.lit("Episode "), f("episode_number"))).alias("title"), f("title_japanese").alias("title_japanese"), f("title_romaji").alias("title_romaji"),
        parse_date(f("aired")).alias("aired"), f("duration", "int").alias("duration"), f("is_filler", "boolean").alias("filler"), f("is_recap", "boolean").alias("recap"), _one(f("source")).alias("sources"),
    )


def planet_anime(df: DataFrame) -> DataFrame:
    f = Fields(df)
    rating = _statistics(f("aggregate_rating.rating_value", "double") * 2, scored_by=f("aggregate_rating.rating_count", "bigint"), rank=f("rank", "bigint"))
    related = f.array("related_anime", "struct<title:string,url:string,relation_subtype:string>")
    manga = f.array("related_manga", "struct<title:string,url:string,relation_subtype:string>")
    at = lambda u: text.absolute_url(u, "https://www.anime-planet.com")
    return df.select(
        f("name").alias("title"), enums.MEDIA_TYPE.normalise(F.coalesce(f("schema_type"), f("type_raw"))).alias("type"), f("description").alias("synopsis"), airing_status(f("start_date"), f("end_date"), F.current_timestamp()).alias("status"),
        F.coalesce(enums.SEASON.normalise(f("season")), season_of(f("start_date"))).alias("season"), year_of(f("start_date")).alias("year"), F.coalesce(f("number_of_episodes", "int"), F.lit(0)).alias("episode_count"),
        _one(f("alt_title")).alias("synonyms"), ordered_distinct(f.array("genres"), f.array("tags")).alias("tags"), F.transform(f.array("studios"), lambda s: F.struct(s.alias("name"), F.array().cast(STRINGS).alias("sources"))).alias("producers"),
        F.transform(related, lambda r: F.struct(enums.RELATION.normalise(F.coalesce(r["relation_subtype"], F.lit("same franchise"))).alias("relation"), r["title"].alias("title"), at(r["url"]).alias("source"))).alias("related_anime"),
        F.transform(manga, lambda r: F.struct(F.when(F.lower(r["relation_subtype"]) == "original manga", "ADAPTATION").otherwise("OTHER").alias("relation"), r["title"].alias("title"), at(r["url"]).alias("source"))).alias("related_source_material"),
        _one(f("cover")).alias("covers"), F.array(F.concat(F.lit("https://www.anime-planet.com/anime/"), f("slug"))).alias("sources"), drop_null_entries({"animeplanet": F.when(has_statistics(rating), rating)}).alias("statistics"),
    )


def planet_character(df: DataFrame) -> DataFrame:
    f = Fields(df)
    roles = [f.array(n, "struct<title:string,url:string,role:string>") for n in ("anime_roles", "manga_roles")]
    own = F.transform_keys(F.coalesce(f("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: F.regexp_replace(F.lower(k), r"\s+", "_"))
    extra = drop_null_entries({"gender": f("gender"), "hair_color": f("hair_color"), "loved_rank": f("loved_rank"), "hated_rank": f("hated_rank")})
    return df.select(
        f("name").alias("name"), f("description").alias("description"), f.array("alt_names").alias("name_variations"), f.array("tags").alias("traits"), _roles(F.array().cast(STRINGS), *roles).alias("roles"),
        F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(extra, k)), extra).alias("attributes"), F.array_distinct(f.array("voice_actors", ACTOR)).alias("voice_actors"), _one(f("url")).alias("sources"),
    )


MAPPERS = {f.__name__: f for f in (mal_anime, mal_character, mal_episode, anilist_anime, anilist_character, kitsu_anime, kitsu_character, kitsu_episode, schedule_anime, anisearch_anime, anisearch_character, anisearch_episode, planet_anime, planet_character)}
