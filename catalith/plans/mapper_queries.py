"""Source mappers and page extraction over the test tables: each table is put into a source's shape, mapped, and compared with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import enums
from catalith.functions.enums import ValueSet
from catalith.runtime import table
from catalith.sources import extract, mappers

LIT = F.lit


def joined(entries: Column) -> Column:
    return F.array_join(entries, "|")


def stamp(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def fields(entries: Column, *names: str) -> Column:
    """Of structs, some fields joined by a stroke, the structs joined by bars."""
    return joined(F.transform(entries, lambda e: F.concat_ws("/", *[e[n] for n in names])))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records")
    return r.select(
        F.col("record_id").alias("id"), "anime_key", "title", "type", "status", "synopsis", "genres", F.col("anime_season.year").alias("year"), F.col("anime_season.season").alias("season"),
        F.coalesce(F.size("episodes"), LIT(0)).alias("n"), F.try_element_at("sources", LIT(1)).alias("source"), (F.col("record_id") % 10).cast("int").alias("k"),
    )


def _actors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    id_col, count = ("mal_id", "favorites") if name == "mal_characters" else ("anilist_id", "favourites")
    c = table(spark, sf_dir, name).withColumnRenamed(id_col, "id").withColumnRenamed(count, "fans")
    return c.withColumn("voice_actors", F.coalesce("voice_actors", F.array().cast("array<struct<name:string,language:string>>")))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "episodes_raw")
    number = F.nullif(F.regexp_extract("episode_number_raw", r"(\d{1,6})", 1), LIT("")).cast("int")
    return e.select("row_id", "title_en", "title_ja", "is_filler", number.alias("number"), F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))


def map_mal_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    company = F.array(F.struct(F.concat(LIT("Studio "), F.col("k")).alias("name"), LIT("s").alias("source")))
    related = F.array(
        F.struct(F.when(F.col("k") < 5, "Side Story").otherwise("prequel").alias("relation"), F.col("title"), LIT("u1").alias("source"), LIT("TV").alias("entry_type"), LIT(True).alias("is_anime")),
        F.struct(LIT("Adaptation").alias("relation"), F.col("title"), LIT("u2").alias("source"), LIT("Manga").alias("entry_type"), LIT(False).alias("is_anime")),
    )
    background = F.when(F.col("k") == 0, "No background information has been added.").when(F.col("k") == 1, "Made late.")
    raw = r.withColumns({"episode_count": F.col("n"), "score": F.col("k").cast("double"), "scored_by": F.when(F.col("k") > 2, F.col("id")), "studios": company, "related_entries": related, "background": background})
    raw = raw.withColumn("score", F.when(F.col("k") > 2, F.col("score")))
    m = mappers.mal_anime(raw)
    return m.select(
        F.col("sources")[0].alias("source"), "title", "type", "status", "year", "season", "episode_count", "synopsis", "background", joined("genres").alias("genres"), fields(F.col("studios"), "name").alias("studios"),
        fields(F.col("related_anime"), "relation", "source").alias("anime"), fields(F.col("related_source_material"), "relation", "source").alias("material"), F.try_element_at("statistics", LIT("mal"))["scored_by"].alias("scored_by"),
    )


def map_mal_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "mal_characters")
    ography = F.transform("animeography", lambda t: F.struct(t.alias("title"), F.col("role"), F.array(LIT("u")).alias("sources")))
    raw = c.withColumns({"favorites": F.col("fans"), "animeography": ography, "source": F.concat(LIT("https://mal.example/character/"), F.col("id")), "images": F.array(LIT("b"), LIT("a"), LIT("b")), "character_info": F.create_map(LIT("age"), F.col("age"), LIT("gender"), F.col("gender"))})
    m = mappers.mal_character(raw)
    return m.select(
        F.col("sources")[0].alias("source"), "name", "name_native", "favorites", joined("roles").alias("roles"), joined("images").alias("images"), fields(F.col("voice_actors"), "name", "language").alias("voices"),
        fields(F.col("animeography"), "title", "role").alias("ography"), F.try_element_at("attributes", LIT("age")).alias("age"), F.try_element_at("attributes", LIT("gender")).alias("gender"),
    )


def map_mal_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _episodes(spark, sf_dir).select(F.col("number").alias("episode_number"), F.col("title_en").alias("title"), F.col("title_ja").alias("title_japanese"), F.col("day").alias("aired"), F.col("is_filler").alias("filler"), F.concat(LIT("https://mal.example/e/"), F.col("row_id")).alias("url"))
    return mappers.mal_episode(raw).select(F.col("sources")[0].alias("source"), "episode_number", "title", "title_japanese", stamp(F.col("aired")).alias("aired"), "filler", "recap")


def map_anilist_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    tag = lambda name, category, adult: F.struct(LIT(name).alias("name"), LIT("about").alias("description"), LIT(category).cast("string").alias("category"), LIT(adult).alias("is_adult"))
    tags = F.when(F.col("k") < 5, F.array(tag("Pirates", "Theme-Other", False), tag("Shounen", "Demographic", False), tag("Gore", "Theme-Other", True), tag("Ensemble", None, False)))
    studio = lambda i, name, own: F.struct(F.struct(LIT(i).cast("bigint").alias("id"), LIT(name).alias("name"), LIT(own).alias("is_animation_studio")).alias("node"))
    link = lambda url, site, kind: F.struct(LIT(url).alias("url"), LIT(site).alias("site"), LIT(kind).alias("type"))
    raw = r.select(
        F.struct(F.col("title").alias("romaji"), F.when(F.col("k") == 3, F.col("title")).alias("english"), LIT("題").alias("native")).alias("title"), F.col("type").alias("format"), "status", F.col("n").alias("episodes"), LIT(24).alias("duration"),
        F.col("year").alias("season_year"), "season", "id", F.when(F.col("k") > 6, F.col("anime_key")).alias("id_mal"), "genres", tags.alias("tags"), F.array(studio(7, "Own", True), studio(8, "Fund", False)).alias("studios"),
        F.array(link("https://s", "Stream", "STREAMING"), link("https://i", "Info", "INFO"), link("", "None", "INFO")).alias("external_links"), F.struct(F.when(F.col("k") < 3, "youtube").otherwise("other").alias("site"), LIT("abc").alias("id")).alias("trailer"),
        F.struct(F.when(F.col("k") % 2 == 0, "").otherwise("xl").alias("extra_large"), LIT("l").alias("large")).alias("cover_image"), (F.col("k") * 11).alias("average_score"), F.col("id").alias("popularity"),
    )
    m = mappers.anilist_anime(raw)
    s = F.col("statistics")["anilist"]
    return m.select(
        joined("sources").alias("sources"), "title", "title_english", "type", "status", "episode_count", "duration", "year", "season", joined("genres").alias("genres"), joined("tags").alias("tags"), joined("demographics").alias("demographics"),
        joined("content_warnings").alias("warnings"), fields(F.col("themes"), "name", "description").alias("themes"), fields(F.col("studios"), "name").alias("studios"), fields(F.col("producers"), "name").alias("producers"), fields(F.col("streaming_sources"), "platform", "source").alias("streaming"),
        F.element_at("external_sources", "info").alias("info"), "trailer", joined("covers").alias("covers"), s["score"].alias("score"), s["members"].alias("members"),
    )


def map_anilist_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "anilist_characters")
    node = F.struct(
        F.struct(F.col("name").alias("full"), F.col("name_native").alias("native"), F.col("alternative")).alias("name"), "gender", "age", "id", F.col("fans").alias("favourites"), F.create_map(LIT("age"), LIT("0"), LIT("height"), LIT("170")).alias("description_attributes"),
        F.struct(LIT(1999).alias("year"), F.when(F.col("id") % 2 == 0, 4).alias("month"), LIT(5).alias("day")).alias("date_of_birth"),
    )
    voices = F.transform("voice_actors", lambda v: F.struct(F.struct(F.struct(v["name"].alias("full")).alias("name"), v["language"].alias("language_v2")).alias("voice_actor")))
    raw = c.select(node.alias("node"), F.when(F.col("id") % 3 == 0, "MAIN").when(F.col("id") % 3 == 1, "supporting").alias("role"), voices.alias("voice_actor_roles"))
    a = lambda name: F.try_element_at("attributes", LIT(name)).alias(name)
    return mappers.anilist_character(raw).select(
        F.col("sources")[0].alias("source"), "name", "name_native", joined("name_variations").alias("variations"), "favorites", joined("roles").alias("roles"), a("gender"), F.coalesce(a("age"), LIT("")).alias("age"), a("height"), fields(F.col("voice_actors"), "name", "language").alias("voices")
    )


def map_kitsu_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    start = F.concat(F.coalesce("year", LIT(2001)), LIT("-0"), (F.col("k") % 9 + 1), LIT("-15"))
    raw = r.select(
        "id", "genres",
        F.struct(
            F.when(F.col("k") != 4, F.col("title")).alias("canonicalTitle"), F.struct(LIT("Second").alias("en_jp"), LIT(None).cast("string").alias("en"), LIT("題").alias("ja_jp")).alias("titles"), F.concat(LIT("<p>Tom &amp; "), F.col("k"), LIT("</p> ")).alias("synopsis"),
            F.col("type").alias("subtype"), "status", F.when(F.col("k") < 5, "PG").otherwise("R18").alias("ageRating"), start.alias("startDate"), F.col("n").alias("episodeCount"), LIT(20).alias("episodeLength"), (F.col("k") * 10.5).cast("string").alias("averageRating"),
            F.when(F.col("k") > 4, F.concat(LIT("slug-"), F.col("id"))).alias("slug"), F.col("id").alias("userCount"),
        ).alias("attributes"),
    )
    s = F.col("statistics")["kitsu"]
    return mappers.kitsu_anime(raw).select(joined("sources").alias("sources"), "title", "title_japanese", "synopsis", "type", "status", "rating", "season", "year", "episode_count", "duration", F.round(s["score"], 6).alias("score"), s["members"].alias("members"))


def map_kitsu_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "mal_characters")
    attributes = F.struct(F.when(F.col("id") % 2 == 0, F.col("name")).alias("canonicalName"), F.upper("name").alias("name"), F.struct(F.col("name_native").alias("ja_jp")).alias("names"), F.concat(LIT("<i>"), F.col("gender"), LIT("</i>")).alias("description"), F.concat(LIT("c-"), F.col("id")).alias("slug"))
    voices = F.transform("voice_actors", lambda v: F.struct(F.struct(v["language"].alias("locale")).alias("attributes"), F.struct(F.struct(v["name"].alias("name")).alias("attributes")).alias("person")))
    raw = c.select(F.struct(attributes.alias("attributes")).alias("character"), F.struct(F.lower("role").alias("role")).alias("attributes"), voices.alias("voices"))
    return mappers.kitsu_character(raw).select(F.col("sources")[0].alias("source"), "name", "name_native", "description", joined("roles").alias("roles"), fields(F.col("voice_actors"), "name", "language").alias("voices"))


def map_kitsu_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.struct(F.when(F.col("row_id") % 3 == 0, "US").alias("en_us"), LIT(None).cast("string").alias("en_jp"), F.col("title_ja").alias("ja_jp"))
    attributes = F.struct("number", F.col("title_en").alias("canonicalTitle"), titles.alias("titles"), F.when(F.col("row_id") % 2 == 0, "").otherwise("S").alias("synopsis"), LIT("D").alias("description"), F.col("day").alias("airdate"), LIT(24).alias("length"))
    raw = _episodes(spark, sf_dir).select(attributes.alias("attributes"), F.when(F.col("row_id") % 5 > 0, F.concat(LIT("s"), F.col("row_id"))).alias("anime_slug"))
    return mappers.kitsu_episode(raw).select("episode_number", "title", "title_japanese", "synopsis", stamp(F.col("aired")).alias("aired"), "duration", joined("sources").alias("sources"))


def map_schedule_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    named = lambda c: F.array(F.create_map(LIT("name"), c))
    raw = r.select(
        "title", F.struct(F.when(F.col("k") == 1, "E").alias("english")).alias("names"), F.concat(LIT("<b>"), F.col("k"), LIT("</b>\r")).alias("description"), named(F.col("type")).alias("media_types"), named(F.when(F.col("k") < 4, "Light Novel").otherwise("strange")).alias("sources"), "status",
        F.col("n").alias("episodes"), LIT(25).alias("length_min"), "year", F.struct(F.col("season")).alias("season"), F.transform("genres", lambda g: F.create_map(LIT("name"), g)).alias("genres"), F.concat(LIT("r-"), F.col("id")).alias("route"),
        F.when(F.col("k") < 3, "0001-01-01T00:00:00Z").otherwise("2020-05-06T07:08:09Z").alias("premier"), F.create_map(LIT("mal"), LIT("mal.example/1"), LIT("kitsu"), LIT("https://kitsu.example/2")).alias("websites"),
        F.struct((F.col("k") * 9).alias("average_score"), F.when(F.col("k") > 5, F.col("id")).otherwise(0).alias("rating_count")).alias("stats"),
    )
    s = F.try_element_at("statistics", LIT("animeschedule"))
    return mappers.schedule_anime(raw).select(
        joined("sources").alias("sources"), "title", "title_english", "synopsis", "type", "source_material", "status", "episode_count", "duration", "year", "season", joined("genres").alias("genres"), stamp(F.col("premier")).alias("premier"), F.round(s["score"], 6).alias("score"), s["scored_by"].alias("scored_by")
    )


def map_anisearch_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    raw = r.select(
        F.when(F.col("k") > 1, F.col("title")).otherwise("").alias("title"), F.concat(LIT("題"), F.col("k")).alias("title_japanese"), "type", F.when(F.col("k") > 4, "Manga").alias("source_material"), F.concat(LIT("0"), F.col("k") % 9 + 1, LIT("-"), F.col("k")).alias("unused"),
        F.concat(F.coalesce("year", LIT(2001)), LIT("-0"), (F.col("k") % 9 + 1), LIT("-03")).alias("start_date"), F.when(F.col("k") > 2, "2020-01-01").alias("end_date"), "genres", F.when(F.col("k") > 3, "Studio").alias("studio"), LIT("su").alias("studio_url"),
        F.array(F.struct(LIT("Sequel").alias("relation_type"), F.col("title"), LIT("u").alias("url"))).alias("anime_relations"), F.col("source").alias("url"), F.struct(F.when(F.col("k") > 2, F.col("k") / 2).alias("score"), LIT(None).cast("bigint").alias("rank")).alias("statistics"),
    )
    return mappers.anisearch_anime(raw).select(
        joined("sources").alias("sources"), "title", "type", "source_material", "year", "season", joined("genres").alias("genres"), fields(F.col("studios"), "name").alias("studios"), fields(F.col("related_anime"), "relation", "source").alias("related"), F.try_element_at("statistics", LIT("anisearch"))["score"].alias("score"),
        F.when(F.col("status").isin("FINISHED", "ONGOING"), F.col("status")).alias("status"),
    )


def map_anisearch_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "mal_characters")
    roles = F.transform("animeography", lambda t: F.struct(t.alias("title"), LIT("u").alias("url"), LIT("Secondary Character").alias("role")))
    raw = c.select("name", "name_native", F.col("fans").alias("favorites"), "role", roles.alias("anime_roles"), F.when(F.col("id") % 2 == 0, F.array(F.struct(LIT("").alias("title"), LIT("u").alias("url"), LIT("").alias("role")), F.struct(LIT("Own").alias("title"), LIT("u").alias("url"), LIT("").alias("role")))).alias("anime_ography"),
                   LIT("i").alias("image"), F.array(LIT("s"), LIT("i")).alias("screenshot_images"), "voice_actors", F.create_map(LIT("age"), F.col("age"), LIT("empty"), LIT("")).alias("attributes"), F.concat(LIT("as/"), F.col("id")).alias("source"))
    return mappers.anisearch_character(raw).select(F.col("sources")[0].alias("source"), "name", "name_native", "favorites", joined("roles").alias("roles"), joined("images").alias("images"), fields(F.col("animeography"), "title").alias("ography"), joined(F.map_keys("attributes")).alias("attributes"))


def map_anisearch_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir)
    raw = e.select(F.col("number").alias("episode_number"), F.when(F.col("row_id") % 4 == 0, "").otherwise(F.col("title_en")).alias("title"), F.col("title_ja").alias("title_japanese"), F.col("day").alias("aired"), F.col("is_filler"), F.concat(LIT("e/"), F.col("row_id")).alias("source"))
    return mappers.anisearch_episode(raw).select(F.col("sources")[0].alias("source"), "episode_number", "title", "title_japanese", stamp(F.col("aired")).alias("aired"), "filler")


def map_planet_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    entry = lambda title, subtype: F.struct(LIT(title).alias("title"), LIT("/anime/x").alias("url"), LIT(subtype).cast("string").alias("relation_subtype"))
    raw = r.select(
        F.col("title").alias("name"), F.when(F.col("k") > 5, F.col("type")).alias("schema_type"), F.lower("type").alias("type_raw"), F.col("synopsis").alias("description"), F.when(F.col("k") > 4, F.col("season")).alias("season"), F.concat(F.coalesce("year", LIT(2001)), LIT("-0"), (F.col("k") % 9 + 1), LIT("-03")).alias("start_date"),
        F.col("n").alias("number_of_episodes"), F.when(F.col("k") == 2, "Other name").alias("alt_title"), "genres", F.array(LIT("Tag"), LIT("Drama")).alias("tags"), F.array(LIT("Fund")).alias("studios"), F.array(entry("A", "Sequel"), entry("B", None)).alias("related_anime"),
        F.array(entry("C", "Original Manga"), entry("D", "Spin off")).alias("related_manga"), F.concat(LIT("slug"), F.col("id")).alias("slug"), F.struct((F.col("k") / 2).alias("rating_value"), F.col("id").alias("rating_count")).alias("aggregate_rating"),
    )
    s = F.col("statistics")["animeplanet"]
    return mappers.planet_anime(raw).select(
        F.col("sources")[0].alias("source"), "title", "type", "synopsis", "season", "year", "episode_count", joined("synonyms").alias("synonyms"), joined("tags").alias("tags"), fields(F.col("producers"), "name").alias("producers"),
        fields(F.col("related_anime"), "relation", "title", "source").alias("related"), fields(F.col("related_source_material"), "relation", "title").alias("material"), s["score"].alias("score"), s["scored_by"].alias("scored_by"),
    )


def map_planet_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "anilist_characters")
    role = lambda title, kind: F.struct(LIT(title).alias("title"), LIT("u").alias("url"), LIT(kind).alias("role"))
    raw = c.select("name", F.col("alternative").alias("alt_names"), F.array(LIT("calm")).alias("tags"), F.array(role("A", "main"), role("B", "Minor")).alias("anime_roles"), F.array(role("C", "Main")).alias("manga_roles"), "gender", F.create_map(LIT("Eye Color"), LIT("red"), LIT("Gender"), LIT("?")).alias("metadata"),
                   F.concat("voice_actors", "voice_actors").alias("voice_actors"), F.concat(LIT("ap/"), F.col("id")).alias("url"))
    a = lambda name: F.try_element_at("attributes", LIT(name)).alias(name)
    return mappers.planet_character(raw).select(F.col("sources")[0].alias("source"), "name", joined("name_variations").alias("variations"), joined("traits").alias("traits"), joined("roles").alias("roles"), a("gender"), a("eye_color"), F.size("voice_actors").alias("voices"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, LIT("&"), LIT("&amp;")), LIT("<"), LIT("&lt;")), LIT(">"), LIT("&gt;"))


def page_mal_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written from records and read back by their schema, with the pieces that are read by pattern."""
    r = _records(spark, sf_dir).filter("title is not null")
    genres = F.array_join(F.transform(F.coalesce("genres", F.array().cast("array<string>")), lambda g: F.concat(LIT('<span itemprop="genre" style="display:none">'), _escaped(g), LIT("</span>"))), "\n")
    html = F.concat(
        LIT('<html><body><h1 class="title-name h1_bold"><strong>'), _escaped(F.col("title")), LIT('</strong></h1><p itemprop="description">'), _escaped(F.coalesce("synopsis", LIT(""))), LIT('</p><div class="score-label score-8">'), F.col("k"), LIT("</div>"),
        LIT('<div class="spaceit_pad"><span class="dark_text">Studios:</span> <a href="/x">Studio '), F.col("k"), LIT('</a></div><div><span class="dark_text">Type:</span> N/A </div>'), genres, LIT("<h2>Episodes (1,"), F.lpad(F.col("k").cast("string"), 3, "0"), LIT("/Unknown)</h2></body></html>"),
    )
    read = extract.extract(r.select("id", html.alias("html")), extract.MAL_ANIME, "id", "html")
    pieces = r.select("id", extract.sidebar_field(html, "Studios").alias("studio"), extract.sidebar_field(html, "Type").alias("kind"), extract.episode_count(html).alias("episode_count"))
    return read.join(pieces, "id").select("id", "title", "synopsis", "score", joined("genres").alias("genres"), "studio", "kind", "episode_count")


def page_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, subtitles, addresses and paths as pages write them, taken apart."""
    e = _episodes(spark, sf_dir).filter("title_en is not null and not contains(title_en, '(') and not contains(title_en, ')')")
    info = extract.episode_title_info(F.concat(LIT("#"), F.col("row_id"), LIT(" - "), F.trim("title_en"), F.when(F.col("is_filler"), " Filler").otherwise("")), LIT("Romaji (題)"))
    video = extract.trailer(F.concat(LIT("https://www.youtube.com/embed/video"), F.col("row_id"), LIT("?a=1")))
    name = extract.name_and_native(F.concat(F.trim("title_en"), LIT(" (名)")))
    return e.select(
        "row_id", info["title"].alias("title"), info["romaji"].alias("romaji"), info["japanese"].alias("japanese"), info["filler"].alias("filler"), video["source"].alias("video"), name["name"].alias("name"), name["native"].alias("native"),
        extract.season_from_path(F.concat(LIT("/anime/seasons/"), F.when(F.col("row_id") % 2 == 0, "Fall").otherwise("none"), LIT("-2020"))).alias("season"), extract.alternative_title(F.concat(LIT("Alt title: "), F.trim("title_en"))).alias("alternative"),
    )


def xml_anime(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).filter("title is not null")
    xml = F.concat(
        LIT('<anime id="'), F.col("id"), LIT('"><type>'), F.coalesce(F.col("type"), LIT("Other")), LIT("</type><episodecount>"), F.col("n"), LIT("</episodecount><startdate>2020-01-02</startdate>"), LIT('<titles><title type="main">'), _escaped(F.trim("title")),
        LIT('</title><title type="synonym">Syn '), F.col("k"), LIT('</title><title type="official" xml:lang="en">En '), F.col("k"), LIT("</title></titles><ratings><permanent count=\""), F.col("id"), LIT('">'), F.col("k"), LIT(".5</permanent></ratings>"),
        LIT('<relatedanime><anime id="9" type="Sequel">Next</anime></relatedanime><characters><character id="1" type="main character in"><name>N</name></character></characters></anime>'),
    )
    x = extract.anime_from_xml(r.select("id", xml.alias("xml")))
    return x.select("id", "title", "title_english", joined("synonyms").alias("synonyms"), "type", "episode_count", "start_date", "score", "scored_by", F.size("characters").alias("characters"), F.col("related")[0]["_type"].alias("relation"))


def _html(*parts: Column | str) -> Column:
    return F.concat(*[LIT(p) if isinstance(p, str) else F.coalesce(p, LIT("")) for p in parts])


def page_mal_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "mal_characters").filter("name is not null")
    row = lambda t: _html('<tr><td><a href="/anime/1/x"><img data-src="p"></a></td><td><a href="https://myanimelist.net/anime/1/x">', _escaped(t), "</a><small>", F.col("role"), "</small></td></tr>")
    actor = lambda v: _html('<tr><td><a href="https://myanimelist.net/people/5/y">', _escaped(v["name"]), "</a><small>", v["language"], "</small></td></tr>")
    table_of = lambda rows: _html("<table>", F.array_join(rows, "\n"), "</table>")
    html = _html(
        '<div id="content"><h2 class="normal_header">', _escaped(F.col("name")), " (名)</h2><div class=\"normal_header\">Animeography</div>", table_of(F.transform(F.coalesce("animeography", F.array().cast("array<string>")), row)),
        '<div class="normal_header">Mangaography</div><table><tr><td><a href="/manga/2/z">Book</a><small>Main</small></td></tr></table><div class="normal_header">Voice Actors</div>', table_of(F.transform("voice_actors", actor)), "</div>",
    )
    x = extract.extract(c.select("id", html.alias("html")), extract.MAL_CHARACTER, "id", "html")
    name = extract.name_and_native(F.col("header"))
    return x.select("id", name["name"].alias("name"), name["native"].alias("native"), fields(extract.named_rows(F.col("animeography")), "title", "role").alias("ography"), fields(F.col("mangaography"), "title", "role", "url").alias("manga"), fields(F.col("voice_actors"), "name", "language").alias("voices"))


def page_mal_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir)
    html = _html(
        '<h2 class="fs18">#', F.col("number").cast("string"), " - T", F.col("row_id").cast("string"), F.when(F.col("is_filler"), LIT(" Filler")), '</h2><p class="fn-grey2">Romaji (題)</p><div class="di-tc ar">Duration: 00:24:10 Aired: Jan 5, 2020</div>',
        '<table><tr><td><a class="fw-b" href="/character/7/n">Hero</a> <small>Main</small><p class="pb8"><a href="/people/3/v">Voice</a> (Japanese)</p></td></tr><tr><td><a class="fw-b" href="/people/', F.col("row_id").cast("string"), '/s">Staff</a><p class="pr12">Director</p></td></tr></table>',
    )
    x = extract.extract(e.select("row_id", html.alias("html")), extract.MAL_EPISODE, "row_id", "html")
    info = extract.episode_title_info(F.col("header"), F.col("subtitle"))
    kept = lambda c: F.filter(c, lambda r: r["name"].isNotNull())
    return x.select("row_id", info["title"].alias("title"), info["romaji"].alias("romaji"), info["filler"].alias("filler"), fields(kept(F.col("characters")), "name", "role", "voice").alias("characters"), fields(kept(F.col("staff")), "name", "role", "url").alias("staff"), F.regexp_extract("box", r"Aired: (\w+ \d+, \d+)", 1).alias("aired"))


def page_planet_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "anilist_characters").filter("name is not null")
    voice = lambda v: _html('<div class="flag flag', F.when(v["language"] == "Japanese", "JP").otherwise("XX"), '"><a href="/people/y">', _escaped(v["name"]), "</a></div>")
    row = lambda t: _html('<tr><td><a href="/anime/x"><img></a><a href="/anime/x">', _escaped(t), "</a></td><td>Main</td><td>", F.array_join(F.transform("voice_actors", voice), ""), "</td></tr>")
    html = _html(
        '<h1 itemprop="name">', _escaped(F.col("name")), '</h1><h2 class="aka">Aka: One, Two</h2><section class="pure-g entryBar"><div>Gender: ', F.coalesce("gender", LIT("?")), '</div><div>Hair Color: Dark Red</div></section><h3 class="EntryMetadata__title">Age</h3><div class="EntryMetadata__value">', F.coalesce("age", LIT(" ")),
        '</div><h3 class="EntryMetadata__title">Eyes</h3><div class="EntryMetadata__value">red</div><div itemprop="description"><p>Some <b>text</b>.</p></div><a href="/characters/tags/calm">Calm</a><a href="/characters/tags/tall">Tall</a><h3>Anime Roles</h3><table><tbody>',
        F.array_join(F.transform(F.coalesce("media_titles", F.array().cast("array<string>")), row), ""), '</tbody></table><h3>Manga Roles</h3><table><tbody><tr><td><a href="/manga/b">Book</a></td><td></td></tr></tbody></table><a href="/characters/top-loved">#1,157</a>',
    )
    x = extract.extract(c.select("id", html.alias("html")), extract.PLANET_CHARACTER, "id", "html")
    bar, more = extract.entry_bar(F.col("bar")), extract.titled_values(F.col("titles"), F.col("values"))
    roles, manga = extract.planet_roles(F.col("anime_roles")), extract.planet_roles(F.col("manga_roles"))
    return x.select(
        "id", "name", joined(extract.listed_names(F.col("aka"))).alias("aka"), bar["gender"].alias("gender"), bar["hair_color"].alias("hair"), F.try_element_at(more, LIT("Age")).alias("age"), F.try_element_at(more, LIT("Eyes")).alias("eyes"), "description", joined("tags").alias("tags"),
        fields(roles, "title", "role").alias("roles"), fields(F.flatten(F.transform(roles, lambda r: r["voice_actors"])), "name", "language").alias("voices"), fields(manga, "title", "role", "url").alias("manga"), F.regexp_replace(F.regexp_extract("loved", r"([\d,]+)", 1), ",", "").cast("int").alias("loved"),
    )


def page_anisearch_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _actors(spark, sf_dir, "mal_characters").filter("name is not null")
    actor = lambda v: _html('<a href="person/1">', _escaped(v["name"]), "</a>")
    cover = lambda t: _html('<li><a href="anime/5"><span class="title">', _escaped(t), "</span></a></li>")
    html = _html('<h1 id="htitle">', _escaped(F.col("name")), '</h1><ul class="xlist infoblock"><li><div class="title" lang="ja"><span class="grey">', F.col("name_native"), "</span></div>", F.array_join(F.transform("voice_actors", actor), " "), '</li></ul><ul class="cloud"><li><a class="gt">Calm</a></li></ul><ul class="covers">', F.array_join(F.transform(F.coalesce("animeography", F.array().cast("array<string>")), cover), ""), "</ul>")
    x = extract.extract(c.select("id", html.alias("html")), extract.ANISEARCH_CHARACTER, "id", "html")
    return x.select("id", "name", joined("tags").alias("tags"), fields(extract.block_actors(F.col("blocks")), "name", "language").alias("voices"), fields(extract.roles_of(F.col("ography")), "title", "url", "role").alias("roles"))


def page_anisearch_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir)
    row = _html(
        '<tr data-episode="true"><th itemprop="episodeNumber"><b>', F.col("number").cast("string"), F.when(F.col("is_filler"), LIT("<br><span>Filler</span>")), '</b></th><td data-title="Runtime"><div lang="ja">24 min</div></td><td data-title="Date of Original Release"><div lang="ja">', F.col("day"),
        '</div></td><td data-title="Title"><div lang="en"><span itemprop="name">E', F.col("row_id").cast("string"), '</span></div><div lang="ja"><span itemprop="name">Romaji (題)</span></div></td></tr>',
    )
    html = _html('<table class="responsive episodes"><tr><th>Head</th></tr>', row, '</table><section id="relations_anime"><table><tbody><tr><th scope="row"><span>Sequel</span><a href="anime/9">Next</a></th></tr></tbody></table></section>')
    pages = e.select("row_id", html.alias("html"))
    related = extract.extract(pages, extract.ANISEARCH_RELATIONS, "row_id", "html").select("row_id", fields(F.col("anime"), "relation_type", "title", "url").alias("related"), F.size("manga").alias("manga"))
    rows = extract.extract(pages, extract.ANISEARCH_EPISODES, "row_id", "html").select("row_id", F.explode(extract.episode_rows(F.col("rows"))).alias("e")).select("row_id", "e.*")
    return rows.join(related, "row_id")


QUERIES = {f.__name__: f for f in (page_mal_character, page_mal_episode, page_planet_character, page_anisearch_character, page_anisearch_episodes, map_mal_anime, map_mal_character, map_mal_episode, map_anilist_anime, map_anilist_character, map_kitsu_anime, map_kitsu_character, map_kitsu_episode, map_schedule_anime, map_anisearch_anime, map_anisearch_character, map_anisearch_episode, map_planet_anime, map_planet_character, page_mal_anime, page_pieces, xml_anime)}


def _norm(column: str, values: ValueSet) -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.spellings.items())
    return f"CASE WHEN {column} IN ({', '.join(map(quoted, values.members))}) THEN {column} ELSE coalesce(CASE lower({column}) {whens} END, {quoted(values.default)}) END"


_R = "r AS (SELECT record_id AS id, anime_key, title, type, status, synopsis, genres, anime_season.year AS year, anime_season.season AS season, coalesce(len(episodes), 0) AS n, sources[1] AS source, (record_id % 10)::INT AS k FROM anime_records)"
_E = "e AS (SELECT row_id, title_en, title_ja, is_filler, try_cast(nullif(regexp_extract(episode_number_raw, '([0-9]{1,6})', 1), '') AS INT) AS number, strftime(fetched_at, '%Y-%m-%d') AS day FROM episodes_raw)"
_TYPE, _STATUS, _SEASON = _norm("type", enums.MEDIA_TYPE), _norm("status", enums.STATUS), _norm("season", enums.SEASON)
_GENRES = "array_to_string(coalesce(genres, []), '|')"
_VOICES = "array_to_string(list_transform(coalesce(voice_actors, []), lambda v: concat_ws('/', v.name, v.language)), '|')"
_JAPAN = "strftime(day::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S')"
_MONTH_SEASON = "CASE WHEN k % 9 + 1 IN (1, 2) THEN 'WINTER' WHEN k % 9 + 1 IN (3, 4, 5) THEN 'SPRING' WHEN k % 9 + 1 IN (6, 7, 8) THEN 'SUMMER' ELSE 'FALL' END"


def _said(column: str) -> str:
    """What a page shows of a text."""
    return rf"nullif(trim(regexp_replace({column}, '[\s\x{{3000}}\x{{A0}}]+', ' ', 'g')), '')"


def _voices_said(language: str) -> str:
    return f"array_to_string(list_transform(coalesce(voice_actors, []), lambda v: concat_ws('/', {_said('v.name')}, {language})), '|')"


SQL = {
    "page_mal_character": f"""SELECT mal_id AS id, {_said("name")} AS name, '名' AS native, array_to_string(list_transform(list_filter(coalesce(animeography, []), lambda t: trim(t) <> ''), lambda t: concat_ws('/', {_said("t")}, nullif(role, ''))), '|') AS ography,
        'Book/Main//manga/2/z' AS manga, {_voices_said("nullif(v.language, '')")} AS voices FROM mal_characters WHERE name IS NOT NULL""",
    "page_mal_episode": f"""WITH {_E} SELECT row_id, 'T' || row_id AS title, 'Romaji' AS romaji, coalesce(is_filler, false) AS filler, 'Hero/Main/Voice (Japanese)' AS characters, 'Staff/Director//people/' || row_id || '/s' AS staff, 'Jan 5, 2020' AS aired FROM e""",
    "page_planet_character": f"""SELECT anilist_id AS id, {_said("name")} AS name, 'One|Two' AS aka, coalesce(gender, '?') AS gender, 'Dark Red' AS hair, nullif(trim(age), '') AS age, 'red' AS eyes, 'Some text.' AS description, 'Calm|Tall' AS tags,
        array_to_string(list_transform(list_filter(coalesce(media_titles, []), lambda t: trim(t) <> ''), lambda t: {_said("t")} || '/Main'), '|') AS roles,
        array_to_string(flatten(list_transform(list_filter(coalesce(media_titles, []), lambda t: trim(t) <> ''), lambda t: list_transform(list_filter(coalesce(voice_actors, []), lambda v: v.language = 'Japanese'), lambda v: concat_ws('/', {_said("v.name")}, 'jp')))), '|') AS voices,
        'Book//manga/b' AS manga, 1157 AS loved FROM anilist_characters WHERE name IS NOT NULL""",
    "page_anisearch_character": f"""SELECT mal_id AS id, {_said("name")} AS name, 'Calm' AS tags, {_voices_said("'Japanese'")} AS voices, array_to_string(list_transform(list_filter(coalesce(animeography, []), lambda t: trim(t) <> ''), lambda t: {_said("t")} || '/anime/5'), '|') AS roles FROM mal_characters WHERE name IS NOT NULL""",
    "page_anisearch_episodes": f"""WITH {_E} SELECT row_id, number AS episode_number, coalesce(is_filler, false) AS is_filler, false AS is_recap, 1440 AS duration, day AS aired, 'E' || row_id AS title, 'Romaji' AS title_romaji, '題' AS title_japanese, 'Sequel/Next/anime/9' AS related, 0 AS manga FROM e WHERE number IS NOT NULL""",
    "map_mal_anime": f"""WITH {_R} SELECT source, title, {_TYPE} AS type, {_STATUS} AS status, year::INT AS year, {_SEASON} AS season, n AS episode_count, synopsis, CASE WHEN k = 1 THEN 'Made late.' END AS background, {_GENRES} AS genres,
        'Studio ' || k AS studios, CASE WHEN k < 5 THEN 'SIDE_STORY/u1' ELSE 'PREQUEL/u1' END AS anime, 'ADAPTATION/u2' AS material, CASE WHEN k > 2 THEN id END AS scored_by FROM r""",
    "map_mal_character": f"""SELECT 'https://mal.example/character/' || mal_id AS source, name, name_native, favorites, CASE WHEN len(animeography) > 0 AND role IS NOT NULL THEN {_norm("role", enums.ROLE)} ELSE '' END AS roles, 'b|a' AS images, {_VOICES} AS voices,
        array_to_string(list_transform(coalesce(animeography, []), lambda t: concat_ws('/', t, role)), '|') AS ography, nullif(age, '') AS age, nullif(gender, '') AS gender FROM mal_characters""",
    "map_mal_episode": f"WITH {_E} SELECT 'https://mal.example/e/' || row_id AS source, number AS episode_number, title_en AS title, title_ja AS title_japanese, {_JAPAN} AS aired, coalesce(is_filler, false) AS filler, false AS recap FROM e",
    "map_anilist_anime": f"""WITH {_R} SELECT 'https://anilist.co/anime/' || id || CASE WHEN k > 6 AND anime_key IS NOT NULL THEN '|https://myanimelist.net/anime/' || anime_key ELSE '' END AS sources, coalesce(title, '') AS title, CASE WHEN k = 3 THEN title END AS title_english,
        {_TYPE} AS type, {_STATUS} AS status, n AS episode_count, 1440 AS duration, year::INT AS year, {_SEASON} AS season, {_GENRES} AS genres, CASE WHEN k < 5 THEN 'Ensemble' ELSE '' END AS tags, CASE WHEN k < 5 THEN 'Shounen' ELSE '' END AS demographics,
        CASE WHEN k < 5 THEN 'Gore' ELSE '' END AS warnings, CASE WHEN k < 5 THEN 'Pirates/about' ELSE '' END AS themes, 'Own' AS studios, 'Fund' AS producers, 'Stream/https://s' AS streaming, 'https://i' AS info, CASE WHEN k < 3 THEN 'https://youtu.be/abc' END AS trailer,
        CASE WHEN k % 2 = 0 THEN 'l' ELSE 'xl' END AS covers, least(10.0, k * 1.1)::DOUBLE AS score, id AS members FROM r""",
    "map_anilist_character": f"""SELECT 'https://anilist.co/character/' || anilist_id AS source, coalesce(name, '') AS name, name_native, array_to_string(coalesce(alternative, []), '|') AS variations, favourites AS favorites,
        CASE anilist_id % 3 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'SUPPORTING' ELSE 'UNKNOWN' END AS roles, gender, coalesce(age, '0') AS age, '170' AS height, {_VOICES} AS voices FROM anilist_characters""",
    "map_kitsu_anime": f"""WITH {_R} SELECT 'https://kitsu.app/anime/' || CASE WHEN k > 4 THEN 'slug-' ELSE '' END || id AS sources, coalesce(CASE WHEN k <> 4 THEN title END, 'Second') AS title, '題' AS title_japanese, 'Tom & ' || k AS synopsis, {_TYPE} AS type, {_STATUS} AS status,
        CASE WHEN k < 5 THEN 'PG - Children' ELSE 'Rx - Hentai' END AS rating, {_MONTH_SEASON} AS season, coalesce(year, 2001)::INT AS year, n AS episode_count, 1200 AS duration, CASE WHEN k > 0 THEN round(least(10.0, k * 1.05), 6)::DOUBLE END AS score, id AS members FROM r""",
    "map_kitsu_character": f"""SELECT 'https://kitsu.app/characters/c-' || mal_id AS source, CASE WHEN mal_id % 2 = 0 AND name IS NOT NULL THEN name ELSE upper(name) END AS name, name_native, gender AS description, {_norm("role", enums.ROLE)} AS roles,
        array_to_string(list_transform(coalesce(voice_actors, []), lambda v: concat_ws('/', v.name, coalesce(map_extract_value(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in mappers.LOCALES.items())}}}, lower(v.language)), nullif(v.language, '')))), '|') AS voices FROM mal_characters""",
    "map_kitsu_episode": f"""WITH {_E} SELECT coalesce(number, 0) AS episode_number, coalesce(title_en, CASE WHEN row_id % 3 = 0 THEN 'US' END, 'Episode ' || coalesce(number, 0)) AS title, title_ja AS title_japanese, CASE WHEN row_id % 2 = 0 THEN 'D' ELSE 'S' END AS synopsis, {_JAPAN} AS aired,
        1440 AS duration, CASE WHEN row_id % 5 > 0 AND number > 0 THEN 'https://kitsu.app/anime/s' || row_id || '/episodes/' || number ELSE '' END AS sources FROM e""",
    "map_schedule_anime": f"""WITH {_R} SELECT 'https://animeschedule.net/anime/r-' || id || '|https://mal.example/1|https://kitsu.example/2' AS sources, title, CASE WHEN k = 1 THEN 'E' END AS title_english, k::VARCHAR AS synopsis, {_TYPE} AS type, CASE WHEN k < 4 THEN 'LIGHT NOVEL' ELSE 'UNKNOWN' END AS source_material,
        {_STATUS} AS status, n AS episode_count, 1500 AS duration, year::INT AS year, {_SEASON} AS season, {_GENRES} AS genres, CASE WHEN k >= 3 THEN '2020-05-06 07:08:09' END AS premier, CASE WHEN k > 5 THEN round(k * 0.9, 6)::DOUBLE END AS score, CASE WHEN k > 5 THEN id END AS scored_by FROM r""",
    "map_anisearch_anime": f"""WITH {_R} SELECT coalesce(source, '') AS sources, CASE WHEN k > 1 AND title <> '' THEN title ELSE '題' || k END AS title, {_TYPE} AS type, CASE WHEN k > 4 THEN 'MANGA' ELSE 'UNKNOWN' END AS source_material, coalesce(year, 2001)::INT AS year, {_MONTH_SEASON} AS season, {_GENRES} AS genres,
        CASE WHEN k > 3 THEN 'Studio' END AS studios, 'SEQUEL/u' AS related, CASE WHEN k > 2 THEN k / 2.0 END AS score,
        CASE WHEN make_timestamp(coalesce(year, 2001)::BIGINT, (k % 9 + 1)::BIGINT, 3, 0, 0, 0.0) - INTERVAL 9 HOUR > now()::TIMESTAMP THEN NULL WHEN k > 2 THEN 'FINISHED' ELSE 'ONGOING' END AS status FROM r""",
    "map_anisearch_character": f"""SELECT 'as/' || mal_id AS source, name, name_native, favorites, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN role IS NULL THEN [] ELSE [{_norm("role", enums.ROLE)}] END, CASE WHEN len(animeography) > 0 THEN ['SUPPORTING'] ELSE [] END))), '|') AS roles, 'i|s' AS images,
        CASE WHEN mal_id % 2 = 0 THEN 'Own' ELSE array_to_string(list_filter(coalesce(animeography, []), lambda t: length(t) > 0), '|') END AS ography, CASE WHEN age <> '' THEN 'age' ELSE '' END AS attributes FROM mal_characters""",
    "map_anisearch_episode": f"""WITH {_E} SELECT 'e/' || row_id AS source, number AS episode_number, coalesce(CASE WHEN row_id % 4 > 0 THEN nullif(title_en, '') END, 'Episode ' || number) AS title, title_ja AS title_japanese, {_JAPAN} AS aired, is_filler AS filler FROM e""",
    "map_planet_anime": f"""WITH {_R} SELECT 'https://www.anime-planet.com/anime/slug' || id AS source, title, CASE WHEN k > 5 THEN {_TYPE} ELSE {_norm("lower(type)", enums.MEDIA_TYPE)} END AS type, synopsis, coalesce(CASE WHEN k > 4 THEN {_SEASON} END, {_MONTH_SEASON}) AS season, coalesce(year, 2001)::INT AS year, n AS episode_count,
        CASE WHEN k = 2 THEN 'Other name' ELSE '' END AS synonyms, array_to_string(list_concat(list_filter(coalesce(genres, []), lambda g, i: list_position(genres, g) = i), list_filter(['Tag', 'Drama'], lambda t: NOT list_contains(coalesce(genres, []), t))), '|') AS tags, 'Fund' AS producers,
        'SEQUEL/A/https://www.anime-planet.com/anime/x|{enums.RELATION.spellings.get("same franchise", "OTHER")}/B/https://www.anime-planet.com/anime/x' AS related, 'ADAPTATION/C|OTHER/D' AS material, k::DOUBLE AS score, id AS scored_by FROM r""",
    "map_planet_character": """SELECT 'ap/' || anilist_id AS source, name, array_to_string(coalesce(alternative, []), '|') AS variations, 'calm' AS traits, 'BACKGROUND|MAIN' AS roles, coalesce(gender, '?') AS gender, 'red' AS eye_color, len(list_distinct(coalesce(voice_actors, [])))::INT AS voices FROM anilist_characters""",
    "page_mal_anime": f"""WITH {_R} SELECT id, nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(coalesce(synopsis, ''), '[\\s\\x{{A0}}\\x{{3000}}\\x{{2007}}\\x{{2009}}\\x{{202F}}]+', ' ', 'g')), '') AS synopsis, k::VARCHAR AS score, array_to_string(list_filter(coalesce(genres, []), lambda g: trim(g) <> ''), '|') AS genres,
        'Studio ' || k AS studio, NULL::VARCHAR AS kind, (1000 + k)::INT AS episode_count FROM r WHERE title IS NOT NULL""",
    "page_pieces": f"""WITH {_E}, t AS (SELECT *, nullif(trim(title_en), '') AS said FROM e WHERE title_en IS NOT NULL AND NOT contains(title_en, '(') AND NOT contains(title_en, ')')) SELECT row_id, coalesce(said, CASE WHEN is_filler THEN 'Filler' END) AS title, 'Romaji' AS romaji, '題' AS japanese, coalesce(is_filler, false) AS filler,
        'https://www.youtube.com/watch?v=video' || row_id AS video, said AS name, '名' AS native, CASE WHEN row_id % 2 = 0 THEN 'FALL' END AS season, said AS alternative FROM t""",
    "xml_anime": f"""WITH {_R} SELECT id, trim(title) AS title, 'En ' || k AS title_english, 'Syn ' || k AS synonyms, coalesce(type, 'Other') AS type, n AS episode_count, '2020-01-02' AS start_date, k + 0.5::DOUBLE AS score, id AS scored_by, 1 AS characters, 'Sequel' AS relation FROM r WHERE title IS NOT NULL""",
}
