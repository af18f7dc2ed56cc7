"""Functions of texts, dates, lists, addresses and relations over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import arrays, dates, enums, numbers, text
from catalith.operators import relations
from catalith.plans.mapper_queries import _html, _norm, fields, joined, stamp
from catalith.runtime import table

LIT = F.lit


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "anime_records").select("record_id", "anime_key", "title", "type", "genres", (F.col("record_id") % 10).cast("int").alias("k"))


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 4).cast("int").alias("k"))
    day = lambda form: F.date_format("d", form)
    written = F.when(F.col("k") == 0, day("MMM d, yyyy")).when(F.col("k") == 1, day("d. MMM yyyy")).when(F.col("k") == 2, day("yyyy-MM-dd")).otherwise(day("yyyy"))
    slot = dates.broadcast_parts(_html(day("EEEE"), F.when(F.col("k") < 2, "s at "), F.when(F.col("k") >= 2, " "), "23:15", F.when(F.col("k") != 3, " (JST)")))
    ends = dates.aired_range(F.concat(day("MMM d, yyyy"), LIT(" to "), F.when(F.col("k") == 0, "?").otherwise(day("yyyy"))))
    season = dates.premiered(F.concat(F.element_at(F.array(*[LIT(s) for s in ("Winter", "spring", "Fall", "nothing")]), F.col("k") + 1), LIT(" "), day("yyyy")))
    return o.select(
        "o_orderkey", dates.iso_date(written).alias("iso"), dates.offset_time_to_utc(F.concat(day("yyyy-MM-dd"), LIT("T00:30:00+09:00"))).alias("utc"), stamp(dates.parse_date(day("dd.MM.yyyy"))).alias("parsed"), slot["day"].alias("slot_day"), slot["time"].alias("slot_time"), slot["zone"].alias("slot_zone"),
        ends["start"].alias("start"), ends["end"].alias("end"), season["season"].alias("season"), season["year"].alias("year"), dates.runtime_seconds(F.concat(F.col("k") + 20, LIT(" min"))).alias("runtime"),
        dates.fuzzy_date(F.year("d"), F.when(F.col("k") > 0, F.month("d")), F.when(F.col("k") > 1, F.day("d"))).alias("fuzzy"),
    )


def address_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    i = F.col("record_id").cast("string")
    mal = F.concat(LIT("https://myanimelist.net/anime/"), i, F.when(F.col("k") < 5, F.concat(LIT("/Some_Name"), LIT("?q=1"))).otherwise(""))
    seen = text.mal_anime_url(mal)
    ids = text.platform_ids(F.array(F.concat(LIT("https://anidb.net/anime/"), i), mal, F.concat(LIT("https://anilist.co/anime/"), F.col("k")), LIT("https://kitsu.app/anime/x")))
    one = lambda name: F.try_element_at(ids, LIT(name)).alias(name)
    return r.select(
        "record_id", text.absolute_url(F.when(F.col("k") < 3, F.concat(LIT("/a/"), i)).when(F.col("k") < 6, F.concat(LIT("http://h/"), i)), "https://b.example/").alias("whole"), text.planet_slug(F.concat(LIT("https://www.anime-planet.com/anime/s-"), i, LIT("/x"))).alias("slug"),
        text.planet_url(F.concat(LIT("/s-"), i)).alias("planet"), seen["url"].alias("mal"), seen["has_slug"].alias("named"), one("anidb_id"), one("anilist_id"), one("kitsu_url"), one("livechart_id"),
        text.title_from_url(mal).alias("title"), text.route_title(F.concat(LIT("a-tale-of-"), F.col("k"))).alias("route"), text.planet_title(F.concat(LIT("Tale "), F.col("k"), LIT(" 2001-01-02 - 2002-02-03 TV"))).alias("clean"),
        text.percent_normal(F.concat(LIT("https://h/%e3%81%82/a b?x="), F.col("k"))).alias("percent"),
    )


def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    name = F.trim(F.coalesce("title", LIT("")))
    return r.select(
        "record_id", text.fill_missing(F.when(F.col("k") < 3, "?").when(F.col("k") < 5, F.col("type")), LIT("filled")).alias("filled"), text.artifact_name(F.concat(LIT("!Tale: "), F.col("k"), LIT("th part!"))).alias("artifact"), text.type_from_details(F.concat(F.coalesce("type", LIT("x")), LIT(", 12"))).alias("kind"),
        text.tags_to_spaces(F.concat(LIT("<p>a"), F.col("k"), LIT("</p>b\r"))).alias("plain"), text.is_katakana(F.when(F.col("k") < 5, "ア").otherwise("あ")).alias("katakana"), text.is_hiragana(F.when(F.col("k") < 5, "ア").otherwise("あ")).alias("hiragana"),
        text.strip_markup(F.concat(LIT("<b>CafÃ© "), F.col("k"), LIT("</b> &amp; x"))).alias("repaired"), text.strip_preamble(F.concat(LIT("Age: "), F.col("k"), LIT("  A tale begins."))).alias("prose"), text.romaji(LIT("アニメ")).alias("romaji"),
        F.round(text.edit_similarity(name, F.concat(name, LIT("x"))), 9).alias("edit"), text.token_set_similarity(LIT("one two"), F.concat(LIT("two one "), F.col("k"))).alias("token_set"), text.token_sort_similarity(LIT("b a c"), LIT("c b a")).alias("token_sort"),
        F.round(text.phonetic_similarity(LIT("abcd"), LIT("abc")), 9).alias("phonetic"), text.unicode_fold(F.concat(LIT("SS"), F.col("k"))).alias("folded"),
    )


def list_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    k = F.col("k").cast("string")
    ranges = arrays.episode_ranges(F.concat(LIT("eps 1-3"), k, LIT(", 49"), k, LIT(", 1139-")))
    song = arrays.theme_song(F.when(F.col("k") < 5, F.concat(LIT('#1: "Song '), k, LIT('" by Band (eps 1-12)'))).otherwise(F.concat(LIT("Song "), k)))
    old, new = F.array(LIT("a"), LIT("b")), F.when(F.col("k") < 5, F.array(LIT("b"), LIT("a"))).otherwise(F.array(LIT("b")))
    return r.select(
        "record_id", fields(F.transform(ranges, lambda x: F.struct(x["start"].cast("string").alias("s"), F.coalesce(x["end"].cast("string"), LIT("open")).alias("e"))), "s", "e").alias("ranges"), song["title"].alias("song"), song["artist"].alias("artist"), song["episodes"].alias("episodes"),
        arrays.same_multiset(old, new).alias("same"), joined(arrays.changed_fields({"list": (old, new, True), "k": (F.col("k"), LIT(1), False)})).alias("changed"), joined(arrays.sorted_union(F.array(LIT("c"), k), F.array(LIT("a"), LIT("c")))).alias("united"),
        joined(arrays.nickname_distinct(F.array(LIT("Fox"), LIT("fox"), F.when(F.col("k") < 5, "Fox (the red)").otherwise("Hen")))).alias("nicknames"), arrays.first_sound(F.when(F.col("k") < 5, "").otherwise("cover"), LIT("other")).alias("cover"),
        joined(F.map_keys(arrays.drop_null_entries({"a": F.when(F.col("k") < 5, 1), "b": LIT(2)}))).alias("kept"),
    )


def value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of every closed value set, dealt out to the parts."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    dealt = lambda s: F.element_at(F.lit([*s.spellings, "strange", *s.members]), (F.col("p_partkey") % (len(s.spellings) + len(s.members) + 1) + 1).cast("int"))
    sets = _sets()
    return p.select("p_partkey", *[s.normalise(dealt(s)).alias(n) for n, s in sets.items()], enums.ENTITY_TYPE.contains(F.when(F.col("p_partkey") % 2 == 0, "character").otherwise("song")).alias("entity"))


def _sets() -> dict[str, enums.ValueSet]:
    return {"rating": enums.RATING, "season": enums.SEASON, "material": enums.MATERIAL, "material_relation": enums.MATERIAL_RELATION, "relation": enums.RELATION, "role": enums.ROLE, "media_type": enums.MEDIA_TYPE, "status": enums.STATUS}


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", numbers.cache_key("v1", "abc", F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.repeat(LIT("long"), 60))).alias("key"))


def relation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of five sources, every address once by the order of the sources."""
    r = _records(spark, sf_dir).select(F.col("record_id").alias("anime_id"), "k")
    i = F.col("anime_id").cast("string")
    entry = lambda kind, url: F.struct(LIT(kind).alias("type"), LIT("N").alias("name"), url.alias("url"))
    mal = r.select("anime_id", F.array(F.struct(LIT("Sequel").alias("relation"), F.array(entry("anime", F.concat(LIT("https://myanimelist.net/anime/"), i, LIT("/N"))), entry("manga", F.concat(LIT("https://myanimelist.net/manga/"), i))).alias("entry"))).alias("relations"))
    planet = r.select("anime_id", F.array(F.struct(F.concat(LIT("https://www.anime-planet.com/anime/p"), i).alias("url"), LIT("Name TV").alias("title"), LIT("same_franchise").alias("relation_type"), F.when(F.col("k") < 5, "Prequel").alias("relation_subtype"))).alias("related_anime"))
    schedule = r.select("anime_id", F.create_map(LIT("sideStories"), F.array(F.concat(LIT("route-"), i))).alias("relations"))
    anilist = r.select("anime_id", F.array(F.struct(F.struct(F.col("anime_id").alias("id"), F.struct(LIT("R").alias("romaji"), LIT("E").alias("english")).alias("title")).alias("node"), LIT("PARENT").alias("relation_type"))).alias("edges"))
    offline = r.select("anime_id", F.explode(F.array(F.concat(LIT("https://myanimelist.net/anime/"), i), F.concat(LIT("https://anidb.net/anime/"), i))).alias("url"), LIT(0).alias("pos"))
    every = relations.all_relations(relations.from_mal(mal), relations.from_planet(planet), relations.from_schedule(schedule), relations.from_anilist(anilist), offline)
    material = relations.sources_from_mal(mal).select("anime_id", "url", F.col("title"), "relation", LIT("material").alias("source"))
    return every.select("anime_id", "url", "title", "relation", "source").unionByName(material)


QUERIES = {f.__name__: f for f in (date_functions, address_functions, text_pieces, list_pieces, value_sets, cache_keys, relation_union)}


def _dealt(values: enums.ValueSet) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in [*values.spellings, "strange", *values.members])
    return f"list_extract([{quoted}], (p_partkey % {len(values.spellings) + len(values.members) + 1} + 1)::INT)"


_K = "r AS (SELECT record_id, title, type, (record_id % 10)::INT AS k FROM anime_records)"
SQL = {
    "date_functions": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderkey % 4)::INT AS k FROM orders) SELECT o_orderkey, CASE WHEN k = 3 THEN strftime(d, '%Y-01-01') ELSE strftime(d, '%Y-%m-%d') END AS iso, strftime(d::TIMESTAMP + INTERVAL 30 MINUTE - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc,
        strftime(d::TIMESTAMP - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS parsed, dayname(d) || CASE WHEN k < 2 THEN 's' ELSE '' END AS slot_day, '23:15' AS slot_time, CASE WHEN k <> 3 THEN 'JST' END AS slot_zone, strftime(d, '%b %-d, %Y') AS start, CASE WHEN k > 0 THEN strftime(d, '%Y') END AS end,
        CASE k WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'fall' END AS season, CASE WHEN k < 3 THEN year(d)::INT END AS year, ((k + 20) * 60)::INT AS runtime, CASE WHEN k = 0 THEN strftime(d, '%Y') WHEN k = 1 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS fuzzy FROM o""",
    "address_functions": f"""WITH {_K} SELECT record_id, CASE WHEN k < 3 THEN 'https://b.example/a/' || record_id WHEN k < 6 THEN 'http://h/' || record_id END AS whole, 's-' || record_id AS slug, 'https://www.anime-planet.com/anime/s-' || record_id AS planet, 'https://myanimelist.net/anime/' || record_id AS mal, k < 5 AS named,
        record_id::VARCHAR AS anidb_id, k::VARCHAR AS anilist_id, 'https://kitsu.app/anime/x' AS kitsu_url, NULL::VARCHAR AS livechart_id, record_id::VARCHAR AS title, 'A Tale Of ' || k AS route, 'Tale' AS clean, 'https://h/%E3%81%82/a%20b?x=' || k AS percent FROM r""",
    "text_pieces": f"""WITH {_K}, n AS (SELECT *, length(trim(coalesce(title, ''))) AS n FROM r) SELECT record_id, CASE WHEN k < 3 OR k >= 5 OR type IS NULL OR trim(type) IN ('', '?') THEN 'filled' ELSE type END AS filled, 'Tale_' || k || 'th_part' AS artifact, trim(coalesce(type, 'x')) AS kind, 'a' || k || ' b' AS plain,
        k < 5 AS katakana, k >= 5 AS hiragana, 'Café ' || k || ' & x' AS repaired, 'A tale begins.' AS prose, 'anime' AS romaji, round(2.0 * n / (2 * n + 1), 9)::DOUBLE AS edit, 1.0::DOUBLE AS token_set, 1.0::DOUBLE AS token_sort, round(6.0 / 7, 9)::DOUBLE AS phonetic, 'ss' || k AS folded FROM n""",
    "list_pieces": f"""WITH {_K} SELECT record_id, '1/3' || k || '|49' || k || '/49' || k || '|1139/open' AS ranges, 'Song ' || k AS song, CASE WHEN k < 5 THEN 'Band' END AS artist, CASE WHEN k < 5 THEN '1-12' END AS episodes, k < 5 AS same,
        concat_ws('|', CASE WHEN k >= 5 THEN 'list' END, CASE WHEN k <> 1 THEN 'k' END) AS changed, array_to_string([k::VARCHAR, 'a', 'c'], '|') AS united, CASE WHEN k < 5 THEN 'Fox (the red)' ELSE 'Fox|Hen' END AS nicknames, CASE WHEN k < 5 THEN 'other' ELSE 'cover' END AS cover, CASE WHEN k < 5 THEN 'a|b' ELSE 'b' END AS kept FROM r""",
    "value_sets": f"SELECT p_partkey, {', '.join(f'{_norm(_dealt(s), s)} AS {n}' for n, s in _sets().items())}, p_partkey % 2 = 0 AS entity FROM part",
    "cache_keys": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'v1:abc:' || sha256('v1:abc:' || c_custkey || ':' || repeat('long', 60)) ELSE 'v1:abc:' || c_custkey || ':None' END AS key FROM customer",
    "relation_union": f"""WITH {_K} SELECT record_id AS anime_id, 'https://myanimelist.net/anime/' || record_id || '/N' AS url, 'N' AS title, 'Sequel' AS relation, 'mal' AS source FROM r
        UNION ALL SELECT record_id, 'https://www.anime-planet.com/anime/p' || record_id, 'Name', CASE WHEN k < 5 THEN 'Prequel' ELSE 'Other' END, 'animeplanet' FROM r
        UNION ALL SELECT record_id, 'https://animeschedule.net/anime/route-' || record_id, 'Route ' || record_id, 'Side Story', 'animeschedule' FROM r
        UNION ALL SELECT record_id, 'https://anilist.co/anime/' || record_id, 'R', 'Parent Story', 'anilist' FROM r
        UNION ALL SELECT record_id, 'https://anidb.net/anime/' || record_id, 'Related Anime (AniDB)', 'Other', 'offline' FROM r
        UNION ALL SELECT record_id, 'https://myanimelist.net/manga/' || record_id, 'N', 'Sequel', 'material' FROM r""",
}
