from pyspark.sql import functions as F

from catalith.functions import text
from catalith.operators import assembly, characters, relations


def test_ensemble_and_matching(spark):
    assert characters.ensemble("Morisaki Saeto", ["Saeto Morisaki"], "anilist") > 0.6 > characters.ensemble("Morisaki Saeto", ["Wakato Kazehara"], "anilist")
    primary = spark.createDataFrame([("t", 1, ["Morisaki, Saeto"]), ("t", 2, ["Kazehara, Wakato"]), ("u", 3, ["Morisaki, Saeto"])], "title_key string, pid bigint, names array<string>")
    pool = spark.createDataFrame([("t", 10, ["Saeto Morisaki", "Crimson Fox"]), ("t", 11, ["Someone Else"]), ("t", 12, [])], "title_key string, cid bigint, names array<string>")
    got = {r["pid"]: r["cid"] for r in characters.match_source(primary, pool, "anilist", F.lit(1.0)).collect()}
    assert got == {1: 10}


def test_pools_shrink(spark):
    rows = [("t", "primary", 1, 0, ["Morisaki Saeto"]), ("t", "primary", 2, 1, ["Morisaki Saeto"])] + [("t", s, 10 + i, i, ["Morisaki Saeto"]) for i, s in enumerate(characters.SOURCES)]
    members = spark.createDataFrame(rows, "title_key string, role string, id bigint, pos int, names array<string>")
    weights = characters.WEIGHTS
    got = {r["pid"]: r["found_in"] for r in characters.progressive(members).collect()}
    assert weights["anidb"]["semantic"] == 0.65 and set(got[1]) <= set(characters.SOURCES) and (got[2] == [] if len(got[1]) == 3 else got[2] == got[1])


def test_integration(spark):
    mal = spark.createDataFrame([(1, "Saeto", None, ["N", "n (x)"], "about", 5, "i1"), (2, "Other", None, None, None, None, None)], "pid bigint, name string, name_native string, nicknames array<string>, about string, favorites bigint, image string")
    matches = spark.createDataFrame([(1, 10, 20)], "pid bigint, anilist_id bigint, animeplanet_id bigint")
    anilist = spark.createDataFrame([(10, "saeto", "冴人", ["Sae"], "17", "Male", "d", 7, "i2")], "id bigint, name string, name_native string, alternative array<string>, age string, gender string, description string, favourites bigint, image string")
    planet = spark.createDataFrame([(20, "SAETO", "18", "M", "i1")], "id bigint, name string, age string, gender string, image string")
    got = {r["pid"]: r for r in characters.integrate(mal, matches, anilist, planet).collect()}
    assert got[1]["name_variations"] == ["Saeto", "冴人", "Sae"] and got[1]["favorites"] == 12 and got[1]["images"] == ["i1", "i2"] and got[1]["source_count"] == 3 and got[1]["nicknames"] == ["n (x)"]
    assert got[2]["source_count"] == 1 and got[2]["favorites"] == 0


def test_relations(spark):
    mal = relations.from_mal(spark.createDataFrame([(1, [("Sequel", [("anime", "B", "https://myanimelist.net/anime/2/B"), ("manga", "M", "m")])])], "anime_id int, relations array<struct<relation:string,entry:array<struct<type:string,name:string,url:string>>>>"))
    planet = relations.from_planet(spark.createDataFrame([(1, [("Movie X Movie", "https://www.anime-planet.com/anime/x/", "same_franchise", "Movie")])], "anime_id int, related_anime array<struct<title:string,url:string,relation_type:string,relation_subtype:string>>"))
    schedule = relations.from_schedule(spark.createDataFrame([(1, {"sequels": ["b-two"]})], "anime_id int, relations map<string,array<string>>"))
    anilist = relations.from_anilist(spark.createDataFrame([], "anime_id int, edges array<struct<node:struct<id:bigint,title:struct<romaji:string,english:string>>,relation_type:string>>"))
    offline = spark.createDataFrame([(1, "https://myanimelist.net/anime/2", 0), (1, "https://anime-planet.com/anime/x", 1), (1, "https://anidb.net/anime/9", 2)], "anime_id int, url string, pos int")
    got = {(r["source"], r["title"], r["relation"]) for r in relations.all_relations(mal, planet, schedule, anilist, offline).collect()}
    assert got == {("mal", "B", "Sequel"), ("animeplanet", "Movie X", "Movie"), ("animeschedule", "B Two", "Sequel"), ("offline", "Related Anime (AniDB)", "Other")}


def test_platform_ids_and_preambles(spark):
    one = spark.range(1)
    urls = F.array(*[F.lit(u) for u in ("https://myanimelist.net/anime/5/x", "https://anidb.net/anime/7", "https://anidb.net/anime/8")])
    assert one.select(text.platform_ids(urls)).first()[0] == {"mal_url": "https://myanimelist.net/anime/5/x", "anidb_id": "7"}
    assert one.select(text.strip_preamble(F.lit("Name: Luffy Age: 17  Height: 172 cm  Luffy is brave."))).first()[0] == "Luffy is brave."
    for written, prose in (
        ("Age: 17  (as of the start) Zoro is calm.  He sleeps.", "Zoro is calm. He sleeps."), ("Height: 172 cm  17; 19  Nami draws maps.", "Nami draws maps."),
        ("No fields at all.", "No fields at all."), ("", None), (None, None), ("3 men: a tale", "3 men: a tale"), ("Âge: 17  Un héros.", "Un héros."),
    ):
        assert one.select(text.strip_preamble(F.lit(written).cast("string"))).first()[0] == prose, written
    assert one.select(text.strip_preamble(F.lit("Name: Luffy Age: 17"))).first()[0] is None and one.select(text.planet_url(F.lit("/anime/x"))).first()[0] == "https://www.anime-planet.com/anime/x"
    assert tuple(one.select(text.mal_anime_url(F.lit("https://myanimelist.net/anime/5/x"))).first()[0]) == ("https://myanimelist.net/anime/5", True)


def test_stages(spark):
    base = spark.createDataFrame([(1, "T", None, ["a"], None), (2, None, "X", None, None)], "id int, title string, type string, genres array<string>, status string")
    stage = spark.createDataFrame([(1, "", "TV", [], "FINISHED"), (2, "U", None, ["b"], None)], "id int, title string, type string, genres array<string>, status string")
    merged = assembly.overwrite_filled(base, stage, "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "T", "TV", ["a"], "FINISHED"), (2, "U", "X", ["b"], None)]
    done = {r["title"]: r for r in assembly.finish(merged.withColumn("episode_count", F.lit("x")), ["title", "type", "status", "episode_count"]).collect()}
    assert done["U"]["status"] == "UNKNOWN" and done["U"]["notes"] == ["status assumed"] and done["T"]["episode_count"] == 0
    eps, more = (spark.createDataFrame(r, "id int, episode_number int, title string, aired string") for r in ([(1, 1, "", None), (1, 2, "B", "d")], [(1, 1, "A", "x"), (1, 3, "C", None)]))
    assert sorted(map(tuple, assembly.merge_episodes(eps, more, ["id", "episode_number"]).collect())) == [(1, 1, "A", "x"), (1, 2, "B", "d"), (1, 3, "C", None)]
    offline, external = (spark.createDataFrame(r, "id int, name string, description string, pos int") for r in ([(1, "War", None, 0), (1, "Drama", None, 1)], [(1, "war", "about war", 0), (1, "School", None, 1)]))
    genres = spark.createDataFrame([(1, "drama")], "id int, genre string")
    assert sorted((r["name"], r["description"]) for r in assembly.merge_themes(offline, external, genres).collect()) == [("School", None), ("War", "about war")]
