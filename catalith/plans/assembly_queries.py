"""Assembly of records, their points and texts, quality of cast lists and the cache over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import assembly, quality, tables
from catalith.plans.mapper_queries import joined
from catalith.runtime import table
from catalith.sources import files
from catalith.streaming import state

LIT = F.lit


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "anime_records").withColumn("k", (F.col("record_id") % 10).cast("int"))


def record_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a character of its own and its episodes, as points with their texts and pictures."""
    r = _records(spark, sf_dir)
    episode = lambda e: F.from_json(F.to_json(F.struct(F.concat_ws("-", LIT("e"), F.col("record_id").cast("string"), e["episode_number"].cast("string")).alias("id"), e["episode_number"].alias("episode_number"), e["title"].alias("title"), (F.col("k") < 5).alias("filler"))), assembly.EPISODE)
    hero = F.from_json(F.to_json(F.struct(F.concat(LIT("c"), F.col("record_id")).alias("id"), LIT("Hero").alias("name"), F.array(LIT("MAIN")).alias("roles"), F.create_map(LIT("Age"), F.col("k").cast("string")).alias("attributes"), F.array(LIT("h.png"), LIT("h.png")).alias("images"))), assembly.CHARACTER)
    nested = lambda c: F.when(F.size(c) > 0, c)
    whole = r.select(
        F.col("record_id").cast("string").alias("id"), "title", "type", "status", "synopsis", "genres", F.when(F.col("k") < 3, F.array(LIT("Shounen"))).alias("demographics"), F.array(hero).alias("characters"), F.transform(nested(F.filter("episodes", lambda e: e["episode_number"].isNotNull())), episode).alias("episodes"),
        F.struct(F.array(LIT("a.png"), LIT("b.png")).alias("covers"), F.array(LIT("b.png")).alias("posters"), F.when(F.col("k") > 5, F.array(LIT("c.png"))).alias("banners")).alias("images"),
    )
    full = spark.createDataFrame([], assembly.SCHEMA).unionByName(whole, allowMissingColumns=True)
    return assembly.points(full).select("id", "entity_type", "anime_id", "text", joined("images").alias("images"))


def stages_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base record overwritten by what a stage states, with defaults and notes on what had to be assumed."""
    r = _records(spark, sf_dir)
    base = r.select(F.col("record_id").alias("id"), "title", F.when(F.col("k") != 4, F.col("type")).alias("type"), "status", F.col("k").cast("string").alias("episode_count"), "genres")
    stage = r.filter("k > 2").select(F.col("record_id").alias("id"), F.when(F.col("k") == 3, "").when(F.col("k") == 5, "Stage title").alias("title"), F.when(F.col("k") == 6, F.array(LIT("Staged"))).otherwise(F.array().cast("array<string>")).alias("genres"), LIT("late").alias("season"))
    done = assembly.finish(assembly.overwrite_filled(base, stage, "id"), ["id", "title", "type", "status", "episode_count", "genres", "season"])
    return done.select("id", "title", "type", "status", "episode_count", joined("genres").alias("genres"), "season", joined("notes").alias("notes"))


def merged_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of two deliveries by number: blanks filled, unmatched ones appended."""
    n = spark.range(1).select(F.explode(F.sequence(LIT(1), LIT(6))).alias("episode_number"))
    keyed = _records(spark, sf_dir).select(F.col("record_id").alias("id"), "k").crossJoin(F.broadcast(n))  # six rows
    base = keyed.filter("episode_number <= 4").select("id", "episode_number", F.when(F.col("episode_number") % 2 == 0, "").otherwise("Base").alias("title"), F.when(F.col("k") < 5, "b").alias("aired"))
    other = keyed.filter("episode_number >= 3").select("id", "episode_number", LIT("Other").alias("title"), LIT("o").alias("aired"))
    return assembly.merge_episodes(base, other, ["id", "episode_number"])


def enriched_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main delivery's episodes with titles and synopses of two others by number."""
    e = table(spark, sf_dir, "episodes_raw").select(F.col("row_id").alias("episode_number"), "title_en", "title_ja", (F.col("row_id") % 10).alias("k"))
    main = e.select("episode_number", F.when(F.col("k") < 5, "").otherwise(F.col("title_en")).alias("title"), F.when(F.col("k") == 1, "own").alias("synopsis"))
    kitsu = e.filter("k <> 2").select("episode_number", F.when(F.col("k") == 3, "").otherwise(F.col("title_ja")).alias("title"), LIT("theirs").alias("synopsis"), LIT("t.png").alias("thumbnail"))
    anisearch = e.filter("k < 8").select("episode_number", LIT("third").alias("title"))
    return assembly.stage_episodes(main, kitsu, anisearch).select("episode_number", "title", "synopsis")


def merged_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes of two sources by name, none that is a genre, the first description kept."""
    r = _records(spark, sf_dir).select(F.col("record_id").alias("id"), "k")
    row = lambda d, pos, name, about: d.select("id", LIT(pos).alias("pos"), LIT(name).alias("name"), LIT(about).cast("string").alias("description"))
    offline = row(r, 0, "Pirates", None).unionByName(row(r.filter("k < 5"), 1, "School", "at school"))
    external = row(r, 0, "PIRATES ", "of the sea").unionByName(row(r, 1, "Drama", "sad"))
    genres = r.filter("k > 2").select("id", LIT("drama").alias("genre"))
    return assembly.merge_themes(offline, external, genres)


def synopsis_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source's synopsis, cleaned of what that source adds."""
    r = _records(spark, sf_dir)
    at = lambda k, written: F.when(F.col("k") == k, written)
    best = assembly.synopsis_by_rank(at(0, "See http://x/c1 [Hero] go."), at(1, "Mal text. (Source: MAL)"), at(2, "<p>Plan</p>"), at(3, " Kitsu text.\n[Written by X]"), at(4, "Planet"), LIT("<i>Last</i>"))
    return r.select("record_id", best.alias("synopsis"))


def cast_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the rows of a cast list: required and empty fields, and the shape of its voice actors."""
    c = table(spark, sf_dir, "mal_characters")
    rules = [*quality.required("name"), *quality.empties(c.schema, skip=("mal_id", "favorites")), *quality.voice_actors()]
    return quality.exploded(quality.validate(c, rules), "mal_id").select("mal_id", "field", "kind", "severity")


def validated_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired records validated again."""
    r = table(spark, sf_dir, "anime_records").select("record_id", "title", "type", "genres")
    known = ("TV", "MOVIE", "OVA", "ONA", "SPECIAL")
    fixed = quality.validate_and_fix(r, [*quality.required("title"), quality.one_of("type", *known, "UNKNOWN")], {"type": (known, "UNKNOWN")})
    return fixed.select("record_id", "title", "type", joined("genres").alias("genres"), joined("fixes").alias("fixes"), "errors")


def cache_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after new entries, several of a key among them, read an hour later and swept."""
    c = table(spark, sf_dir, "customer")
    now = LIT("2020-01-01 12:00:00").cast("timestamp")
    old = c.select(F.col("c_custkey").alias("key"), LIT("old").alias("value"), (now + F.expr("make_dt_interval(0, 0, 0, cast(c_custkey % 7 as decimal(18,6)) * 1800)")).alias("expires"))
    entries = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.explode(F.array(LIT(1), LIT(2))).alias("pos")).select("key", F.when((F.col("key") % 6 != 0) | (F.col("pos") == 1), F.concat(LIT("new"), F.col("pos"))).alias("value"), "pos")
    cache = state.cache_put(old, entries, now, 5400, position="pos")
    later = LIT("2020-01-01 13:00:00").cast("timestamp")
    return state.cache_get(c.select(F.col("c_custkey").alias("key")), state.cache_sweep(cache, later), later)


def vector_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named vectors replaced, of one point and name the last."""
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.array(LIT(0.0)).alias("text_vector"), F.array(LIT(9.0)).alias("image_vector"))
    u = p.filter("point_id % 4 = 0").select("point_id", F.explode(F.array(*[F.struct(LIT(n).alias("vector_name"), F.array(LIT(v)).alias("vector"), LIT(i).alias("pos")) for n, v, i in (("text_vector", 1.0, 0), ("text_vector", 2.0, 1), ("other_vector", 3.0, 2))])).alias("u")).select("point_id", "u.*")
    new = tables.update_vectors(p, u)
    return new.select("point_id", F.col("text_vector")[0].alias("text"), F.col("image_vector")[0].alias("image"))


def aligned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages in the order of the requests; blocked and failed ones have no result."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(LIT("u"), F.col("event_id")).alias("url"))
    asked = e.select("url", F.col("event_id").alias("pos"))
    got = e.filter("event_id % 5 <> 0").select("url", F.when(F.col("event_id") % 7 == 0, 403).otherwise(200).alias("status_code"), (F.col("event_id") % 11 != 0).alias("success"), F.explode(F.array(LIT("b"), LIT("a"))).alias("body"))
    return files.align(asked, got).select("url", "pos", F.col("result.body").alias("body"))


QUERIES = {f.__name__: f for f in (record_points, stages_to_record, merged_episodes, enriched_episodes, merged_themes, synopsis_ranks, cast_rules, validated_fixes, cache_cycle, vector_updates, aligned_results)}

_K = "r AS (SELECT *, (record_id % 10)::INT AS k FROM anime_records)"
SQL = {
    "record_points": f"""WITH {_K}, l AS (SELECT *, list_concat(list_filter(coalesce(genres, []), lambda g: g IS NOT NULL AND length(trim(g)) > 0), CASE WHEN k < 3 THEN ['Shounen (young male audience)'] ELSE [] END) AS said FROM r), e AS (SELECT record_id, k, unnest(episodes) AS e FROM r)
        SELECT record_id::VARCHAR AS id, 'anime' AS entity_type, record_id::VARCHAR AS anime_id,
            concat_ws(' || ', CASE WHEN length(trim(title)) > 0 THEN 'Title: ' || title END, CASE WHEN length(trim(synopsis)) > 0 THEN 'Synopsis: ' || synopsis END, CASE WHEN len(said) > 0 THEN 'Genres: ' || array_to_string(said, ', ') END,
                nullif(concat_ws(' | ', CASE WHEN length(trim(type)) > 0 THEN 'Type: ' || type END, CASE WHEN length(trim(status)) > 0 THEN 'Status: ' || status END), '')) AS text,
            CASE WHEN k > 5 THEN 'a.png|b.png|c.png' ELSE 'a.png|b.png' END AS images FROM l
        UNION ALL SELECT 'c' || record_id, 'character', record_id::VARCHAR, 'Name: Hero | Roles: MAIN | Age: ' || k, 'h.png' FROM r
        UNION ALL SELECT 'e-' || record_id || '-' || e.episode_number, 'episode', record_id::VARCHAR, concat_ws(' | ', 'Episode ' || e.episode_number, nullif(e.title, '')) || CASE WHEN k < 5 THEN ' (Filler)' ELSE '' END, '' FROM e WHERE e.episode_number IS NOT NULL""",
    "stages_to_record": f"""WITH {_K} SELECT record_id AS id, CASE WHEN k = 5 THEN 'Stage title' ELSE coalesce(nullif(trim(title), ''), 'Unknown Title') END AS title, coalesce(CASE WHEN k <> 4 THEN type END, 'UNKNOWN') AS type, coalesce(status, 'UNKNOWN') AS status, k AS episode_count,
        CASE WHEN k = 6 THEN 'Staged' ELSE array_to_string(genres, '|') END AS genres, CASE WHEN k > 2 THEN 'late' END AS season, concat_ws('|', CASE WHEN k <> 5 AND coalesce(trim(title), '') = '' THEN 'title missing' END, CASE WHEN k = 4 OR type IS NULL THEN 'type assumed' END, CASE WHEN status IS NULL THEN 'status assumed' END) AS notes FROM r""",
    "merged_episodes": f"""WITH {_K}, n AS (SELECT record_id AS id, k, unnest([1, 2, 3, 4, 5, 6]) AS episode_number FROM r) SELECT id, episode_number, CASE WHEN episode_number > 4 THEN 'Other' WHEN episode_number % 2 = 1 THEN 'Base' WHEN episode_number >= 3 THEN 'Other' END AS title,
        CASE WHEN episode_number <= 4 AND k < 5 THEN 'b' WHEN episode_number >= 3 THEN 'o' END AS aired FROM n""",
    "enriched_episodes": """WITH e AS (SELECT row_id, title_en, title_ja, row_id % 10 AS k FROM episodes_raw) SELECT row_id AS episode_number, coalesce(CASE WHEN k >= 5 THEN nullif(title_en, '') END, CASE WHEN k NOT IN (2, 3) THEN nullif(title_ja, '') END, CASE WHEN k < 8 THEN 'third' END) AS title,
        CASE WHEN k = 1 THEN 'own' WHEN k <> 2 THEN 'theirs' END AS synopsis FROM e""",
    "merged_themes": f"""WITH {_K} SELECT record_id AS id, 'Pirates' AS name, 'of the sea' AS description FROM r UNION ALL SELECT record_id, 'School', 'at school' FROM r WHERE k < 5 UNION ALL SELECT record_id, 'Drama', 'sad' FROM r WHERE k <= 2""",
    "synopsis_ranks": f"""WITH {_K} SELECT record_id, CASE k WHEN 0 THEN 'See Hero go.' WHEN 1 THEN 'Mal text.' WHEN 2 THEN 'Plan' WHEN 3 THEN 'Kitsu text.' WHEN 4 THEN 'Planet' ELSE 'Last' END AS synopsis FROM r""",
    "cast_rules": """SELECT mal_id, 'name' AS field, 'missing' AS kind, 'error' AS severity FROM mal_characters WHERE name IS NULL
        UNION ALL SELECT mal_id, f, 'null_scalar', 'info' FROM (SELECT mal_id, unnest(['name', 'name_native', 'role', 'gender', 'age']) AS f, unnest([name, name_native, role, gender, age]) AS v FROM mal_characters) WHERE v IS NULL
        UNION ALL SELECT mal_id, 'voice_actors', 'empty_collection', 'warning' FROM mal_characters WHERE len(voice_actors) = 0
        UNION ALL SELECT mal_id, 'animeography', 'empty_collection', 'warning' FROM mal_characters WHERE len(animeography) = 0
        UNION ALL SELECT mal_id, 'voice_actors', 'voice_actor', 'error' FROM mal_characters WHERE len(list_filter(voice_actors, lambda v: length(trim(coalesce(v.name, ''))) = 0)) > 0
        UNION ALL SELECT mal_id, 'voice_actors', 'voice_actor', 'warning' FROM mal_characters WHERE len(list_filter(voice_actors, lambda v: v.language IS NULL)) > 0""",
    "validated_fixes": """WITH f AS (SELECT record_id, title, type, genres, nullif(trim(title), '') AS t, CASE WHEN trim(type) IN ('TV', 'MOVIE', 'OVA', 'ONA', 'SPECIAL') THEN trim(type) ELSE 'UNKNOWN' END AS y FROM anime_records)
        SELECT record_id, t AS title, y AS type, array_to_string(CASE WHEN len(genres) > 0 THEN genres END, '|') AS genres, concat_ws('|', CASE WHEN t IS DISTINCT FROM title THEN 'title' END, CASE WHEN y IS DISTINCT FROM type THEN 'type' END, CASE WHEN len(genres) = 0 THEN 'genres' END) AS fixes, (t IS NULL)::INT AS errors FROM f""",
    "cache_cycle": """SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'new1' WHEN c_custkey % 3 = 0 THEN 'new2' WHEN c_custkey % 7 * 1800 > 3600 THEN 'old' END AS value, c_custkey % 3 = 0 OR c_custkey % 7 * 1800 > 3600 AS hit FROM customer""",
    "vector_updates": "SELECT c_custkey AS point_id, CASE WHEN c_custkey % 4 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS text, 9.0::DOUBLE AS image FROM customer",
    "aligned_results": "SELECT 'u' || event_id AS url, event_id AS pos, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN 'a' END AS body FROM events",
}
