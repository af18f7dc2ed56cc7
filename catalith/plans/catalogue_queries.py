"""Duplicates, joins, diffs, reports, functions, quality and state over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import arrays, dates, enums, numbers, text
from catalith.operators import dedup, joins, quality, reports, tables
from catalith.runtime import table
from catalith.streaming import state


def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return dedup.keep_last(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


def duplicates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates_removed(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def _offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records")
    return r.select("record_id", "title", "type", F.col("anime_season.year").alias("year"), F.col("anime_season.season").alias("season"), "status", "synopsis", "genres", "sources", F.coalesce(F.size("episodes"), F.lit(0)).alias("episodes"))


def tiered_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tiered_duplicates(_offline(spark, sf_dir))


def tier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tier_report(dedup.tiered_duplicates(_offline(spark, sf_dir)))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = dedup.merge_groups(_offline(spark, sf_dir), ["title", "type"], "record_id", ["status"], ["episodes"], ["genres", "sources"])
    return merged.select("title", "type", "record_id", "status", "episodes", F.array_join("genres", "|").alias("genres"), F.array_join("sources", "|").alias("sources"))


def url_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", F.explode("sources").alias("url"))
    links = r.select(text.url_key(F.col("url")).alias("key"), F.regexp_extract("url", r"https?://(\w+)\.", 1).alias("source"), F.col("record_id").alias("pos"))
    return dedup.pick_by_source(links, "key", "source", "pos")


def array_distinct_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "character_profiles")
    return p.select("profile_id", F.array_join(arrays.distinct_ignoring_case(F.col("name_variations"), F.col("alternative")), "|").alias("names"))


def left_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return joins.enrich_left(customers, "nationkey", nations, suppliers).groupBy("n_name").agg(F.count("*").alias("customers"), F.max("suppliers").alias("suppliers"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    old = c.filter(F.col("c_custkey") % 10 != 0)
    new = c.filter(F.col("c_custkey") % 7 != 0).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))).withColumn("c_nationkey", F.when(F.col("c_custkey") % 15 == 0, -1).otherwise(F.col("c_nationkey")))
    return joins.snapshot_diff(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"]).select("c_custkey", "change", F.array_join("fields", ",").alias("fields"))


def diff_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = snapshot_diff(spark, sf_dir).select(F.filter(F.split("fields", ","), lambda f: f != "").alias("fields"))
    return reports.field_changes(diff)


def anti_join_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", "feed_id", F.explode("sources").alias("url"))
    return joins.not_yet_known(r.filter("feed_id >= 6"), r.filter("feed_id < 6")).select("record_id", "url")


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    # a match of 0.7 differs by 150 at most, so it stands in the same or the next stretch of prices
    stretch = F.floor(F.col("p_retailprice") / 151)
    a = p.filter(F.col("p_size") <= 25).withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1))).alias("a")
    b = p.filter(F.col("p_size") > 25).withColumn("stretch", stretch).alias("b")
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.col("a.p_retailprice") - F.col("b.p_retailprice")) / 500)
    scored = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.stretch") == F.col("b.stretch"))).select(F.col("a.p_partkey").alias("part"), F.col("b.p_partkey").alias("other"), F.round(near, 6).alias("score"))
    return joins.best_match(scored, "part", "other", "other")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")).groupBy("user_id", "click_ts").agg(F.max("click_id").alias("click_id"))
    return joins.as_of(left, right, "user_id", "ts", "click_ts", ["click_id"]).select("event_id", "user_id", "click_id")


def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.year_histogram(_offline(spark, sf_dir))


def era_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offline(spark, sf_dir).groupBy(reports.era(F.col("year")).alias("era")).agg(F.count("*").alias("n"))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(table(spark, sf_dir, "orders"), "o_totalprice", [1000.0, 10000.0, 50000.0, 100000.0, 200000.0]).select(F.col("bucket").cast("string").alias("bucket"), "n")


def success_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(reports.success_rate(F.col("value") > 50).alias("percent"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    sides = [c.subtract(s).withColumn("side", F.lit("removed")), s.subtract(c).withColumn("side", F.lit("added")), c.intersect(s).withColumn("side", F.lit("common"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def enum_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records")
    return r.groupBy(enums.STATUS.normalise(F.col("status")).alias("status"), enums.MEDIA_TYPE.normalise(F.col("type")).alias("type")).agg(F.count("*").alias("n"))


def enum_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "character_profiles").groupBy(enums.ROLE.normalise(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


def seasons_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(dates.season_of(day).alias("season"), dates.year_of(day).alias("year")).agg(F.count("*").alias("n"))


def japan_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.parse_date(day), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def airing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start, end = F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format(F.date_add("o_orderdate", 90), "yyyy-MM-dd"))
    return o.groupBy(dates.airing_status(start, end, F.lit("1997-06-01 00:00:00").cast("timestamp")).alias("status")).agg(F.count("*").alias("n"))


def score_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.scaled_score(F.col("p_size"), 0.2), 4).alias("scaled"), numbers.percent_score(F.col("p_size") * 2).alias("percent"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", numbers.content_hash(F.encode("text", "UTF-8")).alias("hash"))


def deterministic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.deterministic_id(F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string"))).alias("uuid"))


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", F.try_element_at("sources", F.lit(1)).alias("url"))
    return r.filter("url is not null").select("record_id", text.url_key(F.col("url")).alias("key"), text.provider(F.col("url")).alias("provider"), text.artifact_name(F.col("url")).alias("artifact"))


def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "character_profiles")
    return p.select("profile_id", text.comparable(F.col("name")).alias("plain"), text.name_tokens(F.col("name")).alias("tokens"), text.script_of(F.col("name")).alias("script"), text.embedding_form(F.col("name")).alias("form"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records")
    return r.select("record_id", text.stable_id(F.col("sources"), F.col("title"), F.col("type")).alias("stable_id"))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", "title", "type", "synopsis", "genres", "status")
    rules = [*quality.required("title", "type", "synopsis"), *quality.empties(r.select("genres").schema), quality.one_of("status", *enums.STATUS.members)]
    return reports.issue_report(quality.exploded(quality.validate(r, rules), "record_id"))


def validation_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", "title", "type", "synopsis")
    return reports.compliance(quality.validate(r, quality.required("title", "type", "synopsis")))


def auto_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", "type", "status", "genres")
    fixed = quality.auto_fix(r, {"status": (enums.STATUS.members, "UNKNOWN")})
    return fixed.select("record_id", "type", "status", F.coalesce(F.size("genres"), F.lit(-1)).alias("genres"), F.array_join("fixes", ",").alias("fixes"))


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.filter(F.col("c_custkey") % 4 == 0).withColumn("c_mktsegment", F.lit("NEW")).unionByName(c.filter(F.col("c_custkey") <= 50).select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_mktsegment"))
    return tables.upsert(c, new, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def rolling_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return state.within_rate(e, "user_id", "ts", 2, 86_400).groupBy("allowed").agg(F.count("*").alias("n"), F.sum("in_window").alias("seen"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = state.windowed_counts(table(spark, sf_dir, "events"), "ts", "value", "1 day", keys=("event_type",))
    return e.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def lowest_free_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.lowest_free_id(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cache = o.select(F.col("o_custkey").alias("key"), "o_orderkey", (F.col("o_orderdate") + F.expr("interval 7 days")).alias("expires")).groupBy("key").agg(F.max_by("o_orderkey", F.struct("expires", "o_orderkey")).alias("value"), F.max("expires").alias("expires"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return state.cache_get(keys, cache, F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("hit").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


QUERIES = {f.__name__: f for f in (
    keyed_last_wins, duplicates_removed, tiered_duplicates, tier_report, merged_records, url_priority, array_distinct_case, left_enrichment, snapshot_diff, diff_frequency, anti_join_urls, best_match,
    as_of_join, year_histogram, era_counts, value_histogram, success_by_type, set_operations, enum_status, enum_role, seasons_of_dates, japan_midnight, airing_status, score_scaling, content_hashes,
    deterministic_ids, url_functions, name_functions, stable_ids, validation_report, validation_compliance, auto_fix, upsert_rows, rolling_limit, tumbling_windows, lowest_free_id, cache_lookup,
)}


def _case(column: str, spellings: dict[str, str], members: tuple[str, ...], default: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in spellings.items())
    return f"CASE WHEN {column} IN ({', '.join(map(quoted, members))}) THEN {column} ELSE coalesce(CASE lower({column}) {whens} END, {quoted(default)}) END"


_OFF = "o AS (SELECT record_id, title, type, anime_season.year AS year, anime_season.season AS season, status, genres, sources, coalesce(len(episodes), 0) AS episodes FROM anime_records)"
_TIER = f"""{_OFF}, t AS (SELECT *, CASE WHEN year IS NOT NULL AND NOT coalesce(season IN ('SPRING','SUMMER','FALL','WINTER'), false) THEN 2 WHEN year IS NULL AND coalesce(season IN ('SPRING','SUMMER','FALL','WINTER'), false) THEN 3 ELSE 1 END AS tier FROM o),
 d AS (SELECT tier, title, type, CASE WHEN tier <> 3 THEN year END AS year, CASE WHEN tier <> 2 THEN season END AS season, count(*) AS n FROM t GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1)"""
_DIFF = """c AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer), a AS (SELECT * FROM c WHERE c_custkey % 10 <> 0),
 b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 15 = 0 THEN -1 ELSE c_nationkey END AS c_nationkey FROM c WHERE c_custkey % 7 <> 0),
 j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey AS ka, b.c_custkey AS kb, concat_ws(',', CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END) AS f FROM a FULL JOIN b ON a.c_custkey = b.c_custkey),
 diff AS (SELECT c_custkey, CASE WHEN kb IS NULL THEN 'removed' WHEN ka IS NULL THEN 'added' WHEN f <> '' THEN 'changed' ELSE 'identical' END AS change, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN f ELSE '' END AS fields FROM j)"""
_KEY = "regexp_replace(replace(lower({0}), 'www.', ''), '/+$', '')"
_RULES = """SELECT 'missing' AS kind, 'error' AS severity, (SELECT count(*) FROM anime_records WHERE title IS NULL) + (SELECT count(*) FROM anime_records WHERE type IS NULL) + (SELECT count(*) FROM anime_records WHERE synopsis IS NULL) AS n
 UNION ALL SELECT 'empty_collection', 'warning', (SELECT count(*) FROM anime_records WHERE len(genres) = 0) UNION ALL SELECT 'schema', 'error', (SELECT count(*) FROM anime_records WHERE status NOT IN ('CANCELLED','FINISHED','ONGOING','UNKNOWN','UPCOMING'))"""
SQL = {
    "keyed_last_wins": "SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "duplicates_removed": "SELECT count(*) - count(DISTINCT (user_id, event_type)) AS duplicates_removed FROM events",
    "tiered_duplicates": f"WITH {_TIER} SELECT tier, title, type, year, season, n FROM d",
    "tier_report": f"WITH {_TIER} SELECT tier, count(*) AS groups, sum(n - 1) AS redundant FROM d GROUP BY tier",
    "merged_records": f"""WITH {_OFF} SELECT title, type, min(record_id) AS record_id, coalesce(arg_min(status, record_id) FILTER (WHERE status NOT IN ('', 'UNKNOWN')), arg_min_null(status, record_id)) AS status, max(episodes) AS episodes,
 array_to_string(list_sort(list_distinct(flatten(list(coalesce(genres, []))))), '|') AS genres, array_to_string(list_sort(list_distinct(flatten(list(coalesce(sources, []))))), '|') AS sources FROM o GROUP BY title, type""",
    "url_priority": f"""WITH l AS (SELECT {_KEY.format('url')} AS key, regexp_extract(url, 'https?://(\\w+)\\.', 1) AS source, record_id AS pos FROM (SELECT record_id, unnest(sources) AS url FROM anime_records)),
 r AS (SELECT *, min(pos) OVER (PARTITION BY key) AS first_seen, row_number() OVER (PARTITION BY key ORDER BY CASE source WHEN 'mal' THEN 0 WHEN 'animeplanet' THEN 1 WHEN 'animeschedule' THEN 2 ELSE 3 END, CASE WHEN source = 'animeplanet' THEN -pos ELSE pos END) AS place FROM l) SELECT key, source, pos, first_seen FROM r WHERE place = 1""",
    "array_distinct_case": """WITH v AS (SELECT profile_id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM (SELECT profile_id, list_concat(coalesce(name_variations, []), coalesce(alternative, [])) AS x FROM character_profiles)),
 k AS (SELECT profile_id, i, trim(v) AS v FROM v WHERE v IS NOT NULL AND length(trim(v)) > 0 QUALIFY row_number() OVER (PARTITION BY profile_id, lower(trim(v)) ORDER BY i) = 1)
 SELECT p.profile_id, coalesce(string_agg(k.v, '|' ORDER BY k.i), '') AS names FROM character_profiles p LEFT JOIN k USING (profile_id) GROUP BY p.profile_id""",
    "left_enrichment": "SELECT n_name, count(*) AS customers, max(suppliers) AS suppliers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey GROUP BY n_name",
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "diff_frequency": f"WITH {_DIFF} SELECT field, count(*) AS n FROM (SELECT unnest(string_split(fields, ',')) AS field FROM diff WHERE fields <> '') GROUP BY field ORDER BY n DESC, field LIMIT 10",
    "anti_join_urls": f"WITH u AS (SELECT record_id, feed_id, unnest(sources) AS url FROM anime_records) SELECT record_id, url FROM u WHERE feed_id >= 6 AND {_KEY.format('url')} NOT IN (SELECT {_KEY.format('url')} FROM u WHERE feed_id < 6)",
    "deterministic_ids": """WITH d AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('_', p_brand, p_partkey))) AS h FROM part)
 SELECT p_partkey, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', (('0x' || h[17])::INT % 4) + 1, 1), h[18:20], '-', h[21:32]) AS uuid FROM d""",
    "best_match": """WITH s AS (SELECT a.p_partkey AS part, b.p_partkey AS other, round(greatest(0.0, 1 - abs(a.p_retailprice - b.p_retailprice) / 500), 6) AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type WHERE a.p_size <= 25 AND b.p_size > 25)
 SELECT part, other, score FROM s WHERE true QUALIFY row_number() OVER (PARTITION BY part ORDER BY score >= 0.9 DESC, CASE WHEN score >= 0.9 THEN 0 ELSE score END DESC, other) = 1 AND score >= 0.7""",
    "as_of_join": """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL) SELECT p.event_id, p.user_id, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""",
    "year_histogram": f"WITH {_OFF} SELECT coalesce(year::varchar, 'Unknown') AS year, count(*) AS n FROM o GROUP BY 1",
    "era_counts": f"WITH {_OFF} SELECT CASE WHEN year IS NULL THEN 'Unknown' WHEN year < 1980 THEN 'before 1980' WHEN year < 2000 THEN '1980-1999' WHEN year < 2010 THEN '2000-2009' WHEN year < 2020 THEN '2010-2019' ELSE '2020 on' END AS era, count(*) AS n FROM o GROUP BY 1",
    "value_histogram": "SELECT CASE WHEN o_totalprice <= 1000 THEN '1000.0' WHEN o_totalprice <= 10000 THEN '10000.0' WHEN o_totalprice <= 50000 THEN '50000.0' WHEN o_totalprice <= 100000 THEN '100000.0' WHEN o_totalprice <= 200000 THEN '200000.0' ELSE 'Infinity' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "success_by_type": "SELECT event_type, round(100.0 * avg((value > 50)::int), 2) AS percent FROM events GROUP BY event_type",
    "set_operations": "WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, 'removed' AS side FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT k, 'added' FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT k, 'common' FROM (SELECT k FROM c INTERSECT SELECT k FROM s)",
    "enum_status": f"SELECT {_case('status', enums.STATUS.spellings, enums.STATUS.members, 'UNKNOWN')} AS status, {_case('type', enums.MEDIA_TYPE.spellings, enums.MEDIA_TYPE.members, 'UNKNOWN')} AS type, count(*) AS n FROM anime_records GROUP BY 1, 2",
    "enum_role": f"SELECT {_case('role', enums.ROLE.spellings, enums.ROLE.members, 'UNKNOWN')} AS role, count(*) AS n FROM character_profiles GROUP BY 1",
    "seasons_of_dates": "SELECT ['WINTER','SPRING','SUMMER','FALL'][(month(o_orderdate) % 12) // 3 + 1] AS season, year(o_orderdate)::int AS year, count(*) AS n FROM orders GROUP BY 1, 2",
    "japan_midnight": "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM orders",
    "airing_status": """WITH d AS (SELECT date_trunc('day', o_orderdate) - INTERVAL 9 HOUR AS s, CASE WHEN o_orderkey % 3 > 0 THEN date_trunc('day', o_orderdate) + INTERVAL 90 DAY - INTERVAL 9 HOUR END AS e FROM orders)
 SELECT CASE WHEN s > TIMESTAMP '1997-06-01' THEN 'UPCOMING' WHEN e <= TIMESTAMP '1997-06-01' THEN 'FINISHED' ELSE 'ONGOING' END AS status, count(*) AS n FROM d GROUP BY 1""",
    "score_scaling": "SELECT p_partkey, round(least(10.0, nullif(p_size, 0) * 0.2::double), 4) AS scaled, round(least(10.0, p_size * 2 / 10.0::double), 2) AS percent FROM part",
    "content_hashes": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL",
    "url_functions": f"""SELECT record_id, {_KEY.format('url')} AS key, regexp_extract(url, '://([^/?#]*)', 1) AS provider, regexp_replace(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS artifact FROM (SELECT record_id, sources[1] AS url FROM anime_records) WHERE url IS NOT NULL""",
    "name_functions": r"""SELECT profile_id, lower(trim(coalesce(name, ''))) AS plain, array_to_string(list_filter(regexp_split_to_array(name, '[\s\-_.,()]+'), lambda x: length(x) > 0), ' ') AS tokens,
 CASE WHEN regexp_matches(name, '[\x{3040}-\x{30ff}\x{4e00}-\x{9faf}]') THEN 'japanese' WHEN regexp_matches(name, '^[\x00-\x7f]*$') THEN 'english' ELSE 'mixed' END AS script, lower(trim(regexp_replace(regexp_replace(name, '[.,;:!?"'']', '', 'g'), '\s+', ' ', 'g'))) AS form FROM character_profiles""",
    "stable_ids": "SELECT record_id, 'fallback:' || lower(coalesce(title, 'unknown')) || '|' || lower(coalesce(type, 'unknown')) AS stable_id FROM anime_records",
    "validation_report": f"SELECT * FROM ({_RULES}) WHERE n > 0",
    "validation_compliance": "SELECT count(*) AS total, sum((title IS NOT NULL AND type IS NOT NULL AND synopsis IS NOT NULL)::int) AS valid, round(100.0 * sum((title IS NOT NULL AND type IS NOT NULL AND synopsis IS NOT NULL)::int) / count(*), 2) AS percent FROM anime_records",
    "auto_fix": """WITH f AS (SELECT record_id, type, genres, status, nullif(trim(type), '') AS t2, CASE WHEN trim(status) IN ('CANCELLED','FINISHED','ONGOING','UNKNOWN','UPCOMING') THEN trim(status) ELSE 'UNKNOWN' END AS s2 FROM anime_records)
 SELECT record_id, t2 AS type, s2 AS status, CASE WHEN len(genres) > 0 THEN len(genres) ELSE -1 END AS genres, concat_ws(',', CASE WHEN t2 IS DISTINCT FROM type THEN 'type' END, CASE WHEN s2 IS DISTINCT FROM status THEN 'status' END, CASE WHEN len(genres) = 0 THEN 'genres' END) AS fixes FROM f""",
    "upsert_rows": "WITH n AS (SELECT c_custkey, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer WHERE c_custkey <= 50), a AS (SELECT * FROM n UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) SELECT c_mktsegment, count(*) AS n, sum(c_custkey) AS keys FROM a GROUP BY 1",
    "rolling_limit": "WITH w AS (SELECT count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events) SELECT in_window <= 2 AS allowed, count(*) AS n, sum(in_window) AS seen FROM w GROUP BY 1",
    "tumbling_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "lowest_free_id": "WITH i AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey > 0) SELECT min(f) AS free_id FROM (SELECT id + 1 AS f FROM i UNION ALL SELECT 1) WHERE f NOT IN (SELECT id FROM i)",
    "cache_lookup": """WITH c AS (SELECT o_custkey AS key, arg_max(o_orderkey, {'e': o_orderdate, 'k': o_orderkey}) AS value, max(o_orderdate + INTERVAL 7 DAY) AS expires FROM orders GROUP BY 1)
 SELECT value IS NOT NULL AS hit, count(*) AS n, sum(value) AS total FROM customer LEFT JOIN (SELECT * FROM c WHERE expires > TIMESTAMP '1998-01-01') c ON c_custkey = key GROUP BY 1""",
}
