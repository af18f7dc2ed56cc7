"""Further operators over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import arrays, dates, enums, numbers, text
from catalith.operators import assembly, dedup, filters, joins, tables
from catalith.runtime import table
from catalith.sources import files
from catalith.streaming import state


def runtime_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "episodes_raw").filter("runtime is not null")
    return e.groupBy("runtime").agg(F.max(dates.duration_seconds(F.col("runtime"))).alias("seconds"), F.count("*").alias("n"))


def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.title_contains(table(spark, sf_dir, "anime_records"), "dragon").select("record_id", "title")


def lookup_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.at_position(files.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), 100, "pos").select("o_orderkey")


def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds' records beside each other as structs, the base's values first where they say something."""
    r = table(spark, sf_dir, "anime_records").filter("anime_key is not null").groupBy("anime_key", "feed_id").agg(F.min_by(F.struct("title", "type", "status"), "record_id").alias("r")).select("anime_key", "feed_id", "r.*")
    base = r.filter("feed_id = 1").select("anime_key", "title", "type", "status")
    both = files.with_sources(base, {"second": r.filter("feed_id = 3").select("anime_key", "type", "status"), "third": r.filter("feed_id = 6").select("anime_key", "status")}, "anime_key")
    return both.select("anime_key", F.coalesce("type", "second.type").alias("type"), text.first_synopsis(F.col("status"), F.col("second.status"), F.col("third.status")).alias("status"))


def stage_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").filter("anime_key is not null").groupBy("anime_key", "feed_id").agg(F.min_by(F.struct("title", "type", "genres"), "record_id").alias("r")).select("anime_key", "feed_id", "r.*")
    base, stage = (r.filter(F.col("feed_id") == i).select("anime_key", "title", "type", "genres") for i in (2, 5))
    return assembly.overwrite_filled(base, stage, "anime_key").select("anime_key", "title", "type", F.array_join("genres", "|").alias("genres"))


def merge_two_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").filter("anime_key is not null").withColumn("episodes", F.coalesce(F.size("episodes"), F.lit(0)))
    r = r.groupBy("anime_key", "feed_id").agg(F.min_by(F.struct("status", "episodes", "genres"), "record_id").alias("r")).select("anime_key", "feed_id", "r.*")
    a, b = (r.filter(F.col("feed_id") == i).drop("feed_id") for i in (1, 4))
    return dedup.merge_pair(a, b, "anime_key", ["status"], ["episodes"], ["genres"]).select("anime_key", "status", "episodes", F.array_join("genres", "|").alias("genres"))


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "character_profiles")
    return p.select("profile_id", F.array_join(arrays.ordered_distinct(F.col("name_variations"), F.col("nicknames")), "|").alias("ordered"), F.array_join(arrays.sorted_union(F.col("nicknames"), F.col("alternative")), "|").alias("sorted"))


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", numbers.parse_number(F.format_number(F.col("o_orderkey") * 1000, 0)).alias("number"), numbers.first_number(F.concat(F.lit("Rank #"), F.format_number("o_orderkey", 0), F.lit(" of all"))).alias("rank"))


def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("SEQUEL", "PARENT", "SUMMARY", "ODD", "SIDE_STORY")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.groupBy(enums.graph_relation(kind).alias("label"), enums.RELATION.normalise(kind).alias("relation")).agg(F.count("*").alias("n"))


def related_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records").select("record_id", F.explode("sources").alias("url"))
    return r.select("record_id", text.relation_from_url(F.concat("url", F.lit("-movie"))).alias("relation"), text.fallback_title(F.col("url")).alias("fallback"), text.route_title(F.regexp_extract("url", r"//([^/]+)/", 1)).alias("title")).distinct()


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations and their regions as a graph, three hops from a region.

    In the graph nations have odd and regions even negative numbers, so no customer's key is taken for one of them.  The
    result numbers them from 100,000 and 1,000,000; where a customer has that number too, the hop tells them apart.
    """
    nation = lambda key: (-2 * F.col(key).cast("bigint") - 1)
    region = lambda key: (-2 * F.col(key).cast("bigint") - 2)
    n = table(spark, sf_dir, "nation").select(region("n_regionkey").alias("src"), nation("n_nationkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(nation("c_nationkey").alias("src"), F.col("c_custkey").cast("bigint").alias("dst"))
    found = joins.k_hop(n.unionByName(c), [-4], 3)  # region 1
    number = F.when(F.col("node") >= 0, F.col("node")).when(F.col("node") % 2 == 0, 1_000_000 - F.col("node") / 2 - 1).otherwise(100_000 - (F.col("node") + 1) / 2)
    return found.select(number.cast("bigint").alias("node"), "hop")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = state.windowed_counts(table(spark, sf_dir, "events"), "ts", "value", "2 days", "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


def payload_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    points = c.select(F.col("c_custkey").alias("point_id"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("payload"))
    updates = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("point_id"), F.create_map(F.lit("segment"), F.lit("NEW"), F.lit("tier"), F.lit("gold")).alias("payload"), F.lit(1).alias("pos"))
    merged = tables.update_payload(points, updates)
    return merged.select("point_id", *[F.try_element_at("payload", F.lit(k)).alias(k) for k in ("segment", "nation", "tier")])


def backoff_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 6).alias("failures")).distinct()
    return e.select("failures", state.backoff_seconds(F.col("failures"), 2.0, 30.0).cast("double").alias("delay"), state.backoff_seconds(F.col("failures"), 2.0, 30.0, True).cast("double").alias("retry_delay"))


def title_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "anime_records")
    return r.select("record_id", F.concat_ws(" | ", F.concat(F.lit("Title: "), "title"), F.when(F.length(F.trim("type")) > 0, F.concat(F.lit("Type: "), "type"))).alias("text"), F.array_join(arrays.clean_strings(F.coalesce("genres", F.array().cast("array<string>"))), ", ").alias("genres"))


QUERIES = {f.__name__: f for f in (
    runtime_durations, title_search, lookup_by_position, source_columns, stage_overwrite, merge_two_feeds, array_functions, parsed_numbers, relation_types, related_addresses, reachable, session_counts, sliding_windows,
    payload_updates, backoff_delays, title_texts,
)}

_FIRST = "f AS (SELECT *, coalesce(len(episodes), 0) AS eps FROM anime_records WHERE anime_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anime_key, feed_id ORDER BY record_id) = 1)"
_SAYS = "CASE WHEN {0} NOT IN ('', 'UNKNOWN') THEN {0} END"
SQL = {
    "runtime_durations": r"""WITH p AS (SELECT runtime, regexp_extract(runtime, '^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$', ['h','m','s']) AS c, regexp_matches(runtime, '^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$') AS clock,
 coalesce(try_cast(regexp_extract(runtime, '(\d+)\s*(?:hr|hour|h\b)', 1) AS int), 0) * 3600 + coalesce(try_cast(regexp_extract(runtime, '(\d+)\s*(?:min|m\b)', 1) AS int), 0) * 60 + coalesce(try_cast(regexp_extract(runtime, '(\d+)\s*(?:sec|s\b)', 1) AS int), 0) AS spoken FROM episodes_raw WHERE runtime IS NOT NULL)
 SELECT runtime, max(nullif(CASE WHEN clock THEN coalesce(try_cast(c.h AS int), 0) * 3600 + coalesce(try_cast(c.m AS int), 0) * 60 + coalesce(try_cast(c.s AS int), 0) ELSE spoken END, 0)) AS seconds, count(*) AS n FROM p GROUP BY runtime""",
    "title_search": "SELECT record_id, title FROM anime_records WHERE contains(lower(title), 'dragon')",
    "lookup_by_position": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100",
    "source_columns": f"WITH {_FIRST} SELECT a.anime_key, coalesce(a.type, b.type) AS type, coalesce(nullif(trim(a.status), ''), nullif(trim(b.status), ''), nullif(trim(c.status), '')) AS status FROM f a LEFT JOIN f b ON b.anime_key = a.anime_key AND b.feed_id = 3 LEFT JOIN f c ON c.anime_key = a.anime_key AND c.feed_id = 6 WHERE a.feed_id = 1",
    "stage_overwrite": f"WITH {_FIRST} SELECT a.anime_key, CASE WHEN length(b.title) > 0 THEN b.title ELSE a.title END AS title, CASE WHEN length(b.type) > 0 THEN b.type ELSE a.type END AS type, array_to_string(CASE WHEN len(b.genres) > 0 THEN b.genres ELSE a.genres END, '|') AS genres FROM f a LEFT JOIN f b ON b.anime_key = a.anime_key AND b.feed_id = 5 WHERE a.feed_id = 2",
    "merge_two_feeds": f"WITH {_FIRST} SELECT a.anime_key, coalesce({_SAYS.format('a.status')}, {_SAYS.format('b.status')}, a.status) AS status, greatest(a.eps, coalesce(b.eps, 0)) AS episodes, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.genres, []), coalesce(b.genres, [])))), '|') AS genres FROM f a LEFT JOIN f b ON b.anime_key = a.anime_key AND b.feed_id = 4 WHERE a.feed_id = 1",
    "array_functions": """WITH u AS (SELECT profile_id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM (SELECT profile_id, list_concat(coalesce(name_variations, []), coalesce(nicknames, [])) AS x FROM character_profiles)),
 o AS (SELECT profile_id, i, v FROM u WHERE v IS NOT NULL AND length(trim(v)) > 0 QUALIFY row_number() OVER (PARTITION BY profile_id, v ORDER BY i) = 1), g AS (SELECT profile_id, string_agg(v, '|' ORDER BY i) AS ordered FROM o GROUP BY 1)
 SELECT p.profile_id, coalesce(g.ordered, '') AS ordered, array_to_string(list_sort(list_distinct(list_concat(coalesce(nicknames, []), coalesce(alternative, [])))), '|') AS sorted FROM character_profiles p LEFT JOIN g USING (profile_id)""",
    "parsed_numbers": "SELECT o_orderkey, o_orderkey * 1000 AS number, o_orderkey AS rank FROM orders",
    "relation_types": "WITH k AS (SELECT event_id % 5 AS i FROM events) SELECT ['Sequel','Parent Story','Summary','Other','Side Story'][i + 1] AS label, ['SEQUEL','PARENT_STORY','SUMMARY','OTHER','SIDE_STORY'][i + 1] AS relation, count(*) AS n FROM k GROUP BY 1, 2",
    "related_addresses": "WITH u AS (SELECT record_id, unnest(sources) AS url FROM anime_records) SELECT DISTINCT record_id, 'Movie' AS relation, 'Related Anime' AS fallback, upper(substr(regexp_extract(url, '//([^/]+)/', 1), 1, 1)) || lower(substr(regexp_extract(url, '//([^/]+)/', 1), 2)) AS title FROM u",
    "reachable": """WITH RECURSIVE e AS (SELECT -2 * n_regionkey - 2 AS src, -2 * n_nationkey - 1 AS dst FROM nation UNION ALL SELECT -2 * c_nationkey - 1, c_custkey FROM customer), w(node, hop) AS (SELECT -4, 0 UNION ALL SELECT e.dst, hop + 1 FROM w JOIN e ON e.src = w.node WHERE hop < 3)
 SELECT CASE WHEN node >= 0 THEN node WHEN node % 2 = 0 THEN 1000000 - node // 2 - 1 ELSE 100000 - (node + 1) // 2 END AS node, min(hop) AS hop FROM w GROUP BY w.node""",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
 n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
    "sliding_windows": "WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day, value FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1",
    "payload_updates": "SELECT c_custkey AS point_id, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment, c_nationkey::varchar AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'gold' END AS tier FROM customer",
    "backoff_delays": "WITH f AS (SELECT DISTINCT event_id % 6 AS failures FROM events) SELECT failures, least(2.0::double * least(pow(2.0, failures), 8.0), 30.0) AS delay, least(2.0::double * least(pow(2.0, failures), 8.0), 30.0) * 1.5 AS retry_delay FROM f",
    "title_texts": "SELECT record_id, concat_ws(' | ', 'Title: ' || title, CASE WHEN length(trim(type)) > 0 THEN 'Type: ' || type END) AS text, array_to_string(list_filter(coalesce(genres, []), lambda g: g IS NOT NULL AND length(trim(g)) > 0), ', ') AS genres FROM anime_records",
}
