"""Queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.knn import request_neighbours
from catalith.llm.leakage import leaked
from catalith.llm.matching import character_calibration, match_characters
from catalith.llm.packing import fill_report, pack
from catalith.llm.privacy import find_personal, sanitise
from catalith.llm.survivor import NOTHING, fuse
from catalith.llm.variants import link_variants, variant_pairs
from catalith.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar points of every usable vector of the search requests."""
    found = request_neighbours(table(spark, sf_dir, "vector_points"), table(spark, sf_dir, "search_requests"))
    return found.select("request_id", "vector_field", "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value survives, per title and field."""
    return fuse(table(spark, sf_dir, "anime_records"), table(spark, sf_dir, "feeds")).select("anime_key", "field_name", "record_id")


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose status survives, per title."""
    survivors = fuse(table(spark, sf_dir, "anime_records"), table(spark, sf_dir, "feeds"))
    return survivors.filter("field_name = 'status'").select("anime_key", "record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of profiles of one title that mean the same character."""
    pairs = variant_pairs(link_variants(table(spark, sf_dir, "character_profiles")))
    return pairs.select(F.col("a").alias("profile_id_a"), F.col("b").alias("profile_id_b"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every profile with a name: profiles of one label mean the same character."""
    labels = link_variants(table(spark, sf_dir, "character_profiles"))
    return labels.select(F.col("id").alias("profile_id"), "label")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows of both character tables that mean the same character of the same show."""
    return match_characters(table(spark, sf_dir, "mal_characters"), table(spark, sf_dir, "anilist_characters")).select("mal_id", "anilist_id")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence, retrieval score and gap to the next best partner."""
    return match_characters(table(spark, sf_dir, "mal_characters"), table(spark, sf_dir, "anilist_characters"))


def p5_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the confidence of pairs left out of the fit is the share of them that is the same, by tenths."""
    return character_calibration(table(spark, sf_dir, "mal_characters"), table(spark, sf_dir, "anilist_characters"))


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which container of each kind every document, or part of one, goes to."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    containers = table(spark, sf_dir, "containers")
    return fill_report(pack(table(spark, sf_dir, "documents"), containers), containers)


def p7_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same assignment by the weighted dot product."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"), rule="dot")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of an evaluation item, with the item."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct personal details of each document, as they stand in it."""
    return find_personal(table(spark, sf_dir, "documents")).select("doc_id", "pii_type", "surface").distinct()


def p9_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with typed placeholders instead of personal details."""
    documents = table(spark, sf_dir, "documents")
    return sanitise(documents, find_personal(documents)).select("doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p3_found": p3_found, "p3_status": p3_status, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_found": p5_found, "p5_confidence": p5_confidence, "p5_calibration": p5_calibration, "p7_assignment": p7_assignment, "p7_fill": p7_fill, "p7_dot": p7_dot, "p8_found": p8_found, "p9_found": p9_found, "p9_sanitised": p9_sanitised}
SQL: dict[str, str] = {
    # status: the most recent that says something, at equal times from the more trusted feed, then the smaller id
    "p3_status": f"""
        WITH several AS (SELECT anime_key FROM anime_records WHERE anime_key IS NOT NULL GROUP BY anime_key HAVING count(*) > 1),
        said AS (
            SELECT anime_key, record_id, coalesce(trust, 0) AS trust,
                   CASE WHEN updated_at >= TIMESTAMP '2000-01-01' AND updated_at <= now()::TIMESTAMP THEN updated_at ELSE TIMESTAMP '1970-01-01' END AS stated
            FROM anime_records LEFT JOIN feeds USING (feed_id)
            WHERE anime_key IN (SELECT anime_key FROM several) AND lower(trim(regexp_replace(status, '\\s+', ' ', 'g'))) NOT IN ({", ".join("'" + t.replace("'", "''") + "'" for t in NOTHING)})
        )
        SELECT anime_key, record_id FROM said
        QUALIFY row_number() OVER (PARTITION BY anime_key ORDER BY stated DESC, trust DESC, record_id) = 1
    """,
}
