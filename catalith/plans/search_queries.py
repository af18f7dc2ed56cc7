"""Filters, similarity search and fusion over the test tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators.contracts import Condition, Range, SearchRequest, SparseVector
from catalith.operators.filters import apply_filters, scroll
from catalith.operators.fusion import distribution_based, label_branches, overlap_pairs, reciprocal_rank, rerank, search
from catalith.operators.vectors import clipped_dot, nearest, nearest_groups, sparse_scores, top_k
from catalith.runtime import table


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One query vector, as it would come with a request."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = apply_filters(table(spark, sf_dir, "embeddings"), [Condition("label", "ne", 3)])
    return nearest(points, "embedding", _vector(spark, sf_dir, 0), 10, "cosine", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir, 1), 20, "dot", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir, 2), 20, "euclid", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _vector(spark, sf_dir, 0), 1000, "cosine", "vec_id", threshold=0.2).select("vec_id", F.round("score", 6).alias("score"))


def clipped_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _vector(spark, sf_dir, 4)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(clipped_dot(F.col("embedding"), q), 6).alias("score"))


def multivector_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = [_vector(spark, sf_dir, 0), _vector(spark, sf_dir, 1)]
    return nearest_groups(table(spark, sf_dir, "embeddings"), "label", "embedding", query, 5).select("label", F.round("score", 6).alias("score"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter(F.length("word") > 2)
    return words.groupBy("id", "word").agg(F.count("*").cast("double").alias("weight"))


QUERY_WORDS = ("lantern", "dragon", "bakery")


def sparse_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {w: i for i, w in enumerate(QUERY_WORDS)}
    postings = _postings(spark, sf_dir).filter(F.col("word").isin(*terms)).withColumn("term", F.try_element_at(F.create_map(*[F.lit(x) for p in terms.items() for x in p]), F.col("word")))
    n = table(spark, sf_dir, "documents").filter(F.length("text") > 0).count()
    found = sparse_scores(postings.select("id", "term", "weight"), SparseVector((0, 1, 2), (1.0, 0.5, 0.25)), n)
    return top_k(found, 20, "id").select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    found = [nearest(points, "embedding", _vector(spark, sf_dir, i), 100, "dot", "id").withColumn("score", F.round("score", 6)) for i in (0, 1)]
    return label_branches(found)


def fusion_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(reciprocal_rank(_branches(spark, sf_dir)), 10, "id").select("id", F.round("score", 6).alias("score"))


def fusion_dbsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(distribution_based(_branches(spark, sf_dir)).withColumn("score", F.round("score", 6)), 10, "id").select("id", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole request path: text, an expansion and a filter, fused."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_vector"), "label")
    request = SearchRequest(text=_vector(spark, sf_dir, 0), expansions=(_vector(spark, sf_dir, 1),), filters=(Condition("label", "range", Range(gte=2)),), distance="dot")
    return search(points, request).select("id", F.round("score", 6).alias("score"))


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_partkey").alias("pos"))
    return rerank(items, "green blue small part", overlap_pairs, k=20).select("p_partkey", F.round("reranking_score", 6).alias("score"))


def filter_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [
        Condition("l_returnflag", "in", ["A", "R"]), Condition("l_quantity", "range", Range(gte=10, lt=40)), Condition("l_linestatus", "ne", "O"),
        Condition("l_discount", "eq", 0.05, "must_not"), Condition("l_linenumber", "eq", 1, "should"), Condition("l_tax", "not_in", [0.0, 0.02], "should"),
    ]
    return apply_filters(table(spark, sf_dir, "lineitem"), conditions).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def filter_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = apply_filters(table(spark, sf_dir, "anime_records"), [Condition("anime_season.year", "range", Range(gte=2010)), Condition("genres", "in", ["Comedy", "Drama"])])
    return records.select("record_id")


def filter_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A must_not keeps rows without the field."""
    return apply_filters(table(spark, sf_dir, "anime_records"), [Condition("type", "eq", "TV", "must_not")]).groupBy(F.coalesce("type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def scroll_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scroll(table(spark, sf_dir, "orders"), 50, 1000, "o_orderkey", (Condition("o_orderstatus", "eq", "F"),)).select("o_orderkey", "o_orderstatus")


QUERIES = {
    "knn_cosine": knn_cosine, "knn_dot": knn_dot, "knn_euclid": knn_euclid, "knn_threshold": knn_threshold, "clipped_similarity": clipped_similarity, "multivector_maxsim": multivector_maxsim,
    "sparse_idf": sparse_idf, "fusion_rrf": fusion_rrf, "fusion_dbsf": fusion_dbsf, "hybrid_search": hybrid_search, "rerank_overlap": rerank_overlap, "filter_operators": filter_operators,
    "filter_nested": filter_nested, "filter_missing": filter_missing, "scroll_page": scroll_page,
}

_Q = "(SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = {0})"
_BRANCH = """b AS (SELECT * FROM (SELECT 0 AS branch, vec_id AS id, round(list_inner_product(embedding::double[], (SELECT v FROM q0)), 6) AS score FROM pts ORDER BY score DESC, id LIMIT 100)
  UNION ALL SELECT * FROM (SELECT 1 AS branch, vec_id AS id, round(list_inner_product(embedding::double[], (SELECT v FROM q1)), 6) AS score FROM pts ORDER BY score DESC, id LIMIT 100))"""
_Q01 = "q0 AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0), q1 AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 1)"
_RRF = "SELECT id, round(sum(1.0 / (2 + place)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY score DESC, id) AS place FROM b) GROUP BY id ORDER BY sum(1.0 / (2 + place)) DESC, id LIMIT 10"
SQL = {
    "knn_cosine": f"SELECT vec_id, round(list_cosine_similarity(embedding::double[], q.v), 6) AS score FROM embeddings, {_Q.format(0)} q WHERE label <> 3 ORDER BY score DESC, vec_id LIMIT 10",
    "knn_dot": f"SELECT vec_id, round(list_inner_product(embedding::double[], q.v), 6) AS score FROM embeddings, {_Q.format(1)} q ORDER BY score DESC, vec_id LIMIT 20",
    "knn_euclid": f"SELECT vec_id, round(0.0 - list_distance(embedding::double[], q.v), 6) AS score FROM embeddings, {_Q.format(2)} q ORDER BY score DESC, vec_id LIMIT 20",
    "knn_threshold": f"SELECT vec_id, round(list_cosine_similarity(embedding::double[], q.v), 6) AS score FROM embeddings, {_Q.format(0)} q WHERE list_cosine_similarity(embedding::double[], q.v) >= 0.2 ORDER BY score DESC, vec_id LIMIT 1000",
    "clipped_similarity": f"SELECT vec_id, round(least(greatest(list_inner_product(embedding::double[], q.v), 0.0), 1.0), 6) AS score FROM embeddings, {_Q.format(4)} q",
    "multivector_maxsim": f"WITH {_Q01} SELECT label, round(max(list_inner_product(embedding::double[], (SELECT v FROM q0))) + max(list_inner_product(embedding::double[], (SELECT v FROM q1))), 6) AS score FROM embeddings GROUP BY label ORDER BY score DESC, label LIMIT 5",
    "sparse_idf": """WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), p AS (SELECT doc_id, word, count(*)::double AS weight FROM w WHERE word IN ('lantern','dragon','bakery') GROUP BY ALL),
  df AS (SELECT word, count(DISTINCT doc_id) AS df FROM p GROUP BY word), n AS (SELECT count(*) AS n FROM documents WHERE length(text) > 0)
  SELECT doc_id, round(sum(weight * CASE p.word WHEN 'lantern' THEN 1.0 WHEN 'dragon' THEN 0.5 ELSE 0.25 END * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM p JOIN df USING (word), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""",
    "fusion_rrf": f"WITH {_Q01}, pts AS (SELECT * FROM embeddings), {_BRANCH} {_RRF}",
    "fusion_dbsf": f"WITH {_Q01}, pts AS (SELECT * FROM embeddings), {_BRANCH}, s AS (SELECT branch, avg(score) AS m, stddev_pop(score) AS sd FROM b GROUP BY branch) SELECT id, round(sum(CASE WHEN sd > 1e-12 THEN (score - (m - 3 * sd)) / (6 * sd) ELSE 0.5 END), 6) AS score FROM b JOIN s USING (branch) GROUP BY id ORDER BY score DESC, id LIMIT 10",
    "hybrid_search": f"WITH {_Q01}, pts AS (SELECT * FROM embeddings WHERE label >= 2), {_BRANCH} {_RRF}",
    "rerank_overlap": """WITH i AS (SELECT p_partkey, list_distinct(regexp_split_to_array(trim(lower(p_name)), '\\s+')) AS w FROM part)
  SELECT p_partkey, round(len(list_intersect(w, ['green','blue','small','part'])) / 4.0, 6) AS score FROM i ORDER BY score DESC, p_partkey LIMIT 20""",
    "filter_operators": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag IN ('A','R') AND l_quantity >= 10 AND l_quantity < 40 AND l_linestatus <> 'O' AND NOT l_discount = 0.05 AND (l_linenumber = 1 OR l_tax NOT IN (0.0, 0.02)) GROUP BY ALL""",
    "filter_nested": "SELECT record_id FROM anime_records WHERE anime_season.year >= 2010 AND list_has_any(genres, ['Comedy','Drama'])",
    "filter_missing": "SELECT coalesce(type, 'none') AS type, count(*) AS n FROM anime_records WHERE NOT coalesce(type = 'TV', false) GROUP BY 1",
    "scroll_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50",
}
