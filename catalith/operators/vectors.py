"""Exact similarity search over dense, multiple and sparse vectors.

A query vector goes along with the plan, so a search is a scan, a projection and a top-k: no join and one small
exchange; payload is returned, the vector searched is not.  Scores
are rounded to 9 digits before ordering and ties go to the smaller id, so results do not depend on the order of work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.operators.contracts import SparseVector, check_distance

DIGITS = 9


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    """Negative distance, so that more is nearer."""
    return F.lit(0.0) - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


def similarity(distance: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine, "dot": dot, "euclid": euclid}[check_distance(distance)](a, b)


def clipped_dot(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def max_sim(query: list[list[float]], document: Column, distance: str = "dot") -> Column:
    """Sum over the query's vectors of the best similarity to any of the document's vectors."""

    def best(q: list[float]) -> Column:
        return F.array_max(F.transform(document, lambda d: similarity(distance, d, _literal(q))))

    parts = [best(q) for q in query]
    return sum(parts[1:], parts[0])


def batch_scores(distance: str, query: list[float]):  # noqa: ANN201
    """The similarity of a column of vectors of the query's length to it, one matrix product an Arrow batch.

    Higher-order functions are interpreted per element; over whole batches numpy is many times faster.
    """
    q, kind = np.asarray(query, np.float64), check_distance(distance)
    length = float(np.linalg.norm(q))

    @F.arrow_udf(T.DoubleType())
    def scores(vectors: pa.Array) -> pa.Array:
        x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), len(q))
        with np.errstate(all="ignore"):
            if kind == "euclid":
                s = 0.0 - np.sqrt(((x - q) ** 2).sum(axis=1))
            else:
                s = x @ q
                if kind == "cosine":
                    s = s / (np.sqrt((x * x).sum(axis=1)) * length)
        return pa.array(s, mask=np.isnan(s))

    return scores


def top_k(scored: DataFrame, k: int, id_col: str, threshold: float | None = None) -> DataFrame:
    kept = scored.filter(F.col("score").isNotNull()) if threshold is None else scored.filter(F.col("score") >= threshold)
    return kept.orderBy(F.desc("score"), id_col).limit(k)


def nearest(df: DataFrame, vector_col: str, query: list[float], k: int = 10, distance: str = "cosine", id_col: str = "id", threshold: float | None = None) -> DataFrame:
    """The k rows most similar to a query vector; rows whose vector is missing or of another length are no candidates."""
    usable = df.filter((F.size(vector_col) == len(query)) & ~F.exists(vector_col, lambda x: x.isNull()))
    scored = usable.withColumn("score", F.round(batch_scores(distance, query)(F.col(vector_col)), DIGITS)).drop(vector_col)
    return top_k(scored, k, id_col, threshold)


def nearest_multi(df: DataFrame, vectors_col: str, query: list[list[float]], k: int = 10, distance: str = "dot", id_col: str = "id", threshold: float | None = None) -> DataFrame:
    usable = df.filter(F.size(vectors_col) > 0)
    return top_k(usable.withColumn("score", F.round(max_sim(query, F.col(vectors_col), distance), DIGITS)), k, id_col, threshold)


def nearest_groups(df: DataFrame, key: str, vector_col: str, query: list[list[float]], k: int = 10, distance: str = "dot") -> DataFrame:
    """(key, score): the k groups of vectors most similar to several query vectors, where each row holds one vector of its group.

    Best similarities are aggregated before the exchange, so a group of any size is one row there.
    """
    usable = df.filter((F.size(vector_col) == len(query[0])) & ~F.exists(vector_col, lambda x: x.isNull()))
    scores = [batch_scores(distance, q)(F.col(vector_col)) for q in query]
    best = usable.select(key, *[s.alias(f"s{i}") for i, s in enumerate(scores)]).groupBy(key).agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(query))])
    total = sum([F.col(f"s{i}") for i in range(1, len(query))], F.col("s0"))
    return top_k(best.select(key, F.round(total, DIGITS).alias("score")), k, key)


def sparse_scores(postings: DataFrame, query: SparseVector, points: int, idf: bool = True) -> DataFrame:
    """(id, score): sparse dot products with weights of rarity; ``postings``: (id, term, weight).

    The query's terms are literals, so the postings are filtered in the scan and aggregated before the exchange.
    """
    weights = F.create_map(*[F.lit(x) for i, v in zip(query.indices, query.values) for x in (int(i), float(v))])
    hits = postings.filter(F.col("term").isin(*[int(i) for i in query.indices])).withColumn("q", F.try_element_at(weights, F.col("term").cast("int")))
    if not idf:
        return hits.groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("q")), DIGITS).alias("score"))
    df = hits.groupBy("term").agg(F.count_distinct("id").alias("df"))  # one row a query term
    rarity = F.log(1 + (F.lit(points) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return hits.join(df, "term").groupBy("id").agg(F.round(F.sum(F.col("weight") * F.col("q") * rarity), DIGITS).alias("score"))
