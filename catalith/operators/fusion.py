"""Several searches fused into one ranking, and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.models import overlap_pairs  # noqa: F401
from catalith.operators.contracts import Condition, InvalidRequest, SearchRequest
from catalith.operators.filters import apply_filters
from catalith.operators.vectors import DIGITS, nearest, nearest_multi, sparse_scores, top_k


def label_branches(branches: list[DataFrame]) -> DataFrame:
    """(branch, id, score) of several top-k results."""
    return reduce(DataFrame.unionByName, [b.select(F.lit(i).alias("branch"), "id", "score") for i, b in enumerate(branches)])


def reciprocal_rank(branches: DataFrame, k: int = 2, rank_base: int = 1) -> DataFrame:
    """(id, score): sum over the branches of 1 / (k + rank).  A branch holds at most limit x multiplier rows."""
    place = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("score"), "id")) - 1 + rank_base
    return branches.withColumn("place", place).groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), DIGITS).alias("score"))


def distribution_based(branches: DataFrame) -> DataFrame:
    """(id, score): each branch's scores scaled by its mean and three deviations, then summed; no deviation counts 0.5."""
    stats = branches.groupBy("branch").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    scaled = F.when(F.col("sd") > 1e-12, (F.col("score") - (F.col("mean") - 3 * F.col("sd"))) / (6 * F.col("sd"))).otherwise(0.5)
    return branches.join(stats, "branch").groupBy("id").agg(F.round(F.sum(scaled), DIGITS).alias("score"))


def search(points: DataFrame, request: SearchRequest, postings: DataFrame | None = None, n_points: int | None = None, text_col: str = "text_vector", image_col: str = "image_vector", id_col: str = "id") -> DataFrame:
    """(id, score) of a request: one vector searched plainly, several signals fused; filters reach every branch."""
    conditions = list(request.filters) + ([Condition("entity_type", "eq", request.entity_type)] if request.entity_type else [])
    kept = apply_filters(points, conditions)
    signals = [lambda k, v=v: nearest(kept, text_col, v, k, request.distance, id_col) for v in ([request.text] if request.text else []) + list(request.expansions)]
    if request.image:
        signals.append(lambda k: nearest_multi(kept, image_col, [request.image], k, request.distance, id_col))
    if request.sparse:
        if postings is None or n_points is None:
            raise InvalidRequest("MISSING_QUERY_INPUT", "a sparse search needs postings and the number of points")
        within = postings.join(kept.select(F.col(id_col).alias("id")), "id", "left_semi") if conditions else postings
        signals.append(lambda k: top_k(sparse_scores(within, request.sparse, n_points), k, "id"))
    plain = lambda d: d.select(F.col(id_col if id_col in d.columns else "id").alias("id"), "score")
    if len(signals) == 1:
        found = plain(signals[0](request.limit))
        return found if request.score_threshold is None else found.filter(F.col("score") >= request.score_threshold)
    branches = label_branches([plain(s(request.limit * request.multiplier)) for s in signals])
    fused = reciprocal_rank(branches, request.rrf_k, request.rank_base) if request.fusion == "rrf" else distribution_based(branches)
    return top_k(fused, request.limit, "id", request.score_threshold)


def rerank(items: DataFrame, query: str, score_pairs: Callable[[list[tuple[str, str]]], list[float]], text_col: str = "text", position_col: str = "pos", k: int | None = None) -> DataFrame:
    """Items by a pair model's score, equal ones in their order; the model scores whole Arrow batches."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score_pairs([(query, t or "") for t in texts]), dtype="float64")

    ranked = items.withColumn("reranking_score", scored(F.col(text_col))).orderBy(F.desc("reranking_score"), position_col)
    return ranked.limit(k) if k and k > 0 else ranked
