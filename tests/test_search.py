import math

import pytest

from catalith.operators.contracts import Condition, InvalidRequest, Range, SearchRequest, SparseVector, check_fields, conditions_from, served_limit
from catalith.operators.filters import apply_filters, scroll
from catalith.operators.fusion import distribution_based, label_branches, overlap_pairs, reciprocal_rank, rerank, search
from catalith.operators.vectors import nearest, nearest_multi, sparse_scores


@pytest.fixture
def points(spark):
    return spark.createDataFrame(
        [("a", [1.0, 0.0], [[1.0, 0.0]], "anime", ["x", "y"], 2001), ("b", [0.0, 1.0], [[0.0, 1.0], [1.0, 1.0]], "anime", ["y"], None), ("c", [1.0, 1.0], [], "character", [], 1999), ("d", None, None, "anime", None, 2005), ("e", [0.0, 0.0], None, "anime", ["z"], 2010), ("f", [1.0], None, "anime", ["z"], 2010)],
        "id string, text_vector array<double>, image_vector array<array<double>>, entity_type string, tags array<string>, year int",
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("conditions", "want"),
    [
        ([Condition("tags", "eq", "y")], "ab"), ([Condition("tags", "ne", "y")], "aef"), ([Condition("tags", "in", ["x", "z"])], "aef"), ([Condition("tags", "not_in", ["y", "z"])], "a"),
        ([Condition("year", "range", Range(gt=1999, lte=2005))], "ad"), ([Condition("year", "eq", 2010, "must_not")], "abcd"), ([Condition("year", "eq", 1999, "should"), Condition("tags", "eq", "x", "should")], "ac"), ([], "abcdef"),
    ],
)
def test_filters(points, conditions, want):
    assert ids(apply_filters(points, conditions)) == list(want)


def test_nested_path(spark):
    df = spark.createDataFrame([("a", {"mal": (8.5, 10)}), ("b", {"x": (1.0, 1)}), ("c", None)], "id string, statistics map<string,struct<score:double,members:bigint>>")
    assert ids(apply_filters(df, [Condition("statistics.mal.score", "range", Range(gte=8))])) == ["a"]


@pytest.mark.parametrize("bad", [lambda: Range(), lambda: Condition("f", "in", []), lambda: Condition("f", "like", "x"), lambda: Condition("f", "eq", [1]), lambda: SearchRequest(), lambda: SearchRequest(text=[1.0], limit=0), lambda: SearchRequest(image=[1.0], expansions=([1.0],)), lambda: SparseVector((1, 1), (1.0, 1.0)), lambda: SparseVector((1,), ()), lambda: check_fields([Condition("secret", "eq", 1)]), lambda: conditions_from([{"field": "year", "operator": "range", "value": {"near": 1}}])])
def test_contracts(bad):
    with pytest.raises(InvalidRequest):
        bad()


def test_wire_values_and_limits():
    assert conditions_from([{"field": "year", "operator": "range", "value": {"gte": 2000.0}}])[0].value == Range(gte=2000)
    assert [served_limit(x) for x in (-1, 0, 7, 500)] == [10, 10, 7, 100]


def test_nearest(points):
    assert [(r["id"], r["score"]) for r in nearest(points, "text_vector", [1.0, 0.0], 5).collect()] == [("a", 1.0), ("c", round(1 / math.sqrt(2), 9)), ("b", 0.0)]
    assert [r["id"] for r in nearest(points, "text_vector", [1.0, 0.0], 5, "euclid").collect()] == ["a", "c", "e", "b"]
    assert [(r["id"], r["score"]) for r in nearest_multi(points, "image_vector", [[1.0, 1.0]], 5).collect()] == [("b", 2.0), ("a", 1.0)]


def test_sparse(spark):
    postings = spark.createDataFrame([(1, 5, 2.0), (2, 5, 1.0), (2, 7, 1.0), (3, 9, 1.0)], "id bigint, term bigint, weight double")
    got = {r["id"]: r["score"] for r in sparse_scores(postings, SparseVector((5, 7), (1.0, 1.0)), 3).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    assert got == {1: pytest.approx(2 * idf(2), abs=1e-8), 2: pytest.approx(idf(2) + idf(1), abs=1e-8)}


def test_fusion(spark, points):
    a, b = (spark.createDataFrame(rows, "id string, score double") for rows in ([("x", 3.0), ("y", 2.0), ("z", 1.0)], [("y", 5.0), ("w", 5.0)]))
    got = {r["id"]: r["score"] for r in reciprocal_rank(label_branches([a, b])).collect()}
    assert got == {"x": pytest.approx(1 / 3), "y": pytest.approx(1 / 4 + 1 / 4), "z": pytest.approx(1 / 5), "w": pytest.approx(1 / 3)}
    scaled = {r["id"]: r["score"] for r in distribution_based(label_branches([a, b])).collect()}
    assert scaled["w"] == 0.5 and scaled["y"] == pytest.approx(1.0)
    request = SearchRequest(text=[1.0, 0.0], image=[0.0, 1.0], entity_type="anime", limit=2)
    assert [r["id"] for r in search(points, request).collect()] == ["a", "b"]


def test_rerank_is_stable(spark):
    items = spark.createDataFrame([(i, t, i) for i, t in enumerate(["b c", "a b", "a", "a b", None])], "id int, text string, pos int")
    assert [r["id"] for r in rerank(items, "a b", overlap_pairs, k=3).collect()] == [1, 3, 0]


def test_scroll(points):
    first = [r["id"] for r in scroll(points, 2).collect()]
    assert first == ["a", "b"] and [r["id"] for r in scroll(points, 9, first[-1]).collect()] == ["c", "d", "e", "f"]
