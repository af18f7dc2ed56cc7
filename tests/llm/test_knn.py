import numpy as np
from pyspark.sql import functions as F

from catalith.llm import knn


def exact(points, queries, k):
    """(query, id) by brute force."""
    best = {}
    for q, x in queries:
        scores = {}
        for i, y in points:
            s = round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 12)
            scores[i] = max(s, scores.get(i, -2))
        best[q] = [i for i, _ in sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:k]]
    return best


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 40)
    monkeypatch.setattr(knn, "POINT_BLOCK", 15)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 32))
    points = [(f"p{i:04d}", (centres[i % 20] + 0.4 * rng.standard_normal(32)).tolist()) for i in range(800)]
    queries = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(32)).tolist()) for i in range(50)]
    got = {}
    for r in knn.most_similar(spark.createDataFrame(points, "id string, vec array<float>"), spark.createDataFrame(queries, "query_id bigint, vec array<float>"), 32).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    f32 = lambda rows: [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    want = exact(f32(points), f32(queries), 10)
    assert all(len(v) == 10 for v in got.values()) and sum(len(got[q] & set(w)) for q, w in want.items()) / 500 >= 0.9


def test_unusable_vectors_ties_and_several_vectors(spark):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame(
        [("b", [[1.0, 0.0]], "x"), ("a", [[2.0, 0.0]], "x"), ("c", [[0.0, 1.0], [1.0, 0.1]], "x"), ("z", None, "x"), ("y", [[0.0, 0.0]], "x"), ("w", [[1.0]], "x"), ("v", [[nan, 1.0]], "x"), ("u", [[inf, 1.0]], "x"), ("t", [], "x"), ("s", [None], "x")],
        "id string, vecs array<array<float>>, query_id string",
    )
    flat = points.select("id", F.explode("vecs").alias("vec"))
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 0.0]), (5, [1.0])], "query_id bigint, vec array<float>")
    got = sorted((r["query_id"], r["id"]) for r in knn.most_similar(flat, queries, 2, k=2).collect())
    assert got == [(1, "a"), (1, "b")]
    three = [r["id"] for r in knn.most_similar(flat, queries, 2, k=10).orderBy(F.desc("similarity"), "id").collect()]
    assert three == ["a", "b", "c"]
    assert knn.most_similar(flat.limit(0), queries, 2).count() == 0 and knn.most_similar(flat, queries.limit(0), 2).count() == 0


def test_points_of_several_vectors_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 150)
    monkeypatch.setattr(knn, "POINT_BLOCK", 30)
    rng = np.random.default_rng(2)
    points = [(f"p{i:03d}", (x + 0.05 * rng.standard_normal(16)).tolist()) for i, x in enumerate(rng.standard_normal((150, 16))) for _ in range(4)]
    queries = [(i, rng.standard_normal(16).tolist()) for i in range(30)] * 2
    rows = knn.most_similar(spark.createDataFrame(points, "id string, vec array<float>"), spark.createDataFrame(queries, "query_id bigint, vec array<float>"), 16).collect()
    f32 = lambda rows: [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows]
    want = exact(f32(points), f32(queries), 10)
    got = {(r["query_id"], r["id"]) for r in rows}
    assert len(rows) == len(got) == 300 and len(got & {(q, i) for q, best in want.items() for i in best}) >= 0.97 * 300


def test_a_point_of_very_many_vectors_hides_no_other():
    points = np.concatenate([np.tile([1.0, 0.0], (500, 1)), [[0.0, 1.0], [0.6, 0.8]]]).astype(np.float32)
    ids = np.asarray(["many"] * 500 + ["b", "c"], object)
    ((near, _),) = knn.block_neighbours(points, ids, np.asarray([[1.0, 0.0]], np.float32), 3, knn.Index(np.zeros(2, np.float32), np.eye(2, dtype=np.float32), np.eye(2, dtype=np.float32)))
    assert near.tolist() == ["many", "c", "b"]


def test_cells_of_few_points_and_copies_of_one(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 4)
    monkeypatch.setattr(knn, "LEAST_SAMPLED", 1)
    monkeypatch.setattr(knn, "POINT_BLOCK", 20)
    rng = np.random.default_rng(3)
    points = [(f"p{i:03d}", v) for i, v in enumerate(rng.standard_normal((60, 8)).tolist())] + [(f"same{i:03d}", [1.0] * 8) for i in range(120)]
    queries = [(i, v) for i, v in enumerate([[1.0] * 8, *rng.standard_normal((5, 8)).tolist()])]
    got = {}
    for r in knn.most_similar(spark.createDataFrame(points, "id string, vec array<float>"), spark.createDataFrame(queries, "query_id bigint, vec array<float>"), 8, k=10).collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert sorted(got[0]) == [f"same{i:03d}" for i in range(10)] and all(len(v) == 10 for v in got.values())


def test_work_of_a_query_grows_slower_than_the_points():
    """Points compared a query, at two sizes, as the cells decide it."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((400, 16))
    shares = []
    for n in (20_000, 80_000):
        x = centres[rng.integers(0, 400, n)] + 0.3 * rng.standard_normal((n, 16))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        cells = min(n // knn.CELL, knn.SAMPLE // knn.LEAST_SAMPLED)
        index = knn.Index(np.zeros(16, np.float32), np.eye(16, dtype=np.float32), x[rng.permutation(n)[:cells]])
        held = np.bincount(index.cells(x), minlength=cells)
        probed = np.argsort(-(x[:300] @ index.representatives.T), axis=1)[:, : knn.PROBES + 1]
        shares.append(held[probed].sum(axis=1).mean())
    assert shares[1] < 1.5 * shares[0]  # of four times the points


def test_cells_keep_their_size_beyond_what_the_sample_carries(spark, monkeypatch):
    for name, value in (("CELL", 32), ("SAMPLE", 400), ("NEAR_REGIONS", 12)):
        monkeypatch.setattr(knn, name, value)
    monkeypatch.setattr(knn, "POINT_BLOCK", 40)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 16))
    vectors = (centres[np.arange(4000) % 100] + 0.4 * rng.standard_normal((4000, 16))).astype(np.float32)
    points, queries = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(vectors)], [(i, v.tolist()) for i, v in enumerate(vectors[::80] + np.float32(0.05))]
    df = spark.createDataFrame(points, "id string, vec array<float>")
    held = []
    blocks = knn._blocks
    monkeypatch.setattr(knn, "_blocks", lambda h, cells, size: (held.append((h, cells)), blocks(h, cells, size))[1])
    got = {(r["query_id"], r["id"]) for r in knn.most_similar(df, spark.createDataFrame(queries, "query_id bigint, vec array<float>"), 16).collect()}
    assert held[0][1] > 400 // knn.LEAST_SAMPLED and sum(held[0][0].values()) == 4000  # more cells than the sample carries, every point in one
    assert np.mean([held[0][0][c] for c in held[0][0]]) <= 2 * knn.CELL
    want = exact([(i, np.asarray(v)) for i, v in points], [(i, np.asarray(v)) for i, v in queries], 10)
    assert len(got) == 500 and len(got & {(q, i) for q, best in want.items() for i in best}) >= 0.95 * 500
