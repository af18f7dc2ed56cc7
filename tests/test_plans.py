import pytest

from catalith.plans import more_queries, search_queries


@pytest.fixture
def sf_dir(spark, tmp_path):
    """A data directory of few rows, among them keys beyond those of the small sizes."""
    customers = [(k, k % 2, "BUILDING") for k in (0, 1, 1000, 1001, 99_999, 100_000, 100_001, 150_000, 1_000_001)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    parts = [(k, "green blue small part" if k == 900 else "red blue tin" if k > 500 else "red tin") for k in range(1000)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_payload_updates_of_all_customers(spark, sf_dir):
    got = {r["point_id"]: (r["segment"], r["nation"], r["tier"]) for r in more_queries.payload_updates(spark, sf_dir).collect()}
    assert len(got) == 9 and got[1001] == ("BUILDING", "1", None) and got[150_000] == ("NEW", "0", "gold")


def test_reachable_customers_of_any_key(spark, sf_dir):
    got = sorted((r["node"], r["hop"]) for r in more_queries.reachable(spark, sf_dir).collect())
    keys = (0, 1, 1000, 1001, 99_999, 100_000, 100_001, 150_000, 1_000_001)
    assert got == sorted([(1_000_001, 0), (100_000, 1), (100_001, 1), *[(k, 2) for k in keys]])


def test_rerank_of_all_parts(spark, sf_dir):
    got = [(r["p_partkey"], r["score"]) for r in search_queries.rerank_overlap(spark, sf_dir).collect()]
    assert got == [(900, 1.0), *[(k, 0.25) for k in range(501, 520)]]
