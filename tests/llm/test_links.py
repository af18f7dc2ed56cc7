import random

import numpy as np
from pyspark.sql import functions as F

from catalith.llm import matching
from catalith.llm.components import components
from catalith.llm.matching import match_characters, title_key
from catalith.llm.variants import link_variants, variant_pairs


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [("g", rng.randint(0, 60), f"k{rng.randint(0, 45)}") for _ in range(70)] + [("h", i, f"c{j}") for i in range(100, 140) for j in (i, i + 1)]
    parent = {i: i for _, i, _ in links}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for _, i, k in links:
        a, b = root(i), root(by.setdefault(k, i))
        parent[max(a, b)] = min(a, b)
    ids = spark.createDataFrame([(i,) for i in [*parent, 999]], "id bigint")
    df = spark.createDataFrame(links, "g string, id bigint, key string")
    want = {i: root(i) for i in parent} | {999: 999}
    assert {r["id"]: r["label"] for r in components(ids, df).collect()} == want
    import catalith.llm.components as module

    size, module.CHUNK = module.CHUNK, 3  # many chunks: the rest is settled by least labels
    try:
        assert {r["id"]: r["label"] for r in components(ids, df).collect()} == want
    finally:
        module.CHUNK = size


SCHEMA = "profile_id bigint, anime_key bigint, name string, name_variations array<string>, nicknames array<string>, alternative array<string>, label string, g string"


def test_variants(spark):
    rows = [
        (1, 5, "Saeto Morisaki", ["MORISAKI Saeto"], ["The Crimson Fox"], []), (2, 5, "Saeto Molisaki", None, [], None), (3, 5, "S. Morisaki", [], [], []), (4, 5, "Saeto Moirsaki", [], [], []), (5, 5, "Crimson Fox", [], ["the crimson fox"], []),
        (6, 5, "Saepyon", [], [], []), (7, 5, "Wakato Morisaki", [], [], []), (8, 5, "ワカト・モリサキ", [], [], []), (9, 6, "Saeto Morisaki", [], [], []), (10, None, "Saeto Morisaki", [], [], []), (11, 5, None, None, None, None), (12, 5, "", [""], [None], []),
        (13, 5, "x" * 300, [], [], []), (14, 5, "Wakato Morisaki", [], [], []),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {tuple(r) for r in variant_pairs(link_variants(df)).collect()}
    groups = [{1, 2, 3, 4, 5, 6}, {7, 8, 14}]
    assert got == {(a, b) for s in groups for a in s for b in s if a < b}
    assert variant_pairs(link_variants(df.limit(0))).count() == 0


VA = "array<struct<name:string,language:string>>"


def test_matching(spark):
    mal = spark.createDataFrame(
        [(1, "Kazeuchi, Emato", "風内・絵馬斗", [("Hideto Yamakubo", "Japanese")], "Female", "39", ["Stolen Robot"]), (2, "Kazeuchi, Takasuke", "風内鷹介", None, None, None, ["Stolen Robot"]), (3, "Kazeuchi, Emato", None, None, None, None, ["Other Show"]), (4, None, None, None, None, None, None), (5, "Umidou, Neneto", None, [("Norimaru Tokugaoka", "Japanese")], "Male", None, ["STOLEN ROBOT"])],
        f"mal_id bigint, name string, name_native string, voice_actors {VA}, gender string, age string, animeography array<string>",
    )
    anilist = spark.createDataFrame(
        [(10, "Emato Kazeuchi", "カゼウチエマト", None, [("Yamakubo, Hideto", "ja")], "Female", "39-40", ["Stolen Robot (TV)"]), (11, "Ematto Cazeuchi", "風内 絵馬斗", [], None, None, None, ["Stolen Robot"]), (12, "Isami Kazeuchi", "風内勇美", [], None, None, None, ["Stolen Robot"]), (13, "Neneto Umidou", None, ["Neneto Umido"], None, "Male", None, ["Stolen Robot"]), (14, "", None, None, None, None, None, [])],
        f"anilist_id bigint, name string, name_native string, alternative array<string>, voice_actors {VA}, gender string, age string, media_titles array<string>",
    )
    got = match_characters(mal, anilist).collect()
    assert {(r["mal_id"], r["anilist_id"]) for r in got} == {(1, 10), (1, 11), (5, 13)} and all(0.5 <= r["confidence"] <= 1 for r in got)
    assert match_characters(mal.limit(0), anilist).count() == 0
    twice = mal.unionByName(mal.filter("mal_id = 5").withColumn("mal_id", F.lit(6).cast("bigint")))
    assert {r["mal_id"] for r in match_characters(twice, anilist).filter("anilist_id = 13").collect()} == {5, 6}
    assert title_key("The Résumé: Part-2 (TV)") == "resume part 2"


def test_pruning_changes_nothing(spark):
    rng = random.Random(7)
    part = lambda: "".join(rng.choice("kstnhmr") + rng.choice("aiueo") for _ in range(3)).capitalize()
    cast = [(i, f"{part()} {part()}", rng.choice(["Male", "Female"]), str(rng.randint(15, 20)), f"Show {i % 4}") for i in range(120)]
    schema = "id bigint, names array<string>, native string, actors array<string>, languages array<string>, gender string, age string, titles array<string>"
    left = spark.createDataFrame([(i, [name], None, [], [], g, age, [title]) for i, name, g, age, title in cast], schema)
    right = spark.createDataFrame([(1000 + i, [name if i % 3 else name[:-1]], None, [], [], g, age if i % 2 else None, [title]) for i, name, g, age, title in cast], schema)
    a, b = matching.documents(left), matching.documents(right)
    kept, every = (sorted(map(tuple, matching.retrieve(a, b, pruned).collect())) for pruned in (True, False))
    assert kept == every and len(kept) >= 120


def test_few_telling_pairs_leave_the_weights_near_the_prior():
    x = np.random.default_rng(1).standard_normal((4, len(matching.PRIOR)))
    assert np.allclose(matching.fit_logistic(x[:0], np.zeros(0), matching.PRIOR), matching.PRIOR)
    assert np.abs(matching.fit_logistic(x, np.array([0.0, 1.0, 0.0, 1.0]), matching.PRIOR) - matching.PRIOR).max() < 2.5


def test_the_fit_converges_from_a_prior_far_off():
    rng = np.random.default_rng(2)
    n = len(matching.PRIOR)
    x = np.hstack([np.ones((20_000, 1)), 5 * rng.standard_normal((20_000, n - 1))])
    y = (x @ rng.standard_normal(n) > 0).astype(float)  # separable
    w = matching.fit_logistic(x, y, -50 * np.ones(n))
    p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
    assert np.abs(x.T @ (y - p) - (w + 50)).max() < 1e-2 * len(x) ** 0.5 and ((p > 0.5) == y).mean() > 0.98


def test_the_fit_takes_the_least_hashes_and_moves_few_rows(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIT_PAIRS", 100)
    pairs = spark.range(0, 6000, 1, 6).select(F.col("id").alias("ra"), (F.col("id") * 3).alias("rb"))
    some, every = ([(r["hash"], r["ra"], r["rb"]) for r in d.select("hash", "ra", "rb").collect()] for d in (matching._least_hashed(pairs), pairs.withColumn("hash", F.xxhash64("ra", "rb"))))
    assert sorted(some)[:100] == sorted(every)[:100] and len(some) < 300  # each of six partitions had sent 100
    assert matching._least_hashed(pairs.limit(150)).count() == 150 and matching._least_hashed(pairs.limit(0)).count() == 0


def test_rows_entered_many_times_are_all_matched(spark):
    schema = "id bigint, names array<string>, native string, actors array<string>, languages array<string>, gender string, age string, titles array<string>"
    actors = ["Yamakubo, Hideto", *(f"Tokugaoka, {x}" for x in ("Nori", "Kenta", "Saburo", "Minato", "Reiji", "Goro"))]
    left = spark.createDataFrame([(i, ["Kazeuchi, Emato"], "風内絵馬斗", actors[: 1 + i], ["ja"] * (1 + i), "Female", "39", ["Show"]) for i in range(7)], schema)
    right = spark.createDataFrame([(100, ["Emato Kazeuchi"], "風内絵馬斗", actors[:1], ["ja"], "Female", "39", ["Show"])], schema)
    scores = [r["score"] for r in matching.retrieve(matching.documents(left), matching.documents(right)).collect()]
    assert len(set(scores)) == 7 and min(scores) >= matching.NEAR_RIGHT * max(scores)  # no ties, all near the best
    assert {(r["left_id"], r["right_id"]) for r in matching.match_tables(left, right).collect()} == {(i, 100) for i in range(7)}
