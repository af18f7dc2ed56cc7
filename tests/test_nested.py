import json

from pyspark.sql import functions as F

from catalith.operators.nested import dewey_nodes, label_document, node_table, page_tables

PAGE = {
    "anime": {"opening_themes": {"title": "one", "episodes": "1-12, 14, 20-"}, "ending_themes": [{"episodes": [[1, 2], [3, None]]}, {"episodes": [{"start": "5"}, 7, {"start": 8, "end": 8}]}]},
    "episodes_raw": [
        {"episodes": {"1": {"title_en": "A", "characters": {"name": "x", "voice_actors": '[{"name": "v0"}, {"name": "v1"}]'}}, "2": {"title_en": " "}}},
        None,
        {"title_en": "C", "characters": [{"voice_actors": ["w", {"person": {"name": "p"}}]}, {"voice_actors": {"name": "q"}}]},
    ],
}
ROWS = {
    ("theme_range", 0, 0, 0, "1-12"), ("theme_range", 0, 0, 1, "14-14"), ("theme_range", 0, 0, 2, "20-"), ("theme_range", 1, 0, 0, "1-2"), ("theme_range", 1, 0, 1, "3-"), ("theme_range", 1, 1, 0, "5-"),
    ("theme_range", 1, 1, 1, "7-7"), ("theme_range", 1, 1, 2, "8-8"), ("episode_title", 0, -1, -1, "A"), ("episode_title", 2, -1, -1, "C"), ("voice_actor", 0, 0, 0, "v0"), ("voice_actor", 0, 0, 1, "v1"),
    ("voice_actor", 2, 0, 0, "w"), ("voice_actor", 2, 0, 1, "p"), ("voice_actor", 2, 1, 0, "q"),
}


def test_shapes_and_envelopes(spark):
    text = json.dumps(PAGE)
    payloads = [text, "﻿" + text, json.dumps(text), json.dumps({"source": "m", "data": PAGE}), json.dumps({"data": [PAGE]}), text[:-9], None, "", "{}", "[]", "null", "[" * 100_000]
    pages = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "page_id bigint, payload string, path string")
    got = page_tables(pages).collect()
    for i in range(5):
        assert {tuple(r)[1:] for r in got if r["page_id"] == i} == ROWS
    assert {r["page_id"] for r in got} == set(range(5))
    assert page_tables(pages.limit(0)).count() == 0


def test_labels_give_parents(spark):
    nodes = dewey_nodes(spark.createDataFrame([(1, json.dumps(PAGE))], "page_id bigint, payload string"))
    characters = node_table(nodes, "episode.character", {"name": "name"}).alias("c")
    episodes = node_table(nodes, "episode", {"title": "title_en"}).alias("e")
    joined = characters.join(episodes, (F.col("c.id") == F.col("e.id")) & (F.col("c.parent_label") == F.col("e.label")))
    assert sorted((r["label"], r["title"]) for r in joined.select("c.label", "title").collect()) == [([0, 0], "A"), ([2, 0], "C"), ([2, 1], "C")]


def test_repeated_documents_share_ordinals():
    rows = label_document(json.dumps([{"episodes_raw": [{"title_en": "a"}]}, {"episodes_raw": {"title_en": "b"}}]))
    assert [(at, f["title_en"]) for path, at, f in rows if path == "episode"] == [((0,), "a"), ((1,), "b")]


def test_objects_wrapped_around_repeats_keep_their_links():
    rows = label_document(json.dumps({"episodes_raw": [{"details": {"characters": [{"role": {"voice_actors": [{"name": "A"}, {"name": "B"}]}}], "runtime": 24}}]}))
    assert [(path, at) for path, at, _ in rows[1:]] == [("episode", (0,)), ("episode.character", (0, 0)), ("episode.character.voice_actor", (0, 0, 0)), ("episode.character.voice_actor", (0, 0, 1))]
    assert rows[1][2] == {"details.runtime": "24"}
