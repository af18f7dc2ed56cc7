import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalith.functions import arrays, dates, enums, names, numbers, text
from catalith.functions.models import HashingEncoder, encode_column
from catalith.operators import assembly, dedup, joins, quality, tables
from catalith.sources import extract, files, mappers
from catalith.streaming import state


def value(spark, column):
    r = spark.range(1).select(column.alias("v")).first()["v"]
    return r.asDict(recursive=True) if hasattr(r, "asDict") else r


@pytest.mark.parametrize(("text_", "want"), [("2024-04-20", "2024-04-19 15:00:00"), ("20.04.2024", "2024-04-19 15:00:00"), ("2024-04-20T00:00:00Z", "2024-04-19 15:00:00"), ("2024-04-20T12:30:00+09:00", "2024-04-20 03:30:00"), ("2024-04-20T12:30:00", "2024-04-20 12:30:00"), ("soon", None), ("", None)])
def test_parse_date(spark, text_, want):
    assert value(spark, F.date_format(dates.parse_date(F.lit(text_)), "yyyy-MM-dd HH:mm:ss")) == want


def test_dates(spark):
    lit, now = F.lit, F.lit("2025-01-01 00:00:00").cast("timestamp")
    none = F.lit(None).cast("string")
    assert [value(spark, dates.airing_status(lit(a), lit(b) if b else none, now)) for a, b in (("2024-10-04", "2024-12-20"), ("1999-10-20", None), ("2025-04-01", None), ("", None))] == ["FINISHED", "ONGOING", "UPCOMING", "UNKNOWN"]
    assert [value(spark, dates.season_of(lit(d))) for d in ("2024-12-25", "20.04.2024", "2024-10-04", "invalid")] == ["WINTER", "SPRING", "FALL", None]
    assert value(spark, dates.year_of(lit("20.04.2024"))) == 2024 and value(spark, dates.year_of(lit("0000-01-01"))) is None
    assert value(spark, dates.offset_time_to_utc(lit("2024-01-01T00:30:00+09:00"))) == "2023-12-31T15:30:00Z" and value(spark, dates.offset_time_to_utc(lit("later"))) == "later"
    assert [value(spark, dates.iso_date(lit(d))) for d in ("Oct 20, 1999", "20. Oct 1999", "1999-10-20", "2026", "?")] == ["1999-10-20", "1999-10-20", "1999-10-20", "2026-01-01", None]
    assert [value(spark, dates.duration_seconds(lit(d))) for d in ("1 hr. 30 min.", "01:02:03", "24 min. per ep.", "0 min", "?")] == [5400, 3723, 1440, None, None]
    assert value(spark, dates.broadcast_parts(lit("Sundays at 23:15 (JST)"))) == {"day": "Sundays", "time": "23:15", "zone": "JST"}
    assert value(spark, dates.aired_range(lit("Oct 20, 1999 to ?"))) == {"start": "Oct 20, 1999", "end": None}
    assert value(spark, dates.premiered(lit("Fall 1999"))) == {"season": "fall", "year": 1999}


def test_numbers(spark):
    assert value(spark, numbers.deterministic_id(F.lit("a_1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a_1")) and value(spark, numbers.deterministic_id(F.lit(" "))) is None
    assert [value(spark, numbers.scaled_score(F.lit(x), f)) for x, f in (("82.5", 0.1), ("0", 1.0), ("x", 1.0), ("6", 2.0))] == [8.25, None, None, 10.0]
    assert value(spark, numbers.percent_score(F.lit(0))) == 0.0 and value(spark, numbers.parse_number(F.lit("#1,157"))) == 1157 and value(spark, numbers.first_number(F.lit("Rank #1,157 of all"))) == 1157
    assert len(value(spark, numbers.cache_key("p", "s", F.lit("x" * 300)))) == 68


def test_text(spark):
    lit = F.lit
    assert value(spark, text.title_case(lit("it's 2nd one-piece"))) == "It'S 2Nd One-Piece"
    assert value(spark, text.planet_title(lit("Movie Title 2023-12-01 - 2023-12-01 Movie"))) == "Movie"
    assert value(spark, text.provider(lit("https://www.anime-planet.com/anime/x"))) == "Anime-Planet" and value(spark, text.provider(lit("https://a.b/c"))) == "a.b"
    assert value(spark, text.stable_id(F.array(lit("https://anilist.co/anime/5"), lit("https://myanimelist.net/anime/7/x")), lit("T"), lit("TV"))) == "mal:7"
    assert value(spark, text.percent_normal(lit("https://a.b/c%20d?x=1"))) == "https://a.b/c%20d?x=1"
    assert value(spark, text.strip_markup(lit(" itâ€™s &#38; Â©\n"))) == "it’s & ©" and value(spark, text.strip_markup(lit("Été â 日本"))) == "Été â 日本"
    assert value(spark, text.strip_markup(lit("<p>CafÃ© &amp; <b>x</b></p>"))) == "Café & x" and value(spark, text.unicode_fold(lit("Éß"))) == "éss"
    assert value(spark, text.fallback_title(lit("https://simkl.com/1"))) == "Related Anime (Simkl)" and value(spark, text.relation_from_url(lit("/x-OVA-2"))) == "OVA"
    assert value(spark, text.token_sort_similarity(lit("b a"), lit("a b"))) == 1.0 and value(spark, text.token_set_similarity(lit("a b c"), lit("a b"))) == 1.0
    assert value(spark, text.romaji(lit("シャチョウ"))) == "shachou"


def test_arrays(spark):
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert value(spark, arrays.distinct_ignoring_case(a("A", " b"), a("a", "B", "", "c"))) == ["A", "b", "c"]
    assert value(spark, arrays.nickname_distinct(a("X", "x (big)", "Y"))) == ["x (big)", "Y"]
    assert [tuple(r) for r in value(spark, arrays.episode_ranges(F.lit("eps 1-30, 492, 1139-")))] == [(1, 30), (492, 492), (1139, None)]
    assert value(spark, arrays.theme_song(F.lit('1: "Go" by X (eps 1-12)'))) == {"title": "Go", "artist": "X", "episodes": "1-12"}
    assert value(spark, arrays.same_multiset(a("x", "y"), a("y", "x"))) is True


def test_enums(spark):
    assert [value(spark, enums.STATUS.normalise(F.lit(s))) for s in ("FINISHED", "Currently Airing", "odd")] == ["FINISHED", "ONGOING", "UNKNOWN"]
    assert value(spark, enums.SEASON.normalise(F.lit("odd"))) is None and value(spark, enums.ROLE.normalise(F.lit("unknown"))) == "BACKGROUND"
    assert value(spark, enums.planet_relation(F.lit("same_franchise"), F.lit(None).cast("string"))) == "Other" and value(spark, enums.MEDIA_TYPE.normalise(F.lit("tv_short"))) == "TV SHORT"


def test_names():
    same = [("Shiori", "Siori"), ("Yūta", "Yuuta"), ("Kazehara", "Cazehala"), ("Sohko", "Souko"), ("Fujiuchi", "Huziuti"), ("ワカノスケ", "Wakanosuke"), ("Schinshima", "Shinshima")]
    assert all(names.sound_key(a) == names.sound_key(b) for a, b in same) and names.sound_key("Saeto") != names.sound_key("Saeko")
    assert names.name_forms("Saeto the Crimson Fox")[1] == names.Form("name", ("saeto",)) and names.name_forms("M. Umifune")[0].kind == "initial" and names.name_forms("") == ()


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_and_deletions(a, b):
    def slow(x, y):
        if not x or not y:
            return len(x) + len(y)
        d = min(slow(x[:-1], y) + 1, slow(x, y[:-1]) + 1, slow(x[:-1], y[:-1]) + (x[-1] != y[-1]))
        if len(x) > 1 and len(y) > 1 and x[-1] == y[-2] and x[-2] == y[-1]:
            d = min(d, slow(x[:-2], y[:-2]) + 1)
        return d

    d = slow(a, b)
    assert names.edit_distance(a, b, 6) == d
    if d <= 1:
        assert names.deletions(a, 1) & names.deletions(b, 1)


def test_duplicates(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 3, "c"), (None, 4, "d")], "key string, pos int, v string")
    assert sorted((str(r["key"]), r["v"]) for r in dedup.keep_last(df, ["key"], "pos").collect()) == [("None", "d"), ("j", "c"), ("k", None)]
    with pytest.raises(dedup.DuplicateKey):
        dedup.require_unique(df, ["key"])
    rows = spark.createDataFrame([("t", 2, "UNKNOWN", 5, ["b"]), ("t", 1, "", None, ["a", "b"]), ("t", 3, "FINISHED", 7, None)], "title string, pos int, status string, episodes int, tags array<string>")
    assert dedup.merge_groups(rows, ["title"], "pos", ["status"], ["episodes"], ["tags"]).collect()[0][1:] == (1, "FINISHED", 7, ["a", "b"])
    similar = spark.createDataFrame([(["x", "y", "X", "z"], [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.0, 1.0]])], "names array<string>, vectors array<array<double>>")
    assert dedup.distinct_by_meaning(similar, "names", "vectors").first()["names"] == ["x", "z"]


def test_joins(spark):
    old, new = (spark.createDataFrame(r, "id int, a string") for r in ([(1, "x"), (2, "y"), (3, None)], [(2, "z"), (3, None), (4, "w")]))
    assert sorted((r["id"], r["change"], r["fields"]) for r in joins.snapshot_diff(old, new, "id", ["a"]).collect()) == [(1, "removed", []), (2, "changed", ["a"]), (3, "identical", []), (4, "added", [])]
    scored = spark.createDataFrame([(1, 10, 0.95), (1, 11, 0.99), (2, 12, 0.75), (2, 13, 0.8), (3, 14, 0.6)], "q int, c int, score double")
    assert sorted(tuple(r)[:2] for r in joins.best_match(scored, "q", "c", "c").collect()) == [(1, 10), (2, 13)]
    a, b = spark.createDataFrame([("https://x/a/1",), ("https://x/b",)], "l string"), spark.createDataFrame([("https://x/a", 1), ("https://x/a/1/2", 2)], "r string, pos int")
    assert [tuple(r) for r in joins.prefix_matches(a, b, "l", "r", "pos", (9, 11, 13)).collect()] == [("https://x/a/1", "https://x/a", 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    assert sorted(tuple(r) for r in joins.k_hop(edges, [1], 2).collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_tables(spark, tmp_path):
    c = tables.Collection(spark, str(tmp_path / "points"))
    assert not c.exists()
    c.create("id string, v int", {"text": 2})
    c.create("id string, v int", {"text": 2})
    with pytest.raises(ValueError):
        c.create("id string, v int", {"text": 3})
    result = c.add(spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "id string, v int, pos int"), position="pos")
    assert (result.total, result.successful, result.duplicates_removed) == (3, 2, 1)
    c.add(spark.createDataFrame([("b", 9)], "id string, v int"))
    assert sorted(map(tuple, c.read().collect())) == [("a", 2), ("b", 9)]
    c.clear()
    assert c.read().count() == 0 and c.delete() and not c.exists()
    points = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", {"x": "3"})], "point_id string, payload map<string,string>")
    updates = spark.createDataFrame([("a", {"y": "5"}, 1), ("a", {"y": "6", "z": "7"}, 2)], "point_id string, payload map<string,string>, pos int")
    assert {r["point_id"]: r["payload"] for r in tables.update_payload(points, updates).collect()} == {"a": {"x": "1", "y": "6", "z": "7"}, "b": {"x": "3"}}
    assert {r["point_id"]: r["payload"] for r in tables.update_payload(points, updates, "overwrite").collect()}["a"] == {"y": "6", "z": "7"}
    vectors = spark.createDataFrame([("a", [1.0], [2.0])], "point_id string, text_vector array<double>, image_vector array<double>")
    new = spark.createDataFrame([("a", "text_vector", [5.0], 1), ("a", "text_vector", [6.0], 2)], "point_id string, vector_name string, vector array<double>, pos int")
    assert tuple(tables.update_vectors(vectors, new).first()) == ("a", [6.0], [2.0])


def test_quality(spark):
    df = spark.createDataFrame([(1, "T", [], " odd "), (2, None, ["g"], "FINISHED")], "id int, title string, genres array<string>, status string")
    rules = [*quality.required("title"), *quality.empties(df.select("genres").schema), quality.one_of("status", "FINISHED", "UNKNOWN")]
    assert sorted((r["id"], r["kind"]) for r in quality.exploded(quality.validate(df, rules), "id").collect()) == [(1, "empty_collection"), (1, "schema"), (2, "missing")]
    fixed = {r["id"]: r for r in quality.validate_and_fix(df, rules, {"status": (("FINISHED", "UNKNOWN"), "UNKNOWN")}).collect()}
    assert fixed[1]["fixes"] == ["genres", "status"] and fixed[1]["errors"] == 0 and fixed[2]["errors"] == 1


def test_state(spark, tmp_path):
    step, s, trace = state.breaker_step, ("CLOSED", 0, 0.0), []
    for t, ok in ((0, False), (1, False), (2, True), (70, True), (71, False)):
        s = step(*s, ok, t, 2, 60)
        trace.append(s[0])
    assert trace == ["CLOSED", "OPEN", "OPEN", "CLOSED", "CLOSED"]
    spark.createDataFrame([("s", float(t), ok) for t, ok in ((0, False), (1, False), (2, True), (70, True))], "service string, ts double, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("service string, ts double, ok boolean").parquet(str(tmp_path / "in"))
    query = state.circuit_breaker(stream, 2, 60).writeStream.outputMode("append").format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [r["state"] for r in spark.sql("SELECT * FROM breaker ORDER BY ts").collect()] == ["CLOSED", "OPEN", "OPEN", "CLOSED"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("timeout")
        return 7

    assert state.with_retry(flaky, sleep=lambda _: None) == 7
    assert state.lowest_free_id(spark.createDataFrame([(1,), (2,), (4,)], "id bigint")).first()[0] == 3 and state.lowest_free_id(spark.createDataFrame([], "id bigint")).first()[0] == 1


def test_streaming_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", 2.0), ("2024-01-01 00:05:00", 4.0)]
    spark.createDataFrame(rows, "ts string, value double").select(F.col("ts").cast("timestamp"), "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = state.windowed_counts(stream, "ts", "value", "1 minute", late="1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT n, total FROM windows ORDER BY window.start").collect()] == [(2, 3.0), (1, 4.0)]


def test_extraction(spark):
    page = '<h1 class="title-name x">My <b>T</b></h1><span itemprop="genre">A</span><table class="entries-table"><tr><td class="ar">Sequel:</td><td><li><a href="/anime/5">X</a></li></td></tr></table><script type="application/ld+json">{"a":1}</script><div><span class="dark">Studios:</span> <a>S</a></div>'
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<" * 5000)], "page_id bigint, html string")
    got = {r["page_id"]: r for r in extract.extract(pages, extract.MAL_ANIME).collect()}
    assert got[1]["title"] == "My T" and got[1]["related"][0]["url"] == "/anime/5" and got[2]["title"] is None
    assert value(spark, extract.json_ld(F.lit(page))) == '{"a":1}' and value(spark, extract.sidebar_field(F.lit(page), "Studios")) == "S"
    assert extract.biography('Age: 5<br>Prose<br/>Power: <span class="spoiler">big</span>') == {"attributes": {"age": "5"}, "spoilers": {"power": "big"}, "description": "Prose", "description_spoiler": None}
    info = value(spark, extract.episode_title_info(F.lit("#12 - The End Filler"), F.lit("Owari (終)")))
    assert info == {"title": "The End", "romaji": "Owari", "japanese": "終", "filler": True, "recap": False}
    xml = spark.createDataFrame([('<anime id="1"><episodecount>3</episodecount><titles><title type="main">M</title><title type="official" xml:lang="en">E</title></titles></anime>',), ("<anime",)], "xml string")
    assert [(r["title"], r["title_english"], r["episode_count"]) for r in extract.anime_from_xml(xml).collect()] == [("M", "E", 3), (None, None, None)]


def test_mappers_take_what_is_there(spark):
    for mapper in mappers.MAPPERS.values():
        assert mapper(spark.createDataFrame([(1,)], "id int")).count() == 1
    ep = spark.createDataFrame([({"number": 3, "titles": None},)], "attributes struct<number:int,titles:struct<en_us:string>>")
    assert mappers.kitsu_episode(ep).first()["title"] == "Episode 3"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"t": "x"}, {"t": "y"}]}')
    (tmp_path / "b.json").write_text('[{"t": "z"}]')
    (tmp_path / "c.json").write_text('{"t": "w"}')
    assert [r["t"] for r in files.read_database(spark, str(tmp_path / "a.json"), "t string").collect()] == ["x", "y"]
    assert [[r["t"] for r in files.read_stage(spark, str(tmp_path / f), "t string").collect()] for f in ("a.json", "b.json", "c.json")] == [["x", "y"], ["z"], ["w"]]
    assert files.read_lenient(spark, str(tmp_path / "none.json"), "t string").count() == 0
    df = spark.createDataFrame([("One", 0), ("one", 1), ("Other", 2)], "title string, pos int")
    assert files.by_title(df, "ONE", "pos").first()["pos"] == 0 and files.by_title(df, "oth", "pos").first()["pos"] == 2 and files.by_title(df, "o", "pos").count() == 0
    with pytest.raises(files.Ambiguous):
        files.by_title(df, "one", "pos", strict=True)
    assert files.services(["a", "b"], skip=["b"]) == ["a"]
    assert files.numbered(spark.range(50).select((F.col("id") * 2).alias("k")), "k").filter("pos * 2 <> k").count() == 0


def test_points_and_encoders(spark):
    r = spark.createDataFrame([("a1", "T", [("c1", "N")], [(3, "E", True)])], "id string, title string, c array<struct<id:string,name:string>>, e array<struct<n:int,t:string,f:boolean>>")
    full = spark.createDataFrame([], assembly.SCHEMA).unionByName(
        r.select("id", "title", F.transform("c", lambda c: F.from_json(F.to_json(c), assembly.CHARACTER)).alias("characters"), F.transform("e", lambda e: F.from_json(F.to_json(F.struct(e["n"].alias("episode_number"), e["t"].alias("title"), e["f"].alias("filler"))), assembly.EPISODE)).alias("episodes")),
        allowMissingColumns=True,
    )
    got = {p["entity_type"]: p["text"] for p in assembly.points(full).collect()}
    assert got == {"anime": "Title: T", "character": "Name: N", "episode": "Episode 3 | E (Filler)"}
    e = encode_column(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, t string"), "t", "v", HashingEncoder, 64)
    assert [any(r["v"]) for r in e.orderBy("id").collect()] == [True, False, False]


def test_model_factories(spark):
    from catalith.functions import models

    assert models.create_pair_model("overlap").score([("a b", "b c"), ("", "x")]) == [0.5, 0.0]
    for make in (models.create_encoder, models.create_image_encoder, models.create_pair_model):
        with pytest.raises(ValueError):
            make("nobody's")
    with pytest.raises(RuntimeError, match="needs the library"):
        models.create_encoder("onnx", model="m", dim=8).encode(["x"])
    images = spark.createDataFrame([(1, [bytearray(b"abc"), bytearray(b"")]), (2, None), (3, [bytearray(b"abc"), bytearray(b"xyz")])], "id int, images array<binary>")
    got = {r["id"]: r["v"] for r in models.encode_images(images, "images", "v", lambda: models.create_image_encoder("hashing", dim=16)).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [1, 0, 2] and got[1][0] == got[3][0] and abs(sum(x * x for x in got[3][1]) - 1) < 1e-9


def test_language_groups_name_forms_hashes_and_reindexing(spark, tmp_path):
    from catalith.functions import numbers
    from catalith.operators import dedup, relations, tables
    from catalith.streaming import state

    df = spark.createDataFrame([(["One", "いち", "one ", "Two", "?!"], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.99, 0.01], None])], "v array<string>, x array<array<double>>")
    assert dedup.distinct_by_meaning(df, "v", "x", 0.85, dedup.script_language).first()["v"] == ["One", "いち", "?!"]
    assert dedup.distinct_by_meaning(df, "v", "x").first()["v"] == ["One", "?!"]
    forms = value(spark, text.name_forms_of(F.lit("サクラ")))
    assert forms["script"] == "japanese" and forms["japanese"]["hiragana"] == "さくら" and forms["japanese"]["romaji"] == "sakura" and forms["english"] is None
    assert value(spark, text.name_forms_of(F.lit("Ann Lee")))["english"]["last_first"] == "Lee Ann"
    assert len(numbers.source_hash(dedup.keep_last)) == 16 and numbers.source_hash(dedup.keep_last) != numbers.source_hash(dedup.keep_last, dedup.script_language)
    assert [r[0] for r in state.cacheable(spark.createDataFrame([(200,), (404,), (None,)], "status_code int")).collect()] == [200]
    assert relations.from_anidb(spark.createDataFrame([(1,)], "anime_id int")).collect() == []
    c = tables.Collection(spark, str(tmp_path / "again"))
    c.create("id string, v int", {})
    c.add(spark.createDataFrame([("old", 1)], "id string, v int"))
    old = c.read()
    records = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, n int")
    result = tables.reindex(records, c, lambda r: r.select("id", (F.col("n") * 10).alias("v")), F.col("id").isNotNull())
    assert (result.total, result.successful, result.failed) == (3, 2, 1) and sorted(map(tuple, c.read().collect())) == [("a", 10), ("b", 20)]
    assert [tuple(r) for r in old.collect()] == [("old", 1)]  # who still reads the version before finds it whole
    with pytest.raises(ValueError, match="repeat a key"):
        c.add(spark.createDataFrame([("a", 1), ("a", 2)], "id string, v int"))


def test_hot_keys_are_split_by_time_without_a_change(spark):
    import random as rnd

    from catalith.operators import joins
    from catalith.streaming import state

    rng = rnd.Random(5)
    rows = [(i, rng.choice("ab"), rng.randint(0, 4000), rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, s long, v int").withColumn("ts", F.timestamp_seconds("s"))
    fine, whole = ({r["id"]: r["in_window"] for r in state.within_rate(df, "k", "ts", 5, 60, stretch).collect()} for stretch in (100, 10**9))
    assert fine == whole == {i: sum(k2 == k and s - 60 <= s2 <= s for _, k2, s2, _ in rows) for i, k, s, _ in rows}
    left, right = df.filter("id % 2 = 0").select("id", "k", "ts"), df.filter("id % 2 = 1").select("k", F.col("ts").alias("r"), "v", "id").groupBy("k", "r").agg(F.max("v").alias("v"))
    got, want = ({r["id"]: r["v"] for r in joins.as_of(left, right, "k", "ts", "r", ["v"], stretch).collect()} for stretch in (50, 10**9))
    assert got == want and len(got) == 150 and sum(v is not None for v in got.values()) > 100
