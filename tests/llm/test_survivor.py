from pyspark.sql import functions as F

from catalith.llm.survivor import fuse

SCHEMA = "record_id bigint, anime_key bigint, feed_id int, synopsis string, episodes array<struct<episode_number:int,title:string,aired:string>>, status string, updated_at timestamp, source string, rank string"


def test_rules_and_damage(spark):
    feeds = spark.createDataFrame([(1, 5), (2, 3), (3, 1)], "feed_id int, trust int")
    full = "One thing happens. Another follows it. Then all ends well."
    eps = lambda *titles: [(i + 1, t, None) for i, t in enumerate(titles)]
    rows = [
        (1, 7, 1, "One thing happens.", eps("A", "TBA"), "ONGOING", "2024-05-01 00:00:00"),
        (2, 7, 2, full, eps("A", "B"), "current", "2024-05-02 00:00:00"),
        (3, 7, 3, full + " " + full, eps("A", "A", "A", "Episode 4"), "FINISHED", "2024-05-02 00:00:00"),
        (4, 7, 1, full[:-8] + "…", None, "UNKNOWN", "2025-01-01 00:00:00"),
        (5, 7, 2, "<p>" + full + "</p>", [], "geplant", "2098-01-01 00:00:00"),
        (6, 7, None, "TBA", None, None, None),
        (7, 7, 3, "Onâ€™ thing. " + full + " And mÃ© more and more of it.", None, "?", None),
        (8, 8, 1, full, eps("X"), "FINISHED", None),
        (9, None, 1, full, eps("X"), "FINISHED", None),
        (10, 9, 1, None, None, "n/a", None), (11, 9, 2, "", [], "", None),
        (12, 10, 2, "Same text here.", eps("Q"), "FINISHED", "2020-01-01 00:00:00"), (12, 10, 2, "Same text here.", eps("Q"), "FINISHED", "2020-01-01 00:00:00"),
    ]
    df = spark.createDataFrame([(*r[:6], None, "clash", "clash") for r in rows], SCHEMA)
    stamps = spark.createDataFrame([(r[0], r[6]) for r in rows], "record_id bigint, ts string").distinct()
    df = df.drop("updated_at").join(stamps, "record_id").withColumn("updated_at", F.to_timestamp("ts"))
    got = {(r["anime_key"], r["field_name"]): r["record_id"] for r in fuse(df, feeds).collect()}
    assert got == {(7, "synopsis"): 2, (7, "episodes"): 2, (7, "status"): 2, (10, "synopsis"): 12, (10, "episodes"): 12, (10, "status"): 12}
    assert fuse(df.limit(0), feeds).count() == 0


def test_votes_decide_among_equals_and_copies_count_less(spark):
    feeds = spark.createDataFrame([(i, 1) for i in range(1, 6)], "feed_id int, trust int")
    rows = []
    for k in range(40):  # feeds 4 and 5 copy each other's mistakes, 1 to 3 are independent and right
        for f in range(1, 6):
            right = f < 4 and not (f == 1 + k % 3 and k % 4 == 0)
            text = "A true tale" if right else "A fake tale" if f > 3 else f"A slip {f} in"  # of one length: no text is more complete
            rows.append((k * 10 + f, k, f, f"{text} {k:02d}.", None))
    df = spark.createDataFrame(rows, "record_id bigint, anime_key bigint, feed_id int, synopsis string, status string").withColumns({"updated_at": F.lit(None).cast("timestamp"), "episodes": F.lit(None).cast("array<struct<episode_number:int,title:string,aired:string>>")})
    got = fuse(df, feeds).filter("field_name = 'synopsis'").collect()
    assert len(got) == 40 and sum(r["record_id"] % 10 < 4 for r in got) >= 38


def _statuses(spark, claims):
    """Records of (group, feed, status, day)."""
    rows = [(k, g, f, status, f"2020-01-{day:02d} 00:00:00") for k, (g, f, status, day) in enumerate(claims)]
    df = spark.createDataFrame(rows, "record_id bigint, anime_key bigint, feed_id int, status string, ts string")
    return df.withColumns({"updated_at": F.to_timestamp("ts"), "synopsis": F.lit(None).cast("string"), "episodes": F.lit(None).cast("array<struct<episode_number:int,title:string,aired:string>>")}).drop("ts")


def test_votes_outweigh_recency_and_copied_votes_do_not(spark):
    """Feed 9 always comes last with a status nobody else has; feeds 1 to 4 agree, once as independent ones, once as copies."""
    feeds = spark.createDataFrame([(i, 1) for i in range(1, 10)], "feed_id int, trust int")

    def survivors(copying, **parts):
        claims = []
        for g in range(60):  # what the four say elsewhere: copies share the same mistakes, independent feeds make their own
            for f in range(1, 5):
                wrong = g % 2 == 0 if copying else g % 6 == f
                claims.append((g, f, ("HIATUS" if copying else ("HIATUS", "CANCELLED", "ONGOING", "UPCOMING")[f - 1]) if wrong else "FINISHED", 1))
            claims += [(g, f, "FINISHED", 3) for f in (5, 6, 7)]
        for g in range(100, 112):
            claims += [(g, f, "FINISHED", 2) for f in range(1, 5)] + [(g, 9, "UPCOMING", 20)]
        got = fuse(_statuses(spark, claims), feeds, **parts).filter("anime_key >= 100 and field_name = 'status'").collect()
        return {claims[r["record_id"]][2] for r in got}

    assert survivors(copying=False) == {"FINISHED"}  # recency alone would keep feed 9's
    assert survivors(copying=True) == {"UPCOMING"}  # four copies are hardly more than one vote
    assert survivors(copying=True, copies=False) == {"FINISHED"}  # taken as independent they would win
