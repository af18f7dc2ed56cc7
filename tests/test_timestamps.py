import datetime as dt
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalith.operators.timestamps import best_path, interpretations, normalise_timestamps, states, step_cost

TOKYO, BERLIN, NEW_YORK = "Asia/Tokyo", "Europe/Berlin", "America/New_York"


@pytest.mark.parametrize(
    ("text", "zone", "order", "norm"),
    [
        ("2016-W35-6", BERLIN, "dmy", "2016-09-03"),
        ("Feb 27, 2014, 6:33 PM", NEW_YORK, "mdy", "2014-02-27T23:33:00.000Z"),
        ("1366692437", TOKYO, "mdy", "2013-04-23T04:47:17.000Z"),
        ("1553991642173", "UTC", "ymd", "2019-03-31T00:20:42.173Z"),
        ("2021-10-15T10:41:03+0900", TOKYO, "ymd", "2021-10-15T01:41:03.000Z"),
        ("2016-03-22 19:28:50,927", "UTC", "ymd", "2016-03-22T19:28:50.927Z"),
        ("2021-10-20T17:22:59.499940Z", "UTC", "ymd", "2021-10-20T17:22:59.499Z"),
        ("16. März 2015", BERLIN, "dmy", "2015-03-16"),
        ("29. März 2013, 13:12 Uhr", BERLIN, "dmy", "2013-03-29T12:12:00.000Z"),
        ("12 août 2021 à 04h01", "Europe/Paris", "dmy", "2021-08-12T02:01:00.000Z"),
        ("13 ottobre 2010 ore 16.02", "Europe/Rome", "dmy", "2010-10-13T14:02:00.000Z"),
        ("2017年8月24日28時02分", TOKYO, "ymd", "2017-08-24T19:02:00.000Z"),
        ("２０１６/０８/０８ １３：０６", TOKYO, "ymd", "2016-08-08T04:06:00.000Z"),
        ("令和元年7月9日", TOKYO, "ymd", "2019-07-09"),
        ("2018年11月14日(水) 午後8時47分", TOKYO, "ymd", "2018-11-14T11:47:00.000Z"),
        ("2012-01-10T07:42:42+01:00[Europe/Paris]", "UTC", "ymd", "2012-01-10T06:42:42.000Z"),
        ("2019-09-07 15:02 Australia/Sydney", "UTC", "ymd", "2019-09-07T05:02:00.000Z"),
        ("2022-03-13 04:39 America/Los_Angeles", NEW_YORK, "mdy", "2022-03-13T11:39:00.000Z"),
        ("Apr 2, 2017 1:59 AM AEDT", "Australia/Sydney", "dmy", "2017-04-01T14:59:00.000Z"),
        ("31 Oct 2018 12:34 UTC+9", TOKYO, "ymd", "2018-10-31T03:34:00.000Z"),
        ("Thu, 28 Jul 2016 05:06:59 GMT", "UTC", "ymd", "2016-07-28T05:06:59.000Z"),
        ("10/11/2012", NEW_YORK, "mdy", "2012-10-11"),
        ("10/11/2012", BERLIN, "dmy", "2012-11-10"),
        ("  20120604\n", "UTC", "ymd", "2012-06-04"),
        ("Nov 14, 2023 at 1:30 a.m.", "UTC", "mdy", "2023-11-14T01:30:00.000Z"),
    ],
)
def test_cheapest_reading(text, zone, order, norm):
    assert interpretations(text, zone, order)[0][3] == norm


@pytest.mark.parametrize("text", [None, "", "   ", "TBA", "2013-07", "2019", "Spring 2024", "2011年春", "0000-00-00", "Feb 30, 2018", "2017-04-31T21:30:00+09:00", "12:30", "x" * 10_000, "13:00 PM 2020"])
def test_nothing_to_read(text):
    assert interpretations(text, "UTC", "ymd") == []


def test_local_times_that_did_not_exist_or_came_twice():
    assert interpretations("2021-03-28 02:14", BERLIN, "dmy")[0][3:] == (None, "gap")
    assert interpretations("2021-10-31 02:14", BERLIN, "dmy")[0][3:] == (None, "twice")
    assert interpretations("2021-10-31 02:14 CEST", BERLIN, "dmy")[0][3] == "2021-10-31T00:14:00.000Z"
    assert interpretations("2021-10-31 02:14", None, None)[0][4] == "no_zone"


def test_ambiguous_dates_keep_both_readings():
    assert [c[0] for c in interpretations("04/05/2012", "UTC", None)] == ["dmy", "mdy"]
    assert [(c[0], c[1] > 0) for c in interpretations("04/05/2012", "UTC", "mdy")] == [("mdy", False), ("dmy", True)]


candidates = st.lists(
    st.builds(lambda f, c, a: {"fmt": f, "cost": float(c), "at": a * 86_400_000}, st.sampled_from(["a", "dmy", "mdy"]), st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=2
)


def path_cost(path):
    return sum(s[4] for s in path) + sum(step_cost(a, b) for a, b in zip(path, path[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(candidates, min_size=1, max_size=5))
def test_path_is_the_best_of_all(rows):
    rows = [states(r) for r in rows]
    assert path_cost([r[k] for r, k in zip(rows, best_path(rows))]) == min(map(path_cost, itertools.product(*rows)))


SCHEMA = "row_id bigint, feed_id int, aired_raw string, release_date string, fetched_at timestamp, zone string, source string"


def test_distributed_path_equals_the_whole(spark):
    rng = random.Random(3)
    rows = [(i, 1 + (i % 3 == 0), f"{rng.randint(1, 14):02d}/{rng.randint(1, 14):02d}/{2000 + i // 40}", None, None, "clash", "clash") for i in range(400)]
    feeds = spark.createDataFrame([(1, "UTC", None), (2, "UTC", None)], "feed_id int, zone_name string, date_order string")
    got = {r["id"]: r["aired_norm"] for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), feeds).collect()}
    for feed in (1, 2):
        read = [(r[0], interpretations(r[2], "UTC", None)) for r in rows if r[1] == feed]
        read = [(i, [dict(zip(("fmt", "cost", "at", "norm", "status"), c)) for c in x]) for i, x in read if x]
        choices = [states(x) for _, x in read]
        want = [s[k] for s, k in zip(choices, best_path(choices))]
        have = [[s for s in c if x[s[0]]["norm"] == got[i]] for (i, x), c in zip(read, choices)]
        assert len(have) == len(want) and path_cost([h[k] for h, k in zip(have, best_path(have))]) == path_cost(want)


def test_records_outweigh_a_wrong_declaration(spark):
    """The feed writes the day first but declares the month first: texts that can be read one way only show it."""
    texts = ["25/12/2015", "04/05/2016", "2016-05-11 10:00", "17/05/2016", "06/07/2016", "30/07/2016", "05/08/2016"]
    rows = [(i, 1, t, None, dt.datetime(2020, 1, 1, i), None, None) for i, t in enumerate(texts)]
    for declared in ("mdy", "dmy", "ymd", None):
        feeds = spark.createDataFrame([(1, "UTC", declared)], "feed_id int, zone_name string, date_order string")
        got = {r["id"]: r["aired_norm"] for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), feeds).collect()}
        assert [got[i] for i in (1, 4, 6)] == ["2016-05-04", "2016-07-06", "2016-08-05"], declared
    ambiguous = [(1, 1, "04/05/2016", None, None, None, None)]
    feeds = spark.createDataFrame([(1, "UTC", "mdy")], "feed_id int, zone_name string, date_order string")
    assert normalise_timestamps(spark.createDataFrame(ambiguous, SCHEMA), feeds).first()["aired_norm"] == "2016-04-05"  # nothing speaks against it


def test_long_texts_are_read(spark):
    assert interpretations(" " * 300 + "2020-01-02" + " " * 300, "UTC", None)[0][3] == "2020-01-02"


def test_nulls_repeats_and_empty(spark):
    feeds = spark.createDataFrame([(1, "Asia/Tokyo", "ymd")], "feed_id int, zone_name string, date_order string")
    rows = [(1, 1, None, "2020-01-01 09:00", None, None, None), (1, 1, None, "2020-01-01 09:00", None, None, None), (2, None, "2020-01-02", None, None, None, None), (None, 1, "2020-01-03", None, None, None, None), (3, 9, "2020-01-01 09:00", None, None, None, None), (4, 1, None, None, None, None, None)]
    out = sorted((str(r["id"]), r["aired_norm"], r["status"]) for r in normalise_timestamps(spark.createDataFrame(rows, SCHEMA), feeds).collect())
    assert out == sorted([("1", "2020-01-01T00:00:00.000Z", "ok")] * 2 + [("2", "2020-01-02", "ok"), ("None", "2020-01-03", "ok"), ("3", None, "no_zone")], key=lambda r: (r[0], str(r[1])))
    assert normalise_timestamps(spark.createDataFrame([], SCHEMA), feeds).collect() == []
