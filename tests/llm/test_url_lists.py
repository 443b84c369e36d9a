import datetime as dt

import pytest
from pyspark.sql import functions as F

from nearkin.llm.url_lists import judge_captures, list_intervals, op2_url_lists, url_patterns

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize(
    ("url", "patterns"),
    [
        ("https://User@A.B.org:8/x/y?q#f", ["a.b.org", "a.b.org/x", "a.b.org/x/y", "b.org", "b.org/x", "b.org/x/y"]),
        ("http://b.org", ["b.org"]),
        ("http://b.org./", ["b.org"]),
        ("ftp://localhost/x", None),
        ("http://[2001:DB8::1]:80/x", ["[2001:db8::1]", "[2001:db8::1]/x"]),
        ("no url", None),
        ("", None),
        (None, None),
    ],
)
def test_patterns(spark, url, patterns):
    df = spark.createDataFrame([(url,)], "u string").select(url_patterns(F.col("u")).alias("p"))
    assert df.first().p == patterns or (patterns is None and not df.first().p)


def entries(spark, rows):
    return spark.createDataFrame(rows, "list string, pattern string, action string, day date")


def test_intervals(spark):
    rows = [("l", "B.org/", "add", day(1)), ("l", "b.org", "add", day(1)), ("l", "b.org", "remove", day(5)),
            ("l", "b.org", "add", day(5)), ("l", "b.org", "remove", day(9)), ("l", "b.org", "odd", day(9)),
            (None, "b.org", "add", day(1)), ("l", None, "add", day(1)), ("l", "b.org", None, day(1)),
            ("l", "b.org", "add", None), ("m", "c.org", "remove", day(2)), ("m", "c.org", "add", day(3))]
    got = sorted(tuple(r) for r in list_intervals(entries(spark, rows)).collect())
    end = dt.date(9999, 12, 31)
    assert got == [("l", "b.org", day(1), day(5)), ("l", "b.org", day(5), day(9)), ("m", "c.org", day(3), end)]


def test_verdicts_are_those_of_the_day(spark):
    log = entries(spark, [("l", "b.org", "add", day(1)), ("l", "b.org", "remove", day(5)), ("m", "b.org/x", "add", day(3))])
    rows = [(1, "http://a.b.org/x/y", day(0)), (2, "http://a.b.org/x/y", day(1)), (3, "http://a.b.org/x/y", day(4)),
            (4, "http://a.b.org/x/y", day(5)), (4, "http://a.b.org/x/y", day(5)), (5, "http://ab.org/x", day(4)),
            (6, None, day(4)), (7, "http://b.org/", None), (8, "http://b.org/xy", day(9))]
    captures = spark.createDataFrame(rows, "id long, url string, fetched_on date").withColumn("lists", F.lit(1))
    got = sorted((r.id, r.blocked, r.n_matches, r.pattern, r.lists) for r in judge_captures(captures, log).collect())
    no = (False, 0, None, None)
    assert got == [(1, *no), (2, True, 1, "b.org", "l"), (3, True, 2, "b.org/x", "l,m"), (4, True, 1, "b.org/x", "m"),
                   (4, True, 1, "b.org/x", "m"), (5, *no), (6, *no), (7, *no), (8, *no)]
    assert judge_captures(captures, log.limit(0)).where("blocked").count() == 0
    assert judge_captures(captures.limit(0), log).count() == 0


def test_some_are_blocked_in_the_query(spark):
    judged = op2_url_lists(spark, "/root/testdata/sf0.001")
    counts = {r.blocked: r["count"] for r in judged.groupBy("blocked").count().collect()}
    assert counts[True] and counts[False]


def test_paths_keep_their_case_and_hosts_do_not(spark):
    entries = spark.createDataFrame(
        [("l", "Example.ORG/Docs/", "add", DAY), ("l", "B.org", "add", DAY)],
        "list string, pattern string, action string, day date",
    )
    urls = ["http://example.org/Docs/x", "http://EXAMPLE.org/docs/x", "https://a.b.ORG/Z", "http://example.org"]
    captures = spark.createDataFrame([(u, DAY) for u in urls], "url string, fetched_on date")
    for name in ("_url", "_day", "capture_url", "key", "day"):
        captures = captures.withColumn(name, F.lit(7))
    judged = judge_captures(captures, entries)
    assert judged.columns == [*captures.columns, "blocked", "n_matches", "pattern", "lists"]
    assert {r.url: r.blocked for r in judged.collect()} == dict(zip(urls, [True, False, True, False]))
    assert {r._url for r in judged.collect()} == {7}


def test_a_very_long_url_has_as_many_patterns_as_the_list_has_depths(spark):
    url = "http://a.b.org/" + "/".join(f"segment{i}" for i in range(1_500))
    df = spark.createDataFrame([(url,)], "u string")
    few = df.select(url_patterns(F.col("u"), [0, 1, 2_000]).alias("p")).first().p
    assert few == ["a.b.org", "a.b.org/segment0", "b.org", "b.org/segment0"]
    entries = spark.createDataFrame(
        [("l", "b.org/segment0/segment1", "add", DAY)], "list string, pattern string, action string, day date"
    )
    captures = spark.createDataFrame([(url, DAY)], "url string, fetched_on date")
    assert judge_captures(captures, entries).first().pattern == "b.org/segment0/segment1"
    assert judge_captures(captures, entries.where("1 = 0")).first().blocked is False
