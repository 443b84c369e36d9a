"""URL filters by dated lists: every capture is judged by the list of its own day.

A list is a log of dated entries: from this day a pattern is on it, from that day
it is off. Entries become validity intervals, one after the other for each
pattern, and a capture is blocked where an interval of one of its patterns holds
the day it was fetched. The patterns of a capture are its host and all parents of
the host, each alone and with every beginning of the path.

Captures are pre-aggregated twice, to their distinct URLs and days and then to
their distinct patterns and days, before they meet the intervals. A pattern has at
most one state a day, so neither side of that join has more rows for a pattern
than the calendar has days, however hot a host is. Everything is a column
expression or a join on equal keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearkin.llm.common import read, unused
from nearkin.sources.storage import durable

ADD, REMOVE = "add", "remove"
#: Labels of the longest host name there can be.
MAX_LABELS = 127
_END = "9999-12-31"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def url_patterns(url: Column, depths: list[int] | None = None) -> Column:
    """Patterns that would list a URL: ``b.org``, ``a.b.org``, ``a.b.org/x/y``, ...

    A host has two labels at least and ``MAX_LABELS`` at most, or is an address in
    brackets as a whole; a beginning of a path ends with a whole segment. With
    ``depths`` only beginnings of so many segments are told, so that a very long path
    has few. Null and unreadable URLs have no patterns.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(
        F.when((n >= 2) & (n <= MAX_LABELS), F.sequence(F.lit(1), n - 1)),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    hosts = F.when(host.startswith("["), F.array(host)).otherwise(parents)
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    if depths is None:
        wanted = F.sequence(F.lit(0), F.size(segments))
    else:
        known = F.array(*[F.lit(d) for d in depths]).cast("array<int>")
        wanted = F.filter(known, lambda d: d <= F.size(segments))
    paths = F.transform(wanted, lambda i: F.concat_ws("/", F.lit(""), F.slice(segments, 1, i)))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.array_distinct(both)


def list_intervals(entries: DataFrame) -> DataFrame:
    """``list, pattern, valid_from, valid_to`` of a log ``list, pattern, action, day``.

    ``valid_to`` is the first day it holds no more. Of entries for a pattern on
    one day an ``add`` wins. Entries with a null, or another action than ``add``
    and ``remove``, say nothing; patterns lose closing slashes and dots, and upper case
    in the host alone, as paths are told apart by it. Repeated entries change nothing.
    """
    host = F.substring_index("pattern", "/", 1)
    rest = F.substring(F.col("pattern"), F.length(host) + 1, F.length("pattern"))
    pattern = F.rtrim(F.concat(F.lower(host), rest), F.lit("/."))
    said = entries.select(
        "list", pattern.alias("pattern"), "action", F.col("day").cast("date").alias("day")
    ).where(F.col("action").isin(ADD, REMOVE))
    said = said.dropna(subset=["list", "pattern", "day"])
    # a state for each day at most, so the window below holds no more rows than days
    states = said.groupBy("list", "pattern", "day").agg(
        F.bool_or(F.col("action") == ADD).alias("on")
    )
    then = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    until = F.coalesce(then, F.lit(_END).cast("date"))
    listed = states.withColumn("valid_to", until).where("on")
    return listed.select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def judge_captures(
    captures: DataFrame,
    entries: DataFrame,
    *,
    url_col: str = "url",
    day_col: str = "fetched_on",
) -> DataFrame:
    """All columns of ``captures`` and ``blocked, n_matches, pattern, lists``.

    ``n_matches`` counts the pairs of a list and a pattern that hold, ``pattern``
    is the longest of these patterns and of equal lengths the first, ``lists`` the
    names of the lists in order with commas between. A capture without URL or day
    is not blocked. Columns of ``captures`` with those names are replaced.
    """
    names = ("blocked", "n_matches", "pattern", "lists")
    captures = captures.drop(*names)
    day = F.col(day_col).cast("date")
    seen = captures.select(F.col(url_col).alias("url"), day.alias("on_day")).distinct()
    intervals = durable(list_intervals(entries).withColumnRenamed("pattern", "key"), "intervals")
    # one number for each depth of path that the lists have
    segments = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    depths = intervals.agg(F.sort_array(F.collect_set(segments))).first()[0]
    patterns = url_patterns(F.col("url"), depths)
    keyed = seen.select("url", "on_day", F.explode(patterns).alias("key"))
    asked = keyed.select("key", "on_day").distinct()
    active = asked.join(intervals, "key").where("on_day >= valid_from AND on_day < valid_to")
    active = durable(active.select("key", "on_day", "list"), "active")
    matched = keyed.join(active, ["key", "on_day"])
    verdicts = matched.groupBy("url", "on_day").agg(
        F.count("*").alias("n_matches"),
        F.min(F.struct((-F.length("key")).alias("n"), "key"))["key"].alias("pattern"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
    )
    own = [unused(captures, c) for c in ("capture_url", "capture_day")]
    verdicts = durable(verdicts.withColumnsRenamed(dict(zip(("url", "on_day"), own, strict=True))), "verdicts")
    same = (F.col(url_col) == F.col(own[0])) & (day == F.col(own[1]))
    judged = captures.join(verdicts, same, "left").drop(*own)
    return judged.select(
        *captures.columns,
        F.col("n_matches").isNotNull().alias("blocked"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        "pattern",
        "lists",
    )


def _derived_entries(pages: DataFrame) -> DataFrame:
    """A log derived from the pages themselves: hosts and sections by their hash."""
    host = url_host(F.col("url"))
    section = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)", 1)
    whole = pages.select(F.lit("hosts").alias("list"), host.alias("pattern"))
    part = pages.select(F.lit("sections").alias("list"), F.concat_ws("/", host, section).alias("pattern"))
    known = whole.union(part).where("pattern != ''").distinct()
    x = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    first = x % 900
    events = F.array(
        F.struct(F.lit(ADD).alias("action"), first.alias("n")),
        F.struct(F.lit(REMOVE).alias("action"), (first + 1 + x % 331).alias("n")),
        F.struct(
            F.when(x % 2 == 0, ADD).otherwise(REMOVE).alias("action"), (first + 400).alias("n")
        ),
    )
    listed = known.where(x % 3 != 0).select("list", "pattern", F.explode(events).alias("e"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("e.n"))
    return listed.select("list", "pattern", "e.action", day.alias("day"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures on days told by their ids, lists derived from their hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 7919 % 1461).cast("int"))
    captures = pages.withColumn("fetched_on", day)
    judged = judge_captures(captures, _derived_entries(pages))
    return judged.withColumn("fetched_on", F.col("fetched_on").cast("string"))


OP2_SQL = r"""
WITH pg AS (
  SELECT page_id, url,
    DATE '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), known AS (
  SELECT DISTINCT 'hosts' AS list, host AS pattern FROM pg WHERE host <> ''
  UNION
  SELECT DISTINCT 'sections', concat_ws('/', host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1)) FROM pg
), hashed AS (
  SELECT list, pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS x FROM known WHERE pattern <> ''
), said AS (
  SELECT list, rtrim(lower(pattern), '/.') AS pattern, act, DATE '2020-01-01' + CAST(n AS INTEGER) AS day FROM (
    SELECT list, pattern, 'add' AS act, x % 900 AS n FROM hashed WHERE x % 3 <> 0
    UNION ALL SELECT list, pattern, 'remove', x % 900 + 1 + x % 331 FROM hashed WHERE x % 3 <> 0
    UNION ALL SELECT list, pattern, CASE WHEN x % 2 = 0 THEN 'add' ELSE 'remove' END, x % 900 + 400
      FROM hashed WHERE x % 3 <> 0)
), states AS (
  SELECT list, pattern, day, bool_or(act = 'add') AS is_on FROM said GROUP BY ALL
), spans AS (
  SELECT list, pattern, day AS a,
    coalesce(lead(day) OVER (PARTITION BY list, pattern ORDER BY day), DATE '9999-12-31') AS b, is_on
  FROM states
), hosts AS (
  SELECT page_id, url, fetched_on, path,
    unnest(list_transform(range(1, len(string_split(host, '.'))),
      lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS h
  FROM pg
), segs AS (
  SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS sg FROM hosts
), keyed AS (
  SELECT DISTINCT page_id, url, fetched_on,
    h || CASE WHEN i = 0 THEN '' ELSE '/' || array_to_string(sg[1:i], '/') END AS k
  FROM (SELECT *, unnest(range(0, len(sg) + 1)) AS i FROM segs)
), found AS (
  SELECT page_id, count(*) AS n, min(struct_pack(l := -length(k), k := k)).k AS pattern,
    array_to_string(list_sort(list_distinct(list(list))), ',') AS lists
  FROM keyed JOIN spans ON k = pattern AND is_on AND fetched_on >= a AND fetched_on < b
  GROUP BY page_id
)
SELECT pg.page_id, pg.url, strftime(pg.fetched_on, '%Y-%m-%d') AS fetched_on, n IS NOT NULL AS blocked,
  coalesce(n, 0) AS n_matches, pattern, lists
FROM pg LEFT JOIN found USING (page_id)
"""
