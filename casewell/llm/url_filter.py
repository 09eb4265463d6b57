"""URL filter: dated list entries as validity intervals, as-of joined to captures.

The lists are a log of dated changes: a rule (a host, a parent domain or a host with a path
prefix) is added to a list or removed from it. Each change holds from its time to the next change
of the same rule on the same list. Every capture is judged by the entries that are active at its
own fetch time: its host, each parent domain and each path prefix are looked up by an equi join,
with the interval test behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(changes: DataFrame) -> DataFrame:
    """(list, rule, from, to) while a rule is on a list; `to` is excluded and null if open.

    `changes`: list, rule, at, added. Of changes of one rule at one time the removal counts.
    Rows with a null in any of these are left out; repeated adds run on, repeated removals and
    removals of what is not there change nothing.
    """
    known = changes.select("list", "rule", "at", "added").dropna()
    last = known.groupBy("list", "rule", "at").agg(F.min("added").alias("added"))
    ahead = F.lead("at").over(Window.partitionBy("list", "rule").orderBy("at"))
    return last.withColumn("to", ahead).filter("added").select("list", "rule", F.col("at").alias("from"), "to")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a final dot; null without a scheme."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def lookup_rules(url: Column) -> Column:
    """All rules that could name a URL: host and parent domains (`a.b.c`, `b.c`, `c`), and the
    host with each path prefix that ends at a slash or at the path's end."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    parts = F.split(F.regexp_replace(path_of(url), "^/|/$", ""), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"))
    )
    return F.array_distinct(F.concat(domains, prefixes))


def url_verdicts(captures: DataFrame, changes: DataFrame, key: str, url: str, fetched: str) -> DataFrame:
    """One row per capture row: `key`, `lists` that name it at its fetch time (sorted, distinct),
    and `kept`.

    Captures with a null URL, without a host or without a fetch time are on no list and kept.
    Rows with the same key, URL and time are judged as one and stay repeated. The join's hot
    rules are split by AQE; a rule's own history is narrow.
    """
    own = captures.select(captures[key].alias("_key"), captures[url].alias("_url"), captures[fetched].alias("_at"))
    usable = own.filter(host_of(F.col("_url")).isNotNull() & F.col("_at").isNotNull()).distinct()
    asked = usable.select("_url", "_at").distinct().select("_url", "_at", F.explode(lookup_rules(F.col("_url"))).alias("rule"))
    active = asked.join(intervals(changes), "rule").filter("`from` <= _at AND (`to` IS NULL OR _at < `to`)")
    named = active.groupBy("_url", "_at").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    joined = own.join(named, ["_url", "_at"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    return joined.select(F.col("_key").alias(key), lists.alias("lists"), (F.size(lists) == 0).alias("kept"))


# The given tables hold no fetch times and no lists. Both are derived from the pages: a page is
# fetched on the day of the year that its number gives, and every host's digest says whether its
# host, its parent domain or its first path part are listed, from which day and until when.
def captures_of(pages: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def changes_of(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    first = F.regexp_extract(path_of(F.col("url")), "^/([^/]*)", 1)
    rules = F.array(
        F.struct(F.lit("hosts").alias("list"), host.alias("rule")),
        F.struct(F.lit("domains").alias("list"), F.regexp_replace(host, r"^[^.]*\.", "").alias("rule")),
        F.struct(F.lit("paths").alias("list"), F.concat(host, F.lit("/"), first).alias("rule")),
    )
    named = pages.filter(host.isNotNull()).select(F.explode(rules).alias("r")).select("r.*").distinct()
    digit = lambda i: F.conv(F.substring(F.md5(F.concat("list", F.lit("|"), "rule")), i, 2), 16, 10).cast("int")
    start = F.date_add(F.lit("2024-01-01").cast("date"), digit(1))
    listed = named.filter(digit(5) < 64)
    added = listed.select("list", "rule", start.alias("at"), F.lit(True).alias("added"))
    removed = listed.filter(digit(7) < 128).select(
        "list", "rule", F.date_add(start, 1 + digit(3)).alias("at"), F.lit(False).alias("added")
    )
    return added.unionByName(removed)


ORACLE = r"""
WITH p AS (
    SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
        nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules AS (
    SELECT 'hosts' AS list, host AS rule FROM p WHERE host IS NOT NULL
    UNION SELECT 'domains', regexp_replace(host, '^[^.]*\.', '') FROM p WHERE host IS NOT NULL
    UNION SELECT 'paths', host || '/' || regexp_extract(path, '^/([^/]*)', 1) FROM p WHERE host IS NOT NULL
), digits AS (
    SELECT list, rule, ('0x' || substr(md5(list || '|' || rule), 1, 2))::INT AS a,
        ('0x' || substr(md5(list || '|' || rule), 3, 2))::INT AS b,
        ('0x' || substr(md5(list || '|' || rule), 5, 2))::INT AS c,
        ('0x' || substr(md5(list || '|' || rule), 7, 2))::INT AS d
    FROM rules
), spans AS (
    SELECT list, rule, DATE '2024-01-01' + a AS since,
        CASE WHEN d < 128 THEN DATE '2024-01-01' + a + 1 + b END AS until
    FROM digits WHERE c < 64
), hits AS (
    SELECT p.page_id, s.list
    FROM p JOIN spans s ON s.since <= p.fetched AND (s.until IS NULL OR p.fetched < s.until) AND (
        p.host = s.rule OR ends_with(p.host, '.' || s.rule)
        OR p.host || '/' || regexp_replace(regexp_replace(p.path, '^/', ''), '/$', '') = s.rule
        OR starts_with(p.host || '/' || regexp_replace(regexp_replace(p.path, '^/', ''), '/$', ''), s.rule || '/') AND contains(s.rule, '/'))
)
SELECT p.page_id, coalesce(string_agg(DISTINCT h.list, ',' ORDER BY h.list), '') AS lists, count(h.list) = 0 AS kept
FROM p LEFT JOIN hits h USING (page_id) GROUP BY p.page_id
"""


def url_filter(pages: DataFrame) -> DataFrame:
    """`url_verdicts` of the pages' captures, the lists joined by commas."""
    found = url_verdicts(captures_of(pages), changes_of(pages), "page_id", "url", "fetched")
    return found.select("page_id", F.array_join("lists", ",").alias("lists"), "kept")
