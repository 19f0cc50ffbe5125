"""Temporal URL lists: dated entries become validity intervals, captures are
evaluated against the entries active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

#: Listed hosts of fewer bytes go to every executor; more of them are joined over salts.
BROADCAST_BYTES = 32 << 20
SALTS = 16


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"(:[0-9]*)?$", "")
    return F.nullif(F.regexp_replace(name, r"\.$", ""), F.lit(""))


def parent(name: Column, labels: int) -> Column:
    """The last ``labels`` labels of a longer host, else null."""
    return F.when(F.size(F.split(name, r"\.")) > labels, F.substring_index(name, ".", -labels))


def suffixes(name: Column) -> Column:
    """A host and all of its parent domains, the longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(labels), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(labels, -k, k), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(domain, action, listed_at)`` to ``(domain, action, valid_from, valid_to)``.

    An entry holds until the next later one of its domain with another action, the
    last one for ever.  Of entries of one moment the action that sorts first holds
    (allow, block, remove).  Rows without domain, action or date are no entries;
    domains are compared in lower case.
    """
    own = entries.filter("domain is not null and action is not null and listed_at is not null")
    dated = own.groupBy(F.lower("domain").alias("domain"), "listed_at").agg(F.min("action").alias("action"))
    order = Window.partitionBy("domain").orderBy("listed_at")
    changes = dated.withColumn("before", F.lag("action").over(order)).filter("before is null or before <> action")
    return changes.select("domain", "action", F.col("listed_at").alias("valid_from"), F.lead("listed_at").over(order).alias("valid_to"))


def _listed(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """For each distinct host with a listed domain those domains, the most specific
    first, each with its intervals: a capture meets one row at most."""
    interval = F.struct("valid_from", "valid_to", "action")
    history = intervals(entries).filter("action <> 'remove'").groupBy("domain").agg(F.sort_array(F.collect_list(interval)).alias("history"))
    named = hosts.select(F.col("host").alias("_host"), F.posexplode(suffixes(F.col("host"))).alias("level", "domain"))
    return named.join(history, "domain").groupBy("_host").agg(F.sort_array(F.collect_list(F.struct("level", "domain", "history"))).alias("_lists"))


def _active(lists: Column, at: Column) -> Column:
    """The first of the domains that has an interval which holds ``at``, with its action; null if there is none."""
    held = F.transform(lists, lambda d: F.struct(d["domain"].alias("domain"), F.get(F.filter(d["history"], lambda i: (i["valid_from"] <= at) & (i["valid_to"].isNull() | (at < i["valid_to"]))), 0)["action"].alias("action")))
    return F.get(F.filter(held, lambda d: d["action"].isNotNull()), 0)


def evaluate(captures: DataFrame, entries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``captures(url, fetched_at, ...)`` with ``host, listed_domain, action, kept``.

    The most specific domain with an active entry decides: the whole host, then
    each of its parents down to its last label.  ``kept`` is false for block.  A
    null or malformed URL, or a null fetch time, matches nothing and is kept.
    Repeated captures give their own rows; no captures give no rows, and no entries
    keep everything.  Columns of captures that are called as one of the four go;
    the four take their place.

    The list is joined with the suffixes of the distinct hosts, and captures with
    the listed hosts, so nothing multiplies.  Few of these are broadcast, after
    their size is measured; more are joined on (host, salt), so a host with a third
    of all captures is dealt over tasks.
    """
    told = ["host", "listed_domain", "action", "kept"]
    own = captures.select(*(c for c in captures.columns if c.lower() not in told), host(F.col("url")).alias("host"))
    listed = save(_listed(own.filter("host is not null").select("host").distinct(), entries), "listed")
    size = listed.agg(F.sum(F.octet_length("_host") + F.aggregate("_lists", F.lit(0), lambda n, d: n + F.octet_length(d["domain"]) + 64 * F.size(d["history"])))).first()[0] or 0
    if size < broadcast_bytes:
        met = own.join(F.broadcast(listed), F.col("host") == F.col("_host"), "left")
    else:
        salted = listed.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = own.withColumn("_salt", F.pmod(F.xxhash64("url", "fetched_at"), F.lit(SALTS)).cast("int"))
        met = own.join(salted, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_salt_of")), "left")
    met = met.withColumn("_active", _active(F.col("_lists"), F.col("fetched_at")))
    action = F.col("_active")["action"]
    kept = [c for c in own.columns if c not in ("host", "_salt")]
    return met.select(*kept, "host", F.col("_active")["domain"].alias("listed_domain"), action.alias("action"), (~F.coalesce(action == "block", F.lit(False))).alias("kept"))


def demo_captures(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url)`` as captures: page n was fetched n hours, modulo a year, into 2024."""
    return pages.select("page_id", "url", F.timestamp_add("HOUR", F.pmod(F.col("page_id"), F.lit(8784)), F.lit("2024-01-01").cast("timestamp_ntz")).alias("fetched_at"))


#: What the demonstration list says of a domain, by the first hex digit of its MD5: actions and days into 2024.
FEED = {
    "0": [("block", 0)],
    "1": [("block", 30), ("remove", 200)],
    "2": [("block", 60), ("allow", 120), ("block", 300)],
    "3": [("allow", 0), ("block", 180)],
    "4": [("block", 90), ("remove", 90), ("block", 270)],
}


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the domains of ``pages``: hosts and their parents of two labels, by :data:`FEED`."""
    name = host(F.col("url"))
    domains = pages.select(F.explode(F.array(name, F.when(F.size(F.split(name, r"\.")) > 2, F.substring_index(name, ".", -2)))).alias("domain")).filter("domain is not null").distinct()
    digit = F.substring(F.md5(F.col("domain").cast("binary")), 1, 1)
    told = F.lit(None).cast("array<struct<action:string,day:int>>")
    for d, actions in FEED.items():
        told = F.when(digit == d, F.array(*(F.struct(F.lit(a).alias("action"), F.lit(k).alias("day")) for a, k in actions))).otherwise(told)
    rows = domains.select("domain", F.explode(told).alias("e"))
    return rows.select("domain", "e.action", F.timestamp_add("DAY", F.col("e.day"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("listed_at"))


_FEED_ROWS = ", ".join(f"('{d}', '{a}', {k})" for d, actions in FEED.items() for a, k in actions)
_LABELS = "string_split(host, '.')"
ORACLE = f"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(page_id % 8784) AS fetched_at,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), '(:[0-9]*)?$', ''), '\\.$', ''), '') AS host
  FROM pages
), d AS (
  SELECT DISTINCT domain FROM (
    SELECT host AS domain FROM c UNION ALL SELECT array_to_string(list_slice({_LABELS}, -2, -1), '.') FROM c WHERE len({_LABELS}) > 2
  ) WHERE domain IS NOT NULL
), e AS (
  SELECT domain, TIMESTAMP '2024-01-01' + to_days(day) AS listed_at, min(action) AS action
  FROM d JOIN (VALUES {_FEED_ROWS}) f(digit, action, day) ON substr(md5(domain), 1, 1) = digit GROUP BY ALL
), i AS (
  SELECT *, lead(listed_at) OVER (PARTITION BY domain ORDER BY listed_at) AS valid_to FROM e
), l AS (
  SELECT page_id, level, array_to_string(list_slice({_LABELS}, -level, -1), '.') AS domain, fetched_at
  FROM (SELECT *, unnest(range(1, len({_LABELS}) + 1)) AS level FROM c WHERE host IS NOT NULL)
), m AS (
  SELECT l.page_id, arg_max(i.domain, level) AS listed_domain, arg_max(action, level) AS action
  FROM l JOIN i ON l.domain = i.domain AND listed_at <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
  WHERE action <> 'remove' GROUP BY l.page_id
)
SELECT c.page_id, url, fetched_at, host, listed_domain, action, coalesce(action <> 'block', true) AS kept
FROM c LEFT JOIN m USING (page_id)
"""
