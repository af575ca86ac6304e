"""URL filters by temporal list join.

Dated list entries (add or remove a pattern at a time) become validity intervals; an as-of join then
evaluates every capture against the entries that were active when it was fetched.  The join is an
equality join on (pattern, month of the interval or capture) plus the comparison of times, so a host
with very many captures or a list with a long history is spread over months.  Only keys that a list
names take part; the two sides of the join are plain tables, so AQE splits what is still too large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep_matching, written

#: An interval without an end lasts until here.
FOREVER = "9999-01-01 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user info, port and leading www. (null or no host: null)."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, at least '/'."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.length(path) > 0, path).otherwise(F.lit("/"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, category, valid_from, valid_to) from (kind, pattern, category, action, effective_at).

    action is 'add' or 'remove'; of several entries of one moment a removal counts last.  Entries with a
    null in any of the five columns are void.  An 'add' after an 'add' continues the entry.  Hosts are
    compared in lower case without a leading www.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract("pattern", r"^[^/]*", 0)), r"^www\.", "")
    pattern = F.concat(host, F.regexp_extract("pattern", r"/.*$", 0)).alias("pattern")
    e = entries.select("kind", pattern, "category", "action", F.col("effective_at").cast("timestamp").alias("valid_from")).na.drop("any")
    e = e.groupBy("kind", "pattern", "category", "valid_from").agg(F.max("action").alias("action"))
    history = Window.partitionBy("kind", "pattern", "category").orderBy("valid_from")
    e = e.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(history), F.lit(FOREVER).cast("timestamp")))
    return e.where("action = 'add'").select("kind", "pattern", "category", "valid_from", "valid_to")


def capture_keys(captures: DataFrame) -> DataFrame:
    """Every (kind, pattern) under which a list could hold a capture: the host and its parent domains, and
    host + path up to the end of each segment, with and without the slash that follows it."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -i, i), ".").alias("pattern")))
    segments = F.split("path", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.col("host"), F.array_join(F.slice(segments, 1, i), "/")))
    slashed = F.transform(F.slice(upto, 1, F.size(segments) - 1), lambda x: F.concat(x, F.lit("/")))
    prefixes = F.transform(F.array_distinct(F.concat(upto, slashed)), lambda x: F.struct(F.lit("prefix").alias("kind"), x.alias("pattern")))
    return captures.where(F.col("host").isNotNull()).select("*", F.inline(F.concat(domains, prefixes)))


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """captures plus `blocked`, `n_active` and `first_match` ('category kind pattern', smallest).

    A capture is blocked when an entry with its host, a parent domain or a prefix of its host and path
    is active at its fetch time (from <= time < to).  A prefix ends where a path segment does: b.com/x
    holds b.com/x and b.com/x/y, not b.com/xy, and b.com/x/ only what lies below it.  A capture with a null URL, a URL without host or a
    null time matches nothing.  Captures that repeat are decided alike; the decision is made once per
    distinct (url, time).  Further columns pass through; columns of the three new names are replaced.
    """
    c = captures.select(F.col(url_col).alias("_url"), F.col(time_col).cast("timestamp").alias("_at")).na.drop("any").distinct()
    c = c.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    lists = validity_intervals(entries)
    # An interval stands in each month that it touches, up to the last capture's.
    last = F.lit(c.agg(F.max("_at")).first()[0]).cast("timestamp")
    lists = lists.where(F.col("valid_from") <= last)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.col("valid_to"), last), "month"), F.expr("interval 1 month"))
    lists = written(lists.withColumn("month", F.explode(months)), "url-intervals")
    # Keys that no list names, such as a bare top domain, which every host below it has, meet nothing.
    keys = capture_keys(c).withColumn("month", F.trunc("_at", "month"))
    keys = keep_matching(keys, lists.select("kind", "pattern", "month").distinct(), ["kind", "pattern", "month"])
    active = keys.join(lists, ["kind", "pattern", "month"]).where((F.col("valid_from") <= F.col("_at")) & (F.col("_at") < F.col("valid_to")))
    label = F.concat_ws(" ", "category", "kind", "pattern")
    found = active.groupBy("_url", "_at").agg(F.count("*").alias("found"), F.min(label).alias("label"))
    names = {x: fresh(captures.columns, "match_" + x) for x in ("_url", "_at", "found", "label")}
    for old, new in names.items():
        found = found.withColumnRenamed(old, new)
    out = captures.join(found, (captures[url_col] == found[names["_url"]]) & (captures[time_col].cast("timestamp") == found[names["_at"]]), "left")
    count = F.col(names["found"])
    new = {"blocked": count.isNotNull(), "n_active": F.coalesce(count, F.lit(0)), "first_match": F.col(names["label"])}
    kept = [captures[x] for x in captures.columns if x.lower() not in new]
    return out.select(*kept, *[v.alias(k) for k, v in new.items()])
