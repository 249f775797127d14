"""Temporal URL lists: dated entries become validity intervals, captures are judged by the entries active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, since, until) of dated ``entries`` (list, verdict, kind, pattern, day, action).

    An 'add' is in force until the next entry of the same list, verdict, kind and
    pattern, null if there is none.  Of entries at one time 'add' wins.
    """
    known = entries.where("list IS NOT NULL AND verdict IN ('allow', 'block') AND kind IN ('domain', 'prefix') AND pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    keys = ["list", "verdict", "kind", "pattern"]
    dated = known.groupBy(*keys, "day").agg(F.min("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    return dated.select(*keys, F.col("day").alias("since"), until.alias("until"), "action").where("action = 'add'").drop("action")


def host(url: Column) -> Column:
    """Lower-case host name, without user, port or final dot; empty where there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _keys(name: Column, way: Column) -> Column:
    """Every pattern that could match: the host and its parents, and the host with each part of the path."""
    labels = F.filter(F.split(name, r"\."), lambda p: p != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("rank")))
    parts = F.filter(F.split(way, "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern"), (F.lit(1000) + i).alias("rank")))
    none = F.lit(None).cast("array<struct<kind:string,pattern:string,rank:int>>")
    nothing = F.coalesce(none, F.array().cast("array<struct<kind:string,pattern:string,rank:int>>"))
    return F.concat(F.when(F.size(labels) > 0, domains).otherwise(nothing), F.when((F.size(labels) > 0) & (F.size(parts) > 0), prefixes).otherwise(nothing))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, verdict, kind, pattern, list, n_active for every row of ``captures`` (capture_id, url, fetched).

    A capture's host, parent domains and path prefixes are looked up among the
    intervals that hold its fetch time (since <= fetched < until).  The most
    specific active entry decides: a longer prefix before a shorter one, a prefix
    before a domain, a longer domain before a shorter one; block before allow,
    then the first list by name.  ``n_active`` counts the active entries; without
    one the verdict is 'none'.

    Null or malformed URLs and null fetch times match nothing.  Repeated captures
    (same id) are judged together, as one; a null id is one group of its own.
    Patterns are compared as given: domains in lower case, prefixes as host/path
    without a final slash.  No captures give no rows; no entries, 'none'.
    """
    name = host(F.coalesce("url", F.lit("")))
    named = captures.select("capture_id", "fetched", name.alias("host"), path(F.coalesce("url", F.lit(""))).alias("path"))
    asked = named.select("capture_id", "fetched", "host", F.explode_outer(_keys(F.col("host"), F.col("path"))).alias("key")).select("capture_id", "fetched", "host", "key.kind", "key.pattern", "key.rank")
    active = intervals(entries).withColumnsRenamed({"kind": "e_kind", "pattern": "e_pattern"})
    met = asked.join(active, (F.col("kind") == F.col("e_kind")) & (F.col("pattern") == F.col("e_pattern")) & (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))), "left")
    # smallest first: specific, block before allow, list name
    won = F.when(F.col("since").isNotNull(), F.struct((-F.col("rank")).alias("rank"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("soft"), "list", "kind", "pattern", "verdict"))
    best = met.groupBy("capture_id").agg(F.min("host").alias("host"), F.min(won).alias("won"), F.count("since").alias("n_active"))
    return best.select("capture_id", "host", F.coalesce("won.verdict", F.lit("none")).alias("verdict"), F.col("won.kind").alias("kind"), F.col("won.pattern").alias("pattern"), F.col("won.list").alias("list"), "n_active")
