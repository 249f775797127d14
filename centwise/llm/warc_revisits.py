"""Not-modified revisits resolved to the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may renew in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't change what is fetched.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: A URL's records are dealt by time into cells of so many seconds, so that one URL isn't one task.
CELL = 3600


def canonical_url(url: Column) -> Column:
    """Scheme left out, host in lower case without 'www.' and default port, no fragment, no final slash, other parameters in order."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, parts, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _plain(headers: Column) -> Column:
    """Field names in lower case; of a field spelled in several ways the last spelling in order counts."""
    lower = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(lower, lambda e, i: F.forall(F.slice(lower, i + 2, F.size(lower)), lambda later: later["key"] != e["key"]))
    return F.coalesce(F.map_from_entries(last), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def resolve_revisits(records: DataFrame, permitted: list[str] | None = None) -> DataFrame:
    """One row per revisit of ``records`` (record_id, kind, url, fetched, headers, digest, size).

    ``kind`` is 'response' or 'revisit', ``headers`` a map, ``digest`` that of the
    payload.  Returns record_id, canonical, response_id, status, digest, size,
    headers: a revisit takes the latest response of its canonical URL that was
    fetched strictly earlier (of several at one time, the largest record_id).
    Status is 'resolved' if its ETag equals the response's (weak comparison), or,
    without an ETag, its Last-Modified does, or, without both, its digest does;
    'changed' if the one asked differs or the response lacks it; 'unverified' if
    it carries none; 'missing' without an earlier response.  Only a resolved
    revisit gets the response's digest, size and headers, the ``permitted`` ones
    renewed by its own.  A record_id is a number or a text.

    Records without URL, host or time are never matched (a revisit is then
    'missing'); null headers are empty; a null record_id is passed through;
    repeated revisits are each resolved; no rows give no rows.  The walk along a
    URL's records is dealt by time cells, and only the last response of each cell
    is carried on, so a URL with a third of all records is many groups.
    """
    renewing = F.array(*map(F.lit, permitted or PERMITTED))
    plain = records.where("kind IN ('response', 'revisit')").select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "fetched", _plain(F.col("headers")).alias("headers"), "digest", "size")
    at = F.unix_micros("fetched")
    usable = F.col("canonical").isNotNull() & F.col("fetched").isNotNull()
    full = F.when((F.col("kind") == "response") & usable, F.struct(at.alias("at"), F.col("record_id").alias("id"), F.col("headers"), F.col("digest"), F.col("size")))
    keyed = plain.select("*", at.alias("at"), F.floor(at / (CELL * 1_000_000)).alias("cell"), full.alias("full"))
    # rows at one time see only responses of an earlier one
    within = Window.partitionBy("canonical", "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    order = F.struct("at", "record_id")  # a null id comes before others
    near = keyed.withColumn("near", F.max_by("full", F.when(F.col("full").isNotNull(), order)).over(within)).where("kind = 'revisit'")
    cells = keyed.where(usable).groupBy("canonical", "cell").agg(F.max_by("full", F.when(F.col("full").isNotNull(), order)).alias("last"))
    before = Window.partitionBy("canonical").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("canonical", "cell", F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = near.join(carried, ["canonical", "cell"], "left").withColumn("base", F.when(usable, F.coalesce("near", "carried")))
    mine, theirs = F.col("headers"), F.col("base.headers")
    etag = lambda h: F.regexp_replace(F.trim(F.element_at(h, "etag")), "^W/", "")
    modified = lambda h: F.trim(F.element_at(h, "last-modified"))
    same = F.when(etag(mine).isNotNull(), F.coalesce(etag(mine) == etag(theirs), F.lit(False))).when(modified(mine).isNotNull(), F.coalesce(modified(mine) == modified(theirs), F.lit(False))).when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("base.digest"), F.lit(False)))
    status = F.when(F.col("base").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("changed")
    renewed = F.map_filter(mine, lambda k, v: F.array_contains(renewing, k) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    good = F.col("status") == "resolved"
    return joined.withColumn("status", status).select("record_id", "canonical", F.col("base.id").alias("response_id"), "status", F.when(good, F.col("base.digest")).alias("digest"), F.when(good, F.col("base.size")).alias("size"), F.when(good, merged).alias("headers"))
