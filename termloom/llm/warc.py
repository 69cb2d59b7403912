"""Not-modified revisits of a web archive, resolved by an as-of join on the canonical URL. DataFrame operations only.

The join cuts time into buckets: inside a bucket a window finds the latest earlier response, and each bucket starts with
what the last bucket that had a response left over. So a task sorts one URL's captures of one bucket, and a URL with a
third of all captures is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Query parameters that don't change what is served.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
#: Fields that a 304 response may not replace: they describe the stored body or one connection.
KEPT_FIELDS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or tracking parameter, sorted parameters, / as the empty
    path. Null for null, empty and blank URLs."""
    trimmed = F.trim(url)
    bare = F.regexp_replace(F.when(trimmed != "", trimmed), r"(?s)#.*$", "")
    site = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(bare, F.char_length(site) + 1, F.char_length(bare))
    site = F.regexp_replace(F.regexp_replace(site, r"^(http://[^/?]*):80$", "$1"), r"^(https://[^/?]*):443$", "$1")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(site, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """A row per revisit of records(record_id, url, ts, kind, etag, last_modified, headers).

    kind is response or revisit; ts are seconds; headers a map with lower-case names. Returns record_id, canonical_url,
    resolved_id (the latest response of the URL before it, by ts and then record_id), status and headers. status:
    `unresolved` without an earlier response; `resolved` if the first validator that both sides have agrees (entity tag
    without its weakness mark, then last_modified); `mismatch` if it differs, `unverified` if they share none. Headers
    are the response's, replaced by the revisit's except for KEPT_FIELDS; unless status is resolved or unverified they
    are the revisit's own. Null kinds are left out, null times come first, null headers count as none. A revisit
    without a URL is `unresolved`: records without one aren't captures of the same page. Repeated rows are returned as
    often as they come, an empty table gives no row, and further columns are ignored.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.coalesce("ts", F.lit(-1)).cast("long").alias("ts"), "kind",
        F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
    )
    every = materialise(rows.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds)), "captures")
    rows, adrift = every.where("canonical_url is not null"), every.where("canonical_url is null and kind = 'revisit'")
    response = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    ends = rows.where("kind = 'response'").groupBy("canonical_url", "bucket").agg(F.max_by(F.struct("record_id", "etag", "last_modified", "headers"), F.struct("ts", "record_id")).alias("last"))
    buckets = rows.select("canonical_url", "bucket").distinct().join(ends, ["canonical_url", "bucket"], "left")
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(buckets.select("canonical_url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried")), "carried")
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("seen", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    found = seen.join(carried, ["canonical_url", "bucket"]).withColumn("base", F.coalesce("seen", "carried"))
    tag = F.col("etag").isNotNull() & F.col("base.etag").isNotNull()
    date = F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull()
    same = F.when(tag, F.col("etag") == F.col("base.etag")).when(date, F.col("last_modified") == F.col("base.last_modified"))
    status = F.when(F.col("base").isNull(), "unresolved").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    newer = F.map_filter("headers", lambda k, v: ~k.isin(*KEPT_FIELDS))
    older = F.map_filter(F.col("base.headers"), lambda k, v: ~F.array_contains(F.map_keys(newer), k))
    merged = F.when(F.col("status").isin("resolved", "unverified"), F.map_concat(older, newer)).otherwise(F.col("headers"))
    out = found.withColumn("status", status).select("record_id", "canonical_url", F.col("base.record_id").alias("resolved_id"), "status", merged.alias("headers"))
    return out.unionByName(adrift.select("record_id", "canonical_url", F.lit(None).cast(out.schema["resolved_id"].dataType).alias("resolved_id"), F.lit("unresolved").alias("status"), "headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures made from a page table: each page is a response in hour page_id, and is visited again half an hour
    later; every fifth visit names an entity tag that doesn't fit."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("record_id"), "url", (F.col("page_id") * 3600).cast("long").alias("ts"), tag.alias("tag"))
    pair = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    nothing = F.lit(None).cast("string")
    full = rows.select("record_id", "url", "ts", F.lit("response").alias("kind"), F.col("tag").alias("etag"), nothing.alias("last_modified"), pair("content-type", "text/html", "etag", F.col("tag"), "age", "0").alias("headers"))
    again = F.when(F.col("record_id") % 5 == 0, F.lit("other")).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    brief = rows.select("record_id", "url", F.col("ts") + 1800, F.lit("revisit"), again, nothing, pair("content-type", "none", "age", (F.col("record_id") % 7).cast("string"), "etag", again))
    return full.union(brief)
