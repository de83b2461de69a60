"""Not-modified revisit resolution for web archive records.

A revisit record says that a page had not changed (status 304) and carries few headers
and no body. It is resolved by an as-of join on the canonical URL to the latest full
response (status 200) captured strictly earlier; of responses at the same instant the
one with the largest record_id counts. The validators must agree: the entity tag if both
have one (a weak tag equals its strong form), else the last-modified time if both have
one, else the payload digest; a revisit that has nothing to compare is unverified. A
verified revisit gets the response's headers, updated by those that a 304 may change, and
its payload digest.

The as-of join carries the last response forward in time. One URL may hold most of all
records, so time is cut into slices: inside (url, slice) a window carries the last
response, and a second window over one row per (url, slice) carries the last response
of the slices before. No task sees more than one slice of a URL.

Defined cases. Null or blank URL or null time: never resolved (status no_capture); such
responses resolve nothing. Null header maps are empty. Header names are compared in lower
case; of names that differ in case only, the last in the map counts. Repeated revisits are
each resolved; repeated responses are one capture. Empty table: no rows. Extra columns of
revisits are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import saved

# Headers that describe the stored body and stay as the full response has them.
STORED_HEADERS = ("content-encoding", "content-language", "content-length", "content-range", "content-type", "transfer-encoding",
                  "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade")
SLICES = 256


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, http for https, without user, www, default port, fragment, trailing slash; sorted query."""
    u = F.btrim(F.regexp_replace(url, r"#.*$", ""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(host != "", F.concat(F.lit("http://"), host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(F.lit(""))))


def lower_names(headers: Column) -> Column:
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(
        F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts long, status, etag, last_modified, digest, headers map):
    record_id, url_key, ts, response_id, response_ts, outcome, headers, digest."""
    r = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"),
                       "etag", "last_modified", "digest", lower_names(F.col("headers")).alias("headers"))
    r = saved(r.where(F.col("status").isin(200, 304)))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    span = r.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    low, width = span["a"] or 0, max(1, ((span["b"] or 0) - (span["a"] or 0)) // slices + 1)
    r = r.withColumn("slice", F.floor((F.col("ts") - F.lit(low)) / F.lit(width)))
    capture = F.when((F.col("status") == 200) & usable, F.struct("ts", "record_id", "etag", "last_modified", "digest"))
    # Rows at one instant see only earlier responses: the range ends one tick before.
    inside = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    last = saved(r.where(usable & (F.col("status") == 200)).groupBy("url_key", "slice").agg(F.max(F.struct("ts", "record_id")).alias("top")))
    # Only (url, slice) pairs that have records: the last response of the slices before.
    known = r.where(usable).select("url_key", "slice").distinct().join(last, ["url_key", "slice"], "left")
    before = known.withColumn("earlier", F.max("top").over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    at = (r.withColumn("near", F.max(F.when(capture.isNotNull(), F.struct("ts", "record_id"))).over(inside))
          .where("status = 304")
          .join(before.select("url_key", "slice", "earlier"), ["url_key", "slice"], "left")
          .withColumn("found", F.when(usable, F.coalesce("near", "earlier"))))
    full = (r.where(usable & (F.col("status") == 200)).dropDuplicates(["url_key", "ts", "record_id"])
            .select(F.col("url_key").alias("c_url"), F.col("ts").alias("c_ts"), F.col("record_id").alias("c_id"), F.col("etag").alias("c_etag"),
                    F.col("last_modified").alias("c_modified"), F.col("digest").alias("c_digest"), F.col("headers").alias("c_headers")))
    j = at.join(full, (F.col("url_key") == F.col("c_url")) & (F.col("found.ts") == F.col("c_ts")) & (F.col("found.record_id") == F.col("c_id")), "left")
    tag = lambda c: F.regexp_replace(c, r"^W/", "")
    agrees = (F.when(F.col("etag").isNotNull() & F.col("c_etag").isNotNull(), tag(F.col("etag")) == tag(F.col("c_etag")))
              .when(F.col("last_modified").isNotNull() & F.col("c_modified").isNotNull(), F.col("last_modified") == F.col("c_modified"))
              .when(F.col("digest").isNotNull() & F.col("c_digest").isNotNull(), F.col("digest") == F.col("c_digest")))
    outcome = (F.when(F.col("c_id").isNull(), "no_capture").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed"))
    j = j.withColumn("outcome", outcome)
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*STORED_HEADERS))
    merged = F.map_concat(F.map_filter("c_headers", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    done = F.col("outcome") == "resolved"
    return j.select("record_id", "url_key", "ts", F.col("c_id").alias("response_id"), F.col("c_ts").alias("response_ts"), "outcome",
                    F.when(done, merged).alias("headers"), F.when(done, F.col("c_digest")).alias("digest"))


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records derived from ``pages`` (page_id, url, html): each page is a response at time 10 * page_id, and a
    revisit three ticks later that names the tag of its own page. A revisit is checked against what the archive has for its
    URL at that time; every fifth names a tag that nothing has, every seventh no tag but the digest, every eleventh comes
    before its page."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    server = F.concat(F.lit("s"), F.pmod(i, F.lit(3)).cast("string"))
    response = pages.select((i * 2).alias("record_id"), "url", (i * 10).alias("ts"), F.lit(200).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
                            digest.alias("digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("Server"), server,
                                                                 F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    revisit = pages.select((i * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"),
                           F.when(F.pmod(i, F.lit(11)) == 0, i * 10 - 5).otherwise(i * 10 + 3).alias("ts"), F.lit(304).alias("status"),
                           F.when(F.pmod(i, F.lit(7)) == 0, F.lit(None)).when(F.pmod(i, F.lit(5)) == 0, F.lit('"none"')).otherwise(F.concat(F.lit("W/"), tag)).alias("etag"),
                           F.lit(None).cast("string").alias("last_modified"), digest.alias("digest"),
                           F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), (i * 10 + 3).cast("string")).alias("headers"))
    return response.unionByName(revisit)
