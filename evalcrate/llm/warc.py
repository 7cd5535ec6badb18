"""Operator 3: resolution of not-modified (304) revisit records of a web archive.

Each revisit is matched, as of its own time, with the latest strictly earlier
full response of the same canonical URL.  Its validators must fit that response
(entity tags by weak comparison, else the modification date); then the response's
payload is the revisit's, with the header fields a 304 may update taken from the
revisit and all others from the response.

The as-of join runs in time buckets: inside a (URL, bucket) group a window finds
the last response, and a window over one row per bucket carries the last response
of earlier buckets, so a URL with a third of all records is spread over its
buckets.  Only ids, times and validators go through the windows; payload and
headers are joined to the matches by record id.

Edge cases: a revisit without an earlier response is ``no_response``, one with
unequal validators ``mismatch``, one without validators ``no_validator``; a null
URL has the empty canonical URL and matches nothing; a null time matches
nothing; of responses at one time the largest record id wins; a response without
an id is never matched, a revisit without one keeps its row; every revisit row
gives one row, however often it or its response is repeated; of several
responses with one id the latest gives the payload (then the one with the
larger hash); of header names that differ in case only the one that sorts last
counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.llm.shared import saved

BUCKET_ROWS = 50_000
HOT_ROWS = 50_000  # revisits of one response that one task joins
# fixed values: header fields that a 304 response may carry for an update
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# fixed values: query parameters that do not select content
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without default port, path without index page and end slash, sorted parameters
    without tracking ones; scheme, user and fragment are left out."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/(index\.html?)?$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"),
                      lambda p: (p != "") & ~p.rlike("(?i)^" + TRACKING + "(=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    return F.coalesce(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), F.lit(""))


def folded(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only the one that sorts last."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records(record_id, ts, url, type, etag, last_modified, headers, payload)``, type ``response`` or
    ``revisit``, to one row per revisit: ``record_id, ts, canonical_url, result, matched_id, headers, payload``."""
    slim = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "ts", canonical_url(F.col("url")).alias("canonical_url"),
        (F.col("type") == "response").alias("full"), "etag", "last_modified",
        F.when(F.col("type") == "revisit", F.map_filter(folded(F.col("headers")), lambda k, _: k.isin(*PERMITTED))).alias("own"))
    span = records.agg(F.min("ts").alias("low"), F.greatest((F.max("ts") - F.min("ts") + 1).cast("double"), F.lit(1.0)).alias("width"),
                       F.ceil(F.count("*") / F.lit(BUCKET_ROWS)).alias("n"))
    low, width, n = (span.select(c).scalar() for c in ("low", "width", "n"))
    slim = slim.withColumn("bucket", F.floor((F.col("ts") - low) / width * n))
    seen = F.when(F.col("full") & F.col("record_id").isNotNull() & F.col("ts").isNotNull() & (F.col("canonical_url") != ""), F.struct(
        "ts", "record_id", "etag", "last_modified"))
    # at one time revisits come first: a match is strictly earlier
    inside = (Window.partitionBy("canonical_url", "bucket").orderBy("ts", "full", "record_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = slim.withColumn("near", F.last(seen, ignorenulls=True).over(inside))
    carry = (slim.groupBy("canonical_url", "bucket").agg(F.max(seen).alias("latest"))
             .withColumn("carried", F.last("latest", ignorenulls=True).over(
                 Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
             .select("canonical_url", "bucket", "carried"))
    found = rows.where("NOT full").join(carry, ["canonical_url", "bucket"], "left").withColumn(
        "match", F.when(F.col("ts").isNotNull() & (F.col("canonical_url") != ""), F.coalesce("near", "carried")))

    def strong(tag):
        return F.regexp_replace(tag, "^W/", "")
    result = (F.when(F.col("match").isNull(), "no_response")
              .when(F.col("etag").isNotNull() & F.col("match.etag").isNotNull(),
                    F.when(strong(F.col("etag")) == strong(F.col("match.etag")), "resolved").otherwise("mismatch"))
              .when(F.col("last_modified").isNotNull() & F.col("match.last_modified").isNotNull(),
                    F.when(F.col("last_modified") == F.col("match.last_modified"), "resolved").otherwise("mismatch"))
              .otherwise("no_validator"))
    found = saved(found.withColumn("result", result).select(
        "record_id", "ts", "canonical_url", "result",
        F.when(F.col("result") == "resolved", F.col("match.record_id")).alias("matched_id"), "own"), "warc-found")
    full = (records.where("type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("matched_id"))
            .agg(F.max_by(F.struct(folded(F.col("headers")).alias("theirs"), "payload"), F.struct("ts", F.md5("payload"))).alias("r")))
    # a response that very many revisits match is spread over salts; unmatched revisits meet no join
    hot = saved(found.where("matched_id IS NOT NULL").groupBy("matched_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
                .select("matched_id", F.ceil(F.col("n") / F.lit(HOT_ROWS)).cast("int").alias("salts")), "warc-hot")
    salts = F.coalesce(F.col("salts"), F.lit(1))
    asked = found.where("matched_id IS NOT NULL").join(hot, "matched_id", "left").withColumn(
        "salt", F.pmod(F.xxhash64("record_id", "ts"), salts).cast("int")).drop("salts")
    given = full.join(hot, "matched_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    kept = F.map_filter("r.theirs", lambda k, _: ~F.map_contains_key("own", k))
    columns = ["record_id", "ts", "canonical_url", "result", "matched_id"]
    resolved = asked.join(given, ["matched_id", "salt"]).select(*columns, F.map_concat(kept, "own").alias("headers"), "r.payload")
    rest = found.where("matched_id IS NULL").select(*columns)
    return resolved.unionByName(rest, allowMissingColumns=True)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records derived from ``pages``.  A page is captured at the time of its id and revisited 50 time units later with a
    decorated URL and the entity tag that the crawler knew.  By the id modulo 7: 1 has no capture; the revisit of 2 knows an
    outdated tag, that of 3 a tag only after a second capture changed the page, that of 4 no validator."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    at, case = F.col("page_id").cast("long"), F.pmod(F.col("page_id"), F.lit(7))
    none = F.lit(None).cast("string")

    def capture(number, later, text):
        tag = F.md5(text)
        return [(at * 3 + number).alias("record_id"), (at + later).alias("ts"), url.alias("url"), F.lit("response").alias("type"),
                tag.alias("etag"), none.alias("last_modified"), F.create_map(
                    F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (at + later).cast("string"), F.lit("ETag"), tag).alias("headers"),
                text.alias("payload")]
    changed = F.concat(html, F.lit("<!-- 2 -->"))
    known = F.when(case == 2, F.md5(F.lit("outdated"))).when(case == 3, F.md5(changed)).when(case == 4, none).otherwise(F.md5(html))
    again = pages.select(
        (at * 3 + 2).alias("record_id"), (at + 50).alias("ts"),
        F.concat(url, F.when(F.instr(url, "?") > 0, "&utm_source=again").otherwise("#again")).alias("url"),
        F.lit("revisit").alias("type"), F.concat(F.lit("W/"), known).alias("etag"), none.alias("last_modified"), F.create_map(
            F.lit("Date"), (at + 50).cast("string"), F.lit("Server"), F.lit("x")).alias("headers"), none.alias("payload"))
    return (pages.where(F.coalesce(case != 1, F.lit(True))).select(*capture(0, 0, html))
            .unionByName(pages.where(case == 3).select(*capture(1, 25, changed))).unionByName(again))
