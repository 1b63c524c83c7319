"""Not-modified revisits of web archives, resolved to the responses they repeat.

A revisit record of a server's 304 answer has no body. Its body is that of the latest earlier full response of the same
canonical URL, if the validators agree; its headers are that response's, overlaid with those that a 304 may update.
The as-of join is two windows: time is cut into spans of about as many records each, the last response of each URL and
span is carried over the spans, and inside a span the records are read in order. So a URL with most of all captures is
many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, place_among

#: Spans of time: as many as the session's shuffle partitions, within these bounds.
LEAST_SPANS, MOST_SPANS = 64, 16_384
#: Header fields that a 304 response may carry anew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Fixed value: query parameters that name a visitor's origin and no content.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user's origin and fragment; host in lower case without www. or m.; the path without a closing slash. Null or without ://: null."""
    u = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_replace(ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?]*)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"(?s)^.*?://[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"(?s)^.*?://[^/?]*[^?]*\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}=[^&]*", ""), "^&+", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def bare(etag: Column) -> Column:
    """A 304 compares weakly: the mark of a weak validator doesn't count."""
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url_key, ts, response_id, response_ts, outcome and headers of every revisit.

    ``records``: record_id long, url string, ts long, kind string ("response" or "revisit"), status int, etag,
    last_modified string, headers map of lower-case names. Full responses have status 200. Outcome: "resolved";
    "changed", where the revisit's ETag, or without one its Last-Modified, isn't the response's; "unverified", where it
    has neither; "missing" without an earlier response, a URL or a time. Headers are null unless resolved. Responses of
    the same time as a revisit aren't earlier; of responses of one time the greatest record_id counts. Repeated revisits
    stay as many rows; an empty table gives none; other columns aren't read.
    """
    columns = ["record_id", "ts", "kind", "status", "etag", "last_modified", "headers"]
    held = records.select(*columns, canonical_url(F.col("url")).alias("url_key"))
    revisits_of_nothing = held.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("ts").isNull()))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    held = held.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull() & (full | (F.col("kind") == "revisit")))
    spans = min(MOST_SPANS, max(LEAST_SPANS, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ends = held.agg(F.percentile_approx("ts", [k / spans for k in range(1, spans)], 10 * spans).alias("x")).head()["x"]
    # cuts of one time fall together, so captures of one time are never cut apart
    cuts = sorted({int(c) for c in ends or [0]})
    source = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    held = held.withColumn("span", place_among(F.col("ts"), cuts)).withColumn("source", source)
    # headers are carried once, with the response that is found
    at_end = held.groupBy("url_key", "span").agg(F.max_by("source", F.struct("source.ts", "source.record_id")).alias("end"))
    spans = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = at_end.select("url_key", "span", F.last("end", ignorenulls=True).over(spans).alias("carried"))
    inside = Window.partitionBy("url_key", "span").orderBy("ts", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = held.withColumn("found", F.last("source", ignorenulls=True).over(inside)).where("kind = 'revisit'").join(carried, ["url_key", "span"], "left")
    found = found.withColumn("response", F.coalesce("found", "carried"))
    none = revisits_of_nothing.withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    pick = ["record_id", "url_key", "ts", "etag", "last_modified", "headers", "response"]
    return merged(found.select(*pick).unionByName(none.select(*pick)))


def merged(found: DataFrame) -> DataFrame:
    outcome = (
        F.when(F.col("response").isNull(), F.lit("missing"))
        .when(F.col("etag").isNotNull(), F.when(bare(F.col("etag")) == bare(F.col("response.etag")), F.lit("resolved")).otherwise(F.lit("changed")))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("response.last_modified"), F.lit("resolved")).otherwise(F.lit("changed")))
        .otherwise(F.lit("unverified"))
    )
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce("response.headers", none), lambda k, v: ~F.map_contains_key(fresh, k))
    out = found.withColumn("outcome", outcome)
    return out.select("record_id", "url_key", "ts", F.col("response.record_id").alias("response_id"), F.col("response.ts").alias("response_ts"),
        "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(old, fresh)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log in the form of resolve_revisits() from the table of pages.

    Of every page, at 100 times its id: a full response, at 40 later another version of it for two ids in three. Under
    another spelling of its URL it's asked for again three times: 5 before the first response, with that one's ETag;
    20 after it, for one id in five with another ETag, for one with Last-Modified alone, for one with neither; and 60
    after it with the first response's ETag, which is out of date where there's a second one.
    """
    i, one, none = F.col("page_id"), F.lit(1), F.lit(None).cast("string")
    html = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    facts = pages.select("page_id", "url", html.alias("h"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    tag, tag2, day = quoted(F.col("h")), quoted(F.md5("h")), lambda n: F.concat(F.lit("day "), F.pmod(n, F.lit(365)).cast("string"))
    again = F.concat(F.regexp_replace(F.col("url"), "^https?://((www|m)\\.)?", "http://www."), F.lit("#again"))

    def record(number, url, ts, kind, etag, modified, headers):
        status = 200 if kind == "response" else 304
        parts = {"record_id": number, "url": url, "ts": ts, "kind": F.lit(kind), "status": F.lit(status), "etag": etag, "last_modified": modified, "headers": headers}
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def response(n, late, etag, modified):
        headers = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), etag, F.lit("date"), i.cast("string"))
        return record(i * 10 + n, F.col("url"), i * 100 + late, "response", etag, modified, headers)

    def revisit(n, late, etag, modified):
        headers = F.create_map(F.lit("content-type"), F.lit("none"), F.lit("date"), (i + one).cast("string"), F.lit("expires"), F.lit("0"))
        return record(-i * 10 - n, again, i * 100 + late, "revisit", etag, modified, headers)

    kind = F.pmod("page_id", F.lit(5))
    asked = F.when(kind == 0, F.lit('"other"')).when(kind >= 3, F.concat(F.lit("W/"), tag))
    second = F.when(F.pmod("page_id", F.lit(3)) != 0, response(1, 40, tag2, day(i + one)))
    rows = [response(0, 0, tag, day(i)), second, revisit(1, -5, tag, none), revisit(2, 20, asked, F.when(kind != 2, day(i))), revisit(3, 60, tag, none)]
    return facts.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")
