"""URL rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

The filter is a table of 64-bit blocks, one row each: a URL's hash names its block and a few bits in it. A URL whose bits
aren't all set is not listed; only the others go to the exact hash join with the list, which removes the false positives.
Pages that a rule decides ask neither. Where the list is too long to be broadcast, each distinct URL asks once, so that
many pages of one URL don't meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import ascii_lower, joined, stored

BITS = 5  # of each URL in its block
PER_BLOCK = 4  # listed URLs a block on average
#: A filter or list of at most so many rows is broadcast, a larger one joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Fixed values: (host, path, verdict) of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_of(url: Column) -> Column:
    """From behind the first :// to the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host or a parent domain of it and begins the path; else null. Of rules as long, the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., and path without index page, .html and closing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/index\.html?|\.html?|/+)$", ""))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """The URL's bits in its block, from a second hash."""
    h = F.xxhash64(url, F.lit("bits"))
    out = F.lit(0).cast("bigint")
    for k in range(BITS):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(h, 6 * k), F.lit(64)).cast("int")))
    return out


def bloom(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The blocks (block, mask) of the listed URLs, and how many blocks there could be."""
    blocks = max(1, -(-n // PER_BLOCK))
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("url"))).alias("mask")), blocks


def listed_of(asked: DataFrame, listed: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` (url, ...) whose URL is listed: those that pass the filter, then those that the exact join finds."""
    probed = asked.join(table, _block(asked["url"], blocks) == table["block"])
    need = _mask(F.col("url"))
    maybe = probed.where(F.col("mask").bitwiseAND(need) == need).drop("block", "mask")
    return maybe.join(listed, "url", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page.

    ``listed`` has canonical URLs in its column url; null and repeated ones don't matter. A page without a rule is blocked
    if its canonical URL is listed, else allowed; null and malformed URLs have empty host and path and are never listed.
    Repeated pages stay as many rows; an empty table gives none; other columns aren't read.
    """
    listed = listed.select(F.col("url").cast("string").alias("url")).where("url <> ''").distinct()
    n = listed.count()
    table, blocks = bloom(listed, n)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", name.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("url"))
    asks = F.col("by_rule").isNull() & (F.col("url") != "")
    columns = ["page_id", "host", "path", "rule"]
    if n <= broadcast_rows:
        # one pass over the pages; a page that asks nothing has a null URL, and the joins are broadcast
        parsed = parsed.withColumn("url", F.when(asks, F.col("url")))
        probed = parsed.join(F.broadcast(table), _block(parsed["url"], blocks) == table["block"], "left")
        need = _mask(F.col("url"))
        maybe = probed.withColumn("url", F.when(F.col("mask").bitwiseAND(need) == need, F.col("url")))
        exact = F.broadcast(listed.select(F.col("url").alias("hit")))
        out = maybe.join(exact, maybe["url"] == exact["hit"], "left").withColumn("listed", F.col("hit").isNotNull())
    else:
        asked = parsed.where(asks).groupBy("url").agg(F.count(F.lit(1)).alias("pages"))
        judged = stored(asked.join(listed_of(asked.select("url"), listed, table, blocks).withColumn("listed", F.lit(True)), "url", "left"), "asked_urls")
        judged = judged.select("url", F.coalesce("listed", F.lit(False)).alias("listed"), "pages")
        rest = parsed.where(~asks).select(*columns, "by_rule", F.lit(False).alias("listed"))
        out = joined(parsed.where(asks), judged, ["url"], "pages").select(*columns, "by_rule", "listed").unionByName(rest)
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*columns, verdict.alias("verdict"), "listed")
