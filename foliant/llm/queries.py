"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language_id, license_scan, minhash, packing, quality_rules, sentence_pieces, spot_signatures, token_counts, url_filter, warc

#: The list of op3: canonical URLs by a rule, one in LISTED_STEP numbers of each host and language.
LISTED_HOSTS = ("tionsh.example.net", "ththan.example.net", "ththon.example.com", "blog.tionble.example.com", "ththou.example.net")
LISTED_LANGUAGES = ("en", "fr", "de", "es")
LISTED_STEP, LISTED_END = 7, 70_000
#: Also listed, at every scale: canonical URLs of the table itself whose MD5 begins with one of these digits (one in 8), and those of spam hosts, by a label of the host.
LISTED_DIGITS = ("0", "1")
SPAM_LABELS = ("casino-win", "cheap-pills", "free-bets", "adult-x", "ads-track")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def listed_urls(spark: SparkSession, pages: DataFrame) -> DataFrame:
    hosts, languages = F.array(*map(F.lit, LISTED_HOSTS)), F.array(*map(F.lit, LISTED_LANGUAGES))
    numbers = spark.range(0, LISTED_END, LISTED_STEP)
    rows = numbers.select("id", F.explode(hosts).alias("h")).select("id", "h", F.explode(languages).alias("l"))
    fixed = rows.select(F.concat("h", F.lit("/"), "l", F.lit("/"), F.col("id").cast("string")).alias("url"))
    host = url_filter.host_of(F.col("url"))
    keyed = pages.select(host.alias("host"), url_filter.canonical(host, url_filter.path_of(F.col("url"))).alias("url"))
    spam = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, SPAM_LABELS)))
    return fixed.unionByName(keyed.where(F.left(F.md5("url"), F.lit(1)).isin(*LISTED_DIGITS) | spam).select("url"))


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op2_spot_fingerprints(spark, sf_dir):
    return spot_signatures.compare_edits(documents(spark, sf_dir))


def op3_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, listed_urls(spark, pages))


def op4_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_minhash_near_dedup(spark, sf_dir):
    return minhash.link_components(documents(spark, sf_dir), 3, 85)


def op8_license_scan(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir))


def op9_sentence_pieces(spark, sf_dir):
    return sentence_pieces.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc_revisits(spark, sf_dir):
    out = warc.resolve_revisits(warc.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "url_key", "ts", "response_id", "response_ts", "outcome", headers.alias("headers"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_spot_fingerprints, op3_url_filter, op4_language_id, op5_quality_rules,
    op6_token_counts, op7_minhash_near_dedup, op8_license_scan, op9_sentence_pieces, op10_warc_revisits,
)}

_RULE = """CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END"""
_DIGITS, _SPAM = ", ".join(f"'{d}'" for d in LISTED_DIGITS), ", ".join(f"'{x}'" for x in SPAM_LABELS)
_HOSTS, _LANGUAGES = ", ".join(f"'{h}'" for h in LISTED_HOSTS), ", ".join(f"'{x}'" for x in LISTED_LANGUAGES)

SQL = {
    "op3_url_filter": rf"""
WITH hosts AS (SELECT unnest([{_HOSTS}]) AS h), langs AS (SELECT unnest([{_LANGUAGES}]) AS l),
numbers AS (SELECT unnest(range(0, {LISTED_END}, {LISTED_STEP})) AS n),
paths AS (SELECT '/' || l || '/' || n AS p FROM langs, numbers),
parsed AS (SELECT page_id,
 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, {_RULE} AS rule FROM parsed),
keyed AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') AS h, regexp_replace(path, '(/index\.html?|\.html?|/+)$', '') AS p FROM ruled),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM keyed),
own AS (SELECT DISTINCT h || p AS u FROM labelled WHERE substr(md5(h || p), 1, 1) IN ({_DIGITS}) OR list_has_any(labels, [{_SPAM}])),
hit AS (SELECT *, rule IS NULL AND h || p <> '' AND (h IN (SELECT h FROM hosts) AND p IN (SELECT p FROM paths) OR h || p IN (SELECT u FROM own)) AS listed FROM labelled)
SELECT page_id, host, path, rule,
 CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM hit""",
    "op10_warc_revisits": r"""
WITH base AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
keyed AS (SELECT *, regexp_replace(url, '(?s)#.*$', '') AS u FROM base),
parts AS (SELECT *, regexp_replace(translate(regexp_extract(u, '(?s)^.*?://([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '') AS h,
 regexp_replace(regexp_extract(u, '(?s)^.*?://[^/?]*([^?]*)', 1), '/+$', '') AS p,
 regexp_replace(regexp_replace(regexp_extract(u, '(?s)^.*?://[^/?]*[^?]*\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS q FROM keyed),
named AS (SELECT *, CASE WHEN contains(url, '://') THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS k FROM parts),
tags AS (SELECT page_id AS i, k, '"' || md5(html) || '"' AS tag, '"' || md5(md5(html)) || '"' AS tag2 FROM named),
responses AS (SELECT k, i * 10 AS id, i * 100 AS ts, tag AS etag, 'day ' || i % 365 AS modified, i AS date FROM tags
 UNION ALL SELECT k, i * 10 + 1, i * 100 + 40, tag2, 'day ' || (i + 1) % 365, i FROM tags WHERE i % 3 <> 0),
revisits AS (SELECT k, -i * 10 - 1 AS id, i * 100 - 5 AS ts, tag AS etag, NULL AS modified, i FROM tags
 UNION ALL SELECT k, -i * 10 - 2, i * 100 + 20, CASE WHEN i % 5 = 0 THEN '"other"' WHEN i % 5 >= 3 THEN 'W/' || tag END, CASE WHEN i % 5 <> 2 THEN 'day ' || i % 365 END, i FROM tags
 UNION ALL SELECT k, -i * 10 - 3, i * 100 + 60, tag, NULL, i FROM tags),
found AS (SELECT r.id, max(struct_pack(ts := s.ts, id := s.id)) AS x FROM revisits r JOIN responses s ON r.k = s.k AND s.ts < r.ts GROUP BY r.id),
joined AS (SELECT r.*, s.id AS response_id, s.ts AS response_ts, s.etag AS old, s.modified AS was, s.date FROM revisits r LEFT JOIN found f ON r.id = f.id LEFT JOIN responses s ON s.id = f.x.id),
judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = old THEN 'resolved' ELSE 'changed' END
 WHEN modified IS NOT NULL THEN CASE WHEN modified = was THEN 'resolved' ELSE 'changed' END ELSE 'unverified' END AS outcome FROM joined)
SELECT id AS record_id, k AS url_key, ts, response_id, response_ts, outcome,
 CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || (i + 1) || ';etag=' || old || ';expires=0' END AS headers FROM judged""",
}
