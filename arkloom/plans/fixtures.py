"""Captures, manifests and archived pages that the ``pages`` table sets, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom.operators.captures import Settings, Target

SETTINGS = Settings(
    snapshot="first",
    ignore=("utm_source", "ref"),
    targets=(Target("com", "example.com", exclude=("/de/",)), Target("net", "example.net", exclude=("/de/",))),
)

EXTERNAL = replace(SETTINGS, external_asset=True)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of each page; one of them with a tracking parameter."""
    rows = pages(spark, sf_dir).select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(3)))).alias("s"))
    i, s = F.col("page_id"), F.col("s")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    plain = ~F.contains("url", F.lit("?")) & ~F.contains("url", F.lit("#"))
    out = rows.select(
        (i * 3 + s).alias("seq"),
        F.concat(F.lit("2013"), two((i * 7 + s * 5) % 12 + 1), two((i * 3 + s) % 28 + 1), F.lit("000000")).alias("timestamp"),
        F.when((s == 1) & plain, F.concat("url", F.lit("?utm_source=feed"))).otherwise(F.col("url")).alias("original"),
        F.when((i + s) % 11 == 0, F.lit("404")).otherwise(F.lit("200")).alias("statuscode"),
        F.when(i % 7 == 0, F.lit("image/png")).otherwise(F.lit("text/html")).alias("mimetype"),
        F.md5(F.concat("html", s.cast("string"))).alias("digest"),
    )
    return out.withColumn("urlkey", F.regexp_replace(F.regexp_replace("original", "#.*$", ""), "^https?://", ""))


CAPTURES = """
captures_v AS (SELECT *, regexp_replace(regexp_replace(original, '#.*$', ''), '^https?://', '') AS urlkey FROM (
  SELECT page_id * 3 + s AS seq,
    concat('2013', lpad(CAST((page_id * 7 + s * 5) % 12 + 1 AS VARCHAR), 2, '0'), lpad(CAST((page_id * 3 + s) % 28 + 1 AS VARCHAR), 2, '0'), '000000') AS timestamp,
    CASE WHEN s = 1 AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' THEN concat(url, '?utm_source=feed') ELSE url END AS original,
    CASE WHEN (page_id + s) % 11 = 0 THEN '404' ELSE '200' END AS statuscode,
    CASE WHEN page_id % 7 = 0 THEN 'image/png' ELSE 'text/html' END AS mimetype, md5(concat(html, CAST(s AS VARCHAR))) AS digest
  FROM pages CROSS JOIN (VALUES (0), (1), (2)) AS v(s)))"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the pages as captured, so that links are dead and entries unknown."""
    return whole_manifest(spark, sf_dir).filter("key_seq % 5 <> 0")


def whole_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captured."""
    base = F.regexp_replace("url", "#.*$", "")
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("key_seq"), base.alias("original"), F.regexp_replace(base, "(.)/$", "$1").alias("key"),
        F.concat(F.lit("2013"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("01000000")).alias("timestamp"),
        F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("local_path"), F.lit("site").alias("target"),
    )


MANIFEST = r"""
whole_v AS (SELECT page_id AS key_seq, regexp_replace(url, '#.*$', '') AS original,
  regexp_replace(regexp_replace(url, '#.*$', ''), '(.)/$', '\1') AS key,
  concat('2013', lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0'), '01000000') AS timestamp,
  concat('site/', CAST(page_id AS VARCHAR), '.html') AS local_path, 'site' AS target FROM pages),
manifest_v AS (SELECT * FROM whole_v WHERE key_seq % 5 <> 0),
url_map_v AS (SELECT key, arg_max(local_path, key_seq) AS path FROM manifest_v GROUP BY key),
raw_v AS (SELECT local_path FROM manifest_v WHERE key_seq % 3 <> 0)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).filter("key_seq % 3 <> 0").select("local_path")


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with references as an archive leaves them, also those without html or URL."""
    i = F.col("page_id")
    n = lambda k: (i % k).cast("string")
    added = F.concat(
        F.lit('<a href="https://web.archive.org/web/20130101000000/'), F.coalesce(F.regexp_replace("url", "#.*$", ""), F.lit("")), F.lit('#top">self</a><a href="http://outside.test/x">out</a>'),
        F.lit('<img src="/web/20130101000000im_/http://cdn'), n(3), F.lit(".test/i"), n(10), F.lit('.png"><img data-src="http://cdn0.test/lazy.png">'),
        F.lit('<iframe src="https://web.archive.org/web/20130101000000if_/http://widgets.test/w?id='), n(4), F.lit('"></iframe><link rel="stylesheet" href="http://cdn1.test/s.css?v='), n(2), F.lit('">'),
    )
    return pages(spark, sf_dir).select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), added).alias("html"), F.concat(F.lit("site/"), i.cast("string"), F.lit(".html")).alias("local_path"))


def scope(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("example.com",), ("example.net",)], "host string")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stylesheet for each page, with references of all forms."""
    i = F.col("page_id").cast("string")
    css = F.concat(F.lit("a{background:url(http://cdn"), (F.col("page_id") % 3).cast("string"), F.lit('.test/b.png)} @import "http://www.example.com/c'), i, F.lit('.css"; b{background:url("../img/'), i, F.lit('.png")} c{background:url(data:x)}'))
    return pages(spark, sf_dir).select("page_id", F.concat(F.lit("http://www.example.com/css/s"), i, F.lit(".css")).alias("original"), F.lit("20130101000000").alias("timestamp"), css.alias("css"))


SHEETS = """
sheets_v AS (SELECT page_id, concat('a{background:url(http://cdn', CAST(page_id % 3 AS VARCHAR), '.test/b.png)} @import "http://www.example.com/c', CAST(page_id AS VARCHAR),
  '.css"; b{background:url("../img/', CAST(page_id AS VARCHAR), '.png")} c{background:url(data:x)}') AS css FROM pages)"""

LINKS = r"""
links_v AS (SELECT page_id, url, ord, value, CASE WHEN value LIKE '/%' THEN concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), value) ELSE value END AS target
  FROM (SELECT page_id, url, unnest(hrefs) AS value, unnest(range(len(hrefs))) AS ord FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS hrefs FROM pages)))"""


PATHS = r"""
p AS (SELECT page_id, url, regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '^https?://[^/]*', '') AS path,
  CASE WHEN contains(url, '?') THEN split_part(regexp_replace(url, '#.*$', ''), '?', 2) ELSE '' END AS q FROM pages),
s AS (SELECT page_id, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[^A-Za-z0-9._()-]', '_', 'g'), '(?i)^(.+)\.(html|htm|php)$', '\1')) AS stem,
  list_filter(string_split_regex(q, '[&=]'), lambda x: x <> '') AS parts, ends_with(path, '/') AND path <> '/' AS slash FROM p),
folders AS (SELECT array_to_string(stem[1:i], '/') AS stem_key FROM (SELECT stem, unnest(range(1, len(stem))) AS i FROM s) UNION SELECT array_to_string(stem, '/') FROM s WHERE len(parts) > 0 OR slash),
named AS (SELECT page_id, 'site/' || CASE WHEN len(parts) > 0 THEN array_to_string(stem || parts, '/') || '.html' WHEN len(stem) = 0 THEN 'index.html'
  WHEN array_to_string(stem, '/') IN (SELECT stem_key FROM folders) THEN array_to_string(stem, '/') || '/index.html' ELSE array_to_string(stem, '/') || '.html' END AS path FROM s),
placed AS (SELECT page_id, path, row_number() OVER (PARTITION BY path ORDER BY page_id) AS n FROM named),
paths_v AS (SELECT page_id, CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '\.html$', '') || '_' || n || '.html' END AS local_path FROM placed)"""
