"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.operators import captures, content, site
from arkloom.plans import fixtures as fx
from arkloom.streaming import jobs
from arkloom.work import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql_key(url: str, ignore: str = "") -> str:
    """The canonical key in SQL, for URLs that need no decoding."""
    q = f"CASE WHEN contains({url}, '?') THEN substr({url}, strpos({url}, '?') + 1) ELSE '' END"
    if ignore:
        kept = f"array_to_string(list_filter(string_split({q}, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({ignore})), '&')"
        q = f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    else:
        q = f"CASE WHEN contains({url}, '?') THEN '?' || {q} ELSE '' END"
    return f"(regexp_replace(split_part({url}, '?', 1), '/+$', '') || {q})"


BASE = "regexp_replace(url, '#.*$', '')"
IGNORE = "'utm_source', 'ref'"
HOST = "regexp_extract(lower(url), '^https?://([^/?#]*)', 1)"

# --- URL columns ---------------------------------------------------------------------


@query(f"SELECT page_id, {_sql_key(BASE, IGNORE)} AS key FROM pages")
def normalize_url(spark, d):
    return fx.pages(spark, d).select("page_id", urls.normalize_url(F.col("url"), ("utm_source", "ref")).alias("key"))


@query(f"SELECT page_id, {HOST} AS host, {BASE} AS base, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#')) ELSE '' END AS frag FROM pages")
def host_of(spark, d):
    u = F.col("url")
    return fx.pages(spark, d).select("page_id", urls.host_of(u).alias("host"), urls.without_fragment(u).alias("base"), urls.fragment(u).alias("frag"))


@query("SELECT page_id, url AS original, concat('https://web.archive.org/web/20130101id_/', url) AS raw_url, '20130101' AS ts FROM pages")
def unwrap_url(spark, d):
    wrapped = F.concat(F.lit("https://web.archive.org/web/20130101im_/"), F.col("url"))
    return fx.pages(spark, d).select("page_id", urls.unwrap_archive_url(wrapped).alias("original"), urls.raw_capture_url(wrapped).alias("raw_url"), urls.capture_timestamp(wrapped).alias("ts"))


@query(f"""WITH q AS (SELECT page_id, string_split(CASE WHEN contains(url, '?') THEN split_part(regexp_replace(url, '#.*$', ''), '?', 2) ELSE '' END, '&') AS t FROM pages)
SELECT page_id, CASE WHEN k <> '' THEN '?' || k ELSE '' END AS query FROM (SELECT page_id, array_to_string(list_filter(t, lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({IGNORE})), '&') AS k FROM q)""")
def filter_query(spark, d):
    q = F.regexp_extract(urls.without_fragment(F.col("url")), urls.PARTS, 6)
    return fx.pages(spark, d).select("page_id", urls.filter_query(q, ("utm_source", "ref")).alias("query"))


@query(f"SELECT page_id, {HOST} = 'example.com' OR ends_with({HOST}, '.example.com') AS in_scope FROM pages")
def scope_match(spark, d):
    return fx.pages(spark, d).select("page_id", urls.host_in_scope(urls.host_of(F.col("url")), F.lit("example.com")).alias("in_scope"))


@query(rf"""WITH p AS (SELECT page_id, regexp_replace(split_part({BASE}, '?', 1), '^https?://[^/]*', '') AS path, CASE WHEN contains(url, '?') THEN split_part({BASE}, '?', 2) ELSE '' END AS q FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '[^A-Za-z0-9._()-]', '_', 'g'), '(?i)^(.+)\.(html|htm|php)$', '\1')), '/') AS stem,
 array_to_string(list_filter(string_split_regex(q, '[&=]'), lambda s: s <> ''), '/') AS query_parts FROM p""")
def safe_segments(spark, d):
    parts = captures.with_path_parts(fx.pages(spark, d).select("page_id", "url"), "url")
    return parts.select("page_id", F.array_join("stem", "/").alias("stem"), F.array_join("query_parts", "/").alias("query_parts"))


# --- captures to manifest ------------------------------------------------------------


@query(f"WITH {fx.CAPTURES} SELECT seq, original, timestamp FROM captures_v WHERE statuscode = '200' AND mimetype = 'text/html' AND timestamp >= '20130300000000' AND timestamp <= '20131099999999'")
def capture_filter(spark, d):
    return captures.capture_filter(fx.captures(spark, d), "201303", "201310").select("seq", "original", "timestamp")


@query(f"""WITH {fx.CAPTURES}, h AS (SELECT seq, regexp_extract(original, '^https?://([^/?#]*)', 1) AS host, regexp_replace(regexp_replace(original, '#.*$', ''), '^https?://', '') AS k FROM captures_v)
SELECT seq, host = 'example.com' AS by_host, host = 'example.com' OR ends_with(host, '.example.com') AS by_domain, starts_with(k, 'www.') AND starts_with(k, 'www.ththon.example.org/en') AS by_prefix FROM h""")
def match_type(spark, d):
    o = F.col("original")
    return fx.captures(spark, d).select("seq", captures.matches(o, "example.com", "host").alias("by_host"), captures.matches(o, "example.com", "domain").alias("by_domain"), captures.matches(o, "www.ththon.example.org/en", "prefix").alias("by_prefix"))


@query(f"WITH {fx.CAPTURES} SELECT seq, original FROM captures_v WHERE (contains(original, '/en/') OR regexp_matches(original, 'page=\\d')) AND NOT regexp_matches(original, '/9[0-9]*')")
def include_exclude(spark, d):
    return captures.include_exclude(fx.captures(spark, d), ("/en/", r"page=\d"), ("/9[0-9]*",)).select("seq", "original")


def _snapshot(strategy):
    return lambda spark, d: captures.select_snapshot(fx.captures(spark, d).withColumn("target", F.lit("t")), strategy).select("urlkey", "seq", "timestamp", "grp_seq")


for _name, _strategy, _measure in (("first", "first", "CAST(timestamp AS BIGINT)"), ("last", "last", "-CAST(timestamp AS BIGINT)"), ("closest", "closest:201306", "abs(CAST(timestamp AS BIGINT) - 20130600000000)")):
    QUERIES[f"snapshot_{_name}"] = _snapshot(_strategy)
    ORACLES[f"snapshot_{_name}"] = f"""WITH {fx.CAPTURES} SELECT urlkey, arg_min(seq, (m, seq)) AS seq, arg_min(timestamp, (m, seq)) AS timestamp, min(seq) AS grp_seq
FROM (SELECT *, {_measure} AS m FROM captures_v) GROUP BY urlkey"""

_MANIFEST_SQL = f"""WITH {fx.CAPTURES},
f AS (SELECT *, regexp_extract(original, '^https?://([^/?#]*)', 1) AS host FROM captures_v WHERE statuscode = '200' AND mimetype = 'text/html' AND NOT contains(original, '/de/')),
t AS (SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'com' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'net' END AS target FROM f),
a AS (SELECT target, urlkey, arg_min(original, (timestamp, seq)) AS original, min(timestamp) AS timestamp, min(seq) AS grp_seq FROM t WHERE target IS NOT NULL GROUP BY ALL),
k AS (SELECT *, {_sql_key("regexp_replace(original, '#.*$', '')", IGNORE)} AS key FROM a),
c AS (SELECT target, key, arg_min(original, (timestamp, grp_seq)) AS original, min(timestamp) AS timestamp, min(grp_seq) AS key_seq FROM k GROUP BY ALL)"""


@query(f"{_MANIFEST_SQL} SELECT target, key, original, timestamp, key_seq FROM c")
def collapse_canonical(spark, d):
    return captures.page_snapshots(fx.captures(spark, d), fx.SETTINGS).select("target", "key", "original", "timestamp", "key_seq")


@query(f"{_MANIFEST_SQL} SELECT target, key, concat('https://web.archive.org/web/', timestamp, 'id_/', original) AS wayback_url FROM c")
def build_manifest(spark, d):
    return captures.build_manifest(fx.captures(spark, d), fx.SETTINGS).select("target", "key", "wayback_url")


@query(f"{_MANIFEST_SQL} SELECT target, key FROM c ORDER BY target, key LIMIT 40")
def limit_urls(spark, d):
    return captures.limit_urls(captures.page_snapshots(fx.captures(spark, d), fx.SETTINGS), 40).select("target", "key")


@query(f"{_MANIFEST_SQL} SELECT target, count(*) AS n, count(DISTINCT original) AS n_urls FROM c GROUP BY target")
def counts_by_target(spark, d):
    return captures.page_snapshots(fx.captures(spark, d), fx.SETTINGS).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("original").alias("n_urls"))


@query(f"WITH {fx.PATHS} SELECT {BASE} AS original, local_path FROM paths_v JOIN pages USING (page_id)")
def assign_local_paths(spark, d):
    return captures.assign_local_paths(fx.whole_manifest(spark, d).drop("local_path").withColumn("prefix", F.col("target")), "key_seq").select("original", "local_path")


@query(f"WITH {fx.PATHS} SELECT {BASE} AS original, {_sql_key(BASE)} AS key, local_path FROM paths_v JOIN pages USING (page_id)")
def remap_manifest(spark, d):
    return captures.remap_manifest(fx.whole_manifest(spark, d)).select("original", "key", "local_path")


@query(rf"""WITH p AS (SELECT regexp_replace(split_part({BASE}, '?', 1), '^https?://[^/]*', '') AS path, contains({BASE}, '?') AS q FROM pages),
s AS (SELECT list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[^A-Za-z0-9._()-]', '_', 'g'), '(?i)^(.+)\.(html|htm|php)$', '\1')) AS stem, q, ends_with(path, '/') AND path <> '/' AS slash FROM p)
SELECT DISTINCT stem_key FROM (SELECT array_to_string(stem[1:i], '/') AS stem_key FROM (SELECT stem, unnest(range(1, len(stem))) AS i FROM s) UNION ALL SELECT array_to_string(stem, '/') FROM s WHERE q OR slash)""")
def directory_stems(spark, d):
    parts = captures.with_path_parts(fx.pages(spark, d).select("url", F.lit("").alias("prefix")), "url")
    return captures.directory_stems(parts).select("stem_key")


@query(f"""WITH {fx.MANIFEST}, k AS (SELECT page_id, {BASE} AS original, {_sql_key(BASE)} AS key FROM pages),
n AS (SELECT k.* FROM k WHERE key NOT IN (SELECT key FROM manifest_v)),
p AS (SELECT *, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS r, EXISTS (SELECT 1 FROM manifest_v m WHERE m.local_path = 'site/' || (n.page_id % 10 + 1) || '.html') AS there FROM n)
SELECT original, key, local_path, timestamp FROM manifest_v UNION ALL
SELECT original, key, 'site/' || (page_id % 10 + 1) || CASE WHEN r + CAST(there AS INT) = 1 THEN '' ELSE '_' || (r + CAST(there AS INT)) END || '.html', '2014' FROM p""")
def merge_manifest(spark, d):
    # Every page again, under few names, most of them taken.
    i = F.col("page_id")
    new = fx.pages(spark, d).select(urls.without_fragment(F.col("url")).alias("original"), i.alias("key_seq"), F.concat(F.lit("site/"), (i % 10 + 1).cast("string"), F.lit(".html")).alias("local_path"), F.lit("2014").alias("timestamp"), F.lit("site").alias("target"))
    return captures.merge_manifest(fx.manifest(spark, d), new).select("original", "key", "local_path", "timestamp")


@query(f"""WITH {fx.MANIFEST}, n AS (SELECT {_sql_key(BASE)} AS key, arg_min(page_id, page_id) AS page_id FROM pages WHERE {_sql_key(BASE)} NOT IN (SELECT key FROM manifest_v) GROUP BY 1)
SELECT key, local_path, timestamp FROM manifest_v UNION ALL SELECT key, 'other/n' || page_id || '.html', '2014' FROM n""")
def merge_overlapping(spark, d):
    # Every page again, found by two targets; of a key the first target's first entry is added.
    i = F.col("page_id")
    found = F.explode(F.array(F.struct(F.lit("site").alias("target"), F.lit(1).alias("target_ord")), F.struct(F.lit("other").alias("target"), F.lit(0).alias("target_ord")))).alias("t")
    new = fx.pages(spark, d).select(urls.without_fragment(F.col("url")).alias("original"), i.alias("key_seq"), F.lit("2014").alias("timestamp"), found).select("*", "t.*").drop("t")
    new = new.withColumn("local_path", F.concat("target", F.lit("/n"), F.col("key_seq").cast("string"), F.lit(".html")))
    return captures.merge_manifest(fx.manifest(spark, d), new).select("key", "local_path", "timestamp")


_MONTHS = tuple(captures.Target(f"{tld}{n}", f"example.{tld}", since=f"2013{n:02d}", until=f"2013{n:02d}") for tld in ("com", "net", "org") for n in range(1, 13))


@query(f"""WITH {fx.CAPTURES}, h AS (SELECT *, regexp_extract(original, '^https?://([^/?#]*)', 1) AS host FROM captures_v WHERE statuscode = '200' AND mimetype = 'text/html')
SELECT seq, regexp_extract(host, '([a-z]+)$', 1) || CAST(substr(timestamp, 5, 2) AS INT) AS target FROM h WHERE regexp_matches(host, '(^|[.])example[.](com|net|org)$')""")
def monthly_targets(spark, d):
    return captures.of_targets(fx.captures(spark, d), _MONTHS).select("seq", "target")


# --- progress and maps ---------------------------------------------------------------


@query(f"WITH {fx.MANIFEST} SELECT local_path, key FROM manifest_v WHERE local_path NOT IN (SELECT local_path FROM raw_v)")
def pending(spark, d):
    return site.pending(fx.manifest(spark, d), fx.raw(spark, d)).select("local_path", "key")


@query(f"""WITH {fx.MANIFEST} SELECT target, count(*) AS total, count(*) FILTER (key_seq % 3 <> 0) AS on_disk, count(*) FILTER (key_seq % 3 = 0) AS pending,
count(*) FILTER (key_seq % 3 = 1) AS cleaned, count(*) FILTER (key_seq % 6 = 0) AS failed FROM manifest_v GROUP BY target""")
def run_progress(spark, d):
    m = fx.manifest(spark, d)
    log = m.select("local_path", F.when(F.col("key_seq") % 6 == 0, F.lit("fail")).otherwise(F.lit("ok")).alias("outcome"))
    return site.run_progress(m, fx.raw(spark, d), m.filter("key_seq % 3 = 1"), log)


@query(f"""WITH {fx.MANIFEST} SELECT key, arg_max(path, (src, k)) AS path FROM (
  SELECT key, local_path AS path, 0 AS src, key_seq AS k FROM whole_v UNION ALL
  SELECT key, concat('site/_external/', key_seq, '.html'), 1, key_seq FROM whole_v WHERE key_seq % 7 = 0 AND key_seq % 2 = 0) GROUP BY key""")
def url_map(spark, d):
    whole = fx.whole_manifest(spark, d)
    other = whole.filter("key_seq % 7 = 0").withColumn("local_path", F.concat(F.lit("site/_external/"), F.col("key_seq").cast("string"), F.lit(".html")))
    return site.build_url_map(whole, other, other.filter("key_seq % 2 = 0"))


@query(f"""WITH {fx.MANIFEST} SELECT key, arg_max(path, (o, k)) AS path FROM (
  SELECT key, local_path AS path, 1 AS o, key_seq AS k FROM manifest_v UNION ALL SELECT key, concat('first/', key_seq, '.html'), 0, key_seq FROM whole_v) GROUP BY key""")
def url_map_overlapping(spark, d):
    # A page of two targets leads to the last one's copy.
    first = fx.whole_manifest(spark, d).withColumns({"target": F.lit("first"), "target_ord": F.lit(0), "local_path": F.concat(F.lit("first/"), F.col("key_seq").cast("string"), F.lit(".html"))})
    return site.build_url_map(fx.manifest(spark, d).withColumn("target_ord", F.lit(1)).unionByName(first))


@query(f"WITH {fx.MANIFEST} SELECT page_id, {_sql_key(BASE)} AS key FROM pages WHERE {_sql_key(BASE)} NOT IN (SELECT key FROM manifest_v)")
def drop_known(spark, d):
    return site.drop_known(fx.pages(spark, d).select("page_id", urls.normalize_url(F.col("url")).alias("key")), fx.manifest(spark, d))


# --- links and references ------------------------------------------------------------


@query(f"WITH {fx.LINKS} SELECT page_id, value FROM links_v")
def extract_links(spark, d):
    return content.extract_links(fx.pages(spark, d)).select("page_id", "value")


_STATE = f"""WITH {fx.MANIFEST}, {fx.LINKS},
k AS (SELECT *, regexp_extract(target, '^https?://([^/?#]*)', 1) AS host, {_sql_key("regexp_replace(target, '#.*$', '')")} AS key FROM links_v),
j AS (SELECT page_id, value, CASE WHEN path IS NOT NULL THEN 'local' WHEN ends_with('.' || host, '.example.com') OR ends_with('.' || host, '.example.net') THEN 'dead' ELSE 'external' END AS state FROM k LEFT JOIN url_map_v USING (key))"""


@query(f"{_STATE} SELECT page_id, value, state FROM j")
def classify_links(spark, d):
    links = site.resolved_links(fx.pages(spark, d))
    return site.classify_links(links, site.build_url_map(fx.manifest(spark, d)), fx.scope(spark)).select("page_id", "value", "state")


@query(f"{_STATE} SELECT state, count(*) AS n FROM j GROUP BY state")
def link_counts(spark, d):
    return classify_links(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_TITLE = "coalesce(nullif(trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')), ''), url)"


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, d):
    return fx.pages(spark, d).select("page_id", content.page_title(F.col("html"), F.col("url")).alias("title"))


@query(f"SELECT 'site' AS target, concat(page_id, '.html') AS rel_path, {_TITLE} AS title, count(*) OVER () AS n_pages FROM pages")
def page_index(spark, d):
    rows = fx.whole_manifest(spark, d).join(fx.pages(spark, d).select(F.col("page_id").alias("key_seq"), "html", "url"), "key_seq")
    return site.page_index(rows.select("target", "local_path", content.page_title(F.col("html"), F.col("url")).alias("title")))


_REFS = """r AS (
  SELECT page_id, concat('http://cdn', CAST(page_id % 3 AS VARCHAR), '.test/i', CAST(page_id % 10 AS VARCHAR), '.png') AS base, 'asset' AS kind FROM pages
  UNION ALL SELECT page_id, 'http://cdn0.test/lazy.png', 'asset' FROM pages
  UNION ALL SELECT page_id, concat('http://widgets.test/w?id=', CAST(page_id % 4 AS VARCHAR)), 'iframe' FROM pages
  UNION ALL SELECT page_id, concat('http://cdn1.test/s.css?v=', CAST(page_id % 2 AS VARCHAR)), 'asset' FROM pages)"""


@query(f"WITH {_REFS} SELECT base, min(kind) AS kind, count(DISTINCT page_id) AS n_pages FROM r GROUP BY base")
def external_refs(spark, d):
    return site.external_references(fx.archived(spark, d), fx.scope(spark), fx.manifest(spark, d), "page_id").select("base", "kind", "n_pages")


_FETCH = """CASE WHEN base LIKE 'http://cdn%/i%' THEN concat('https://web.archive.org/web/20130101000000im_/', base)
  WHEN kind = 'iframe' THEN concat('https://web.archive.org/web/20130101000000if_/', base) ELSE concat('https://web.archive.org/web/id_/', base) END"""


@query(rf"""WITH {fx.LINKS}, {_REFS},
v AS (SELECT page_id, value, ord FROM links_v UNION ALL
  SELECT page_id, concat('https://web.archive.org/web/20130101000000/', {BASE}, '#top'), 1000000000 FROM pages UNION ALL SELECT page_id, 'http://outside.test/x', 1000000001 FROM pages),
b AS (SELECT *, regexp_replace(CASE WHEN value LIKE '/web/%' OR contains(value, 'web.archive.org') THEN regexp_extract(value, '(?i)^(?:https?://web\.archive\.org)?/web/\d+[a-z_]*/(https?://.+)$', 1) ELSE value END, '#.*$', '') AS base
  FROM v WHERE value LIKE 'http://%' OR value LIKE 'https://%' OR value LIKE '/web/%'),
n AS (SELECT page_id, base, {_FETCH} AS fetch_url, kind, 0 AS link, 0 AS ord FROM r UNION ALL
  SELECT page_id, base, CASE WHEN value LIKE '/web/%' THEN concat('https://web.archive.org', value) WHEN contains(value, 'web.archive.org') THEN value ELSE concat('https://web.archive.org/web/id_/', base) END, 'asset', 1, ord FROM b WHERE base <> '')
SELECT base, arg_min(fetch_url, (page_id, link, ord)) AS fetch_url, arg_min(kind, (page_id, link, ord)) AS kind, min(page_id) AS found_in, count(DISTINCT page_id) AS n_pages FROM n GROUP BY base""")
def dedupe_references(spark, d):
    # All that pages name: what they load, in the order of its kinds, then their links as they stand.
    refs = site.asset_references(fx.archived(spark, d), links=True).withColumn("found_in", F.col("page_id"))
    return site.dedupe_references(refs, F.struct("page_id", "grp", "ord", F.when(F.col("attr") == "src", 0).otherwise(1))).drop("first")


@query(f"WITH {fx.MANIFEST} SELECT DISTINCT {BASE} AS base FROM pages WHERE (ends_with('.' || {HOST}, '.example.com') OR ends_with('.' || {HOST}, '.example.net')) AND {_sql_key(BASE)} NOT IN (SELECT key FROM manifest_v)")
def inscope_refs(spark, d):
    return site.inscope_references(fx.archived(spark, d), fx.scope(spark), fx.manifest(spark, d), "page_id").select("base")


@query(f"""WITH {fx.SHEETS} SELECT page_id, 0 AS grp, concat('http://cdn', CAST(page_id % 3 AS VARCHAR), '.test/b.png') AS value FROM sheets_v
UNION ALL SELECT page_id, 1, concat('http://www.example.com/c', CAST(page_id AS VARCHAR), '.css') FROM sheets_v""")
def css_refs(spark, d):
    return content.css_references(fx.sheets(spark, d).select("page_id", "css"), absolute=True).select("page_id", "grp", "value")


@query("SELECT DISTINCT concat('http://cdn', CAST(page_id % 3 AS VARCHAR), '.test/b.png') AS base FROM pages")
def external_css_refs(spark, d):
    return site.external_css_references(fx.sheets(spark, d), fx.scope(spark), fx.manifest(spark, d)).select("base")


@query("""SELECT page_id, replace(css, concat('url("../img/', CAST(page_id AS VARCHAR), '.png")'), concat('url("../a/', CAST(page_id AS VARCHAR), '.png")')) AS css FROM sheets_v""".replace("SELECT page_id", f"WITH {fx.SHEETS} SELECT page_id", 1))
def css_rewrite(spark, d):
    sheets = fx.sheets(spark, d).withColumn("local_path", F.concat(F.lit("s/"), F.col("page_id").cast("string"), F.lit(".css")))
    i = F.col("page_id").cast("string")
    known = sheets.select(F.concat(F.lit("http://www.example.com/img/"), i, F.lit(".png")).alias("key"), F.concat(F.lit("a/"), i, F.lit(".png")).alias("path"))
    return content.rewrite_css(sheets, known).select("page_id", "css")


@query(f"""WITH {_REFS} SELECT page_id, base, CASE WHEN base LIKE '%/i1.png' OR kind = 'iframe' THEN 'local' WHEN base LIKE 'http://cdn%/i%' THEN 'archive' ELSE 'kept' END AS state,
CASE WHEN base LIKE '%/i1.png' THEN concat('_external/', page_id % 3, '.png') WHEN kind = 'iframe' THEN concat('_external/w', page_id % 4, '.html')
WHEN base LIKE 'http://cdn%/i%' THEN {_FETCH} ELSE base END AS new FROM r""")
def asset_rewrite(spark, d):
    refs = content.extract_references(fx.archived(spark, d).select("page_id", "url", "html", "local_path")).filter(content.is_asset_reference())
    known = fx.pages(spark, d).select(
        F.explode(F.array(
            F.struct(F.concat(F.lit("http://cdn"), (F.col("page_id") % 3).cast("string"), F.lit(".test/i1.png")).alias("key"), F.concat(F.lit("site/_external/"), (F.col("page_id") % 3).cast("string"), F.lit(".png")).alias("path")),
            F.struct(F.concat(F.lit("http://widgets.test/w?id="), (F.col("page_id") % 4).cast("string")).alias("key"), F.concat(F.lit("site/_external/w"), (F.col("page_id") % 4).cast("string"), F.lit(".html")).alias("path")),
        )).alias("e")
    ).select("e.*").distinct()
    base = F.coalesce(urls.unwrap_archive_url(F.col("value")), F.col("value"))
    return site.rewrite_assets(refs, known, from_path=F.col("local_path")).select("page_id", base.alias("base"), "state", "new")


_EXTERNAL = f"""e AS (SELECT base AS original, {_FETCH} AS fetch_url, kind, CASE WHEN base LIKE 'http://cdn%/i%' OR kind = 'iframe' THEN '20130101000000' ELSE '' END AS timestamp,
  'site/_external/' || CASE WHEN kind = 'iframe' THEN 'widgets.test/w/id/' || right(base, 1) || '.html' WHEN base LIKE '%.css?v=%' THEN 'cdn1.test/s.css/v/' || right(base, 1) || '.html' ELSE substr(base, 8) END AS local_path
  FROM (SELECT DISTINCT base, kind FROM r)),
x AS (SELECT original, original AS key, timestamp, CASE WHEN kind = 'iframe' THEN concat('https://web.archive.org/web/20130101000000/', original)
  WHEN timestamp <> '' THEN concat('https://web.archive.org/web/20130101000000id_/', original) ELSE fetch_url END AS wayback_url, local_path, kind FROM e)"""


@query(f"WITH {_REFS}, {_EXTERNAL} SELECT * FROM x")
def external_paths(spark, d):
    refs = site.external_references(fx.archived(spark, d), fx.scope(spark), fx.manifest(spark, d), "page_id")
    return site.external_entries(refs, "site").select("original", "key", "timestamp", "wayback_url", "local_path", "kind")


@query(f"""WITH {fx.MANIFEST}, n AS (SELECT page_id, {BASE} AS base, {_sql_key(BASE)} AS key FROM pages WHERE ends_with('.' || {HOST}, '.example.com') OR ends_with('.' || {HOST}, '.example.net'))
SELECT base, concat('https://web.archive.org/web/20130101000000id_/', base, '#top') AS wayback_url, '20130101000000' AS timestamp, 0 AS wave FROM n WHERE key NOT IN (SELECT key FROM manifest_v)
UNION ALL SELECT 'http://www.example.com/main.css', 'https://web.archive.org/web/id_/http://www.example.com/main.css', '', 0
UNION ALL SELECT DISTINCT concat('http://www.example.com/img/', page_id % 4, '.png'), concat('http://www.example.com/img/', page_id % 4, '.png'), '', 1 FROM pages""")
def discover_inscope(spark, d):
    # Clean pages still name what the manifest lacks; a stylesheet found there names images.
    clean = fx.archived(spark, d).select("local_path", F.concat(F.lit('<link rel="stylesheet" href="http://www.example.com/main.css">'), "html").alias("html"))
    images = fx.pages(spark, d).select((F.col("page_id") % 4).alias("i")).distinct().agg(F.array_join(F.collect_list(F.concat(F.lit("a{background:url(http://www.example.com/img/"), F.col("i").cast("string"), F.lit(".png)}"))), " ").alias("css"))
    archive = images.select(F.lit("http://www.example.com/main.css").alias("key"), F.encode("css", "UTF-8").alias("content"))
    found = site.discover_inscope(clean, fx.scope(spark), fx.manifest(spark, d), archive, "site")
    return found.select(F.col("original").alias("base"), "wayback_url", "timestamp", "wave")


@query(f"WITH {fx.MANIFEST}, {_REFS} SELECT DISTINCT local_path FROM manifest_v JOIN r ON r.page_id = key_seq WHERE base LIKE 'http://cdn0.test/i%'")
def affected_pages(spark, d):
    pages = fx.archived(spark, d)
    refs = site.asset_references(pages.select("local_path", "html")).withColumn("found_in", F.col("local_path"))
    return site.affected_pages(refs, refs.filter("base LIKE 'http://cdn0.test/i%'"), fx.manifest(spark, d)).select("local_path")


def _widgets(spark, d):
    """(key, content) of the widgets and stylesheets that the archived pages load."""
    i = F.col("page_id")
    widget = F.struct(F.concat(F.lit("http://widgets.test/w?id="), (i % 4).cast("string")).alias("key"), F.lit('<img src="http://deep.test/x.png">').alias("text"))
    sheet = F.struct(F.concat(F.lit("http://cdn1.test/s.css?v="), (i % 2).cast("string")).alias("key"), F.lit('p{background:url("b.png")}').alias("text"))
    return fx.pages(spark, d).select(F.explode(F.array(widget, sheet)).alias("e")).distinct().select("e.key", F.encode("e.text", "UTF-8").alias("content"))


@query(f"""WITH {_REFS}, {_EXTERNAL} SELECT original, local_path, kind, timestamp, 0 AS wave FROM x
UNION ALL SELECT 'http://deep.test/x.png', 'site/_external/deep.test/x.png', 'asset', '', 1
UNION ALL SELECT 'http://cdn1.test/b.png', 'site/_external/cdn1.test/b.png', 'asset', '', 1""")
def external_waves(spark, d):
    found = site.discover_external(fx.archived(spark, d), fx.scope(spark), fx.manifest(spark, d), _widgets(spark, d), "site")
    return found.select("original", "local_path", "kind", "timestamp", "wave")


# --- content -------------------------------------------------------------------------


@query("SELECT page_id, 'html' AS media, concat(CAST(page_id AS VARCHAR), '.html') AS path FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'css', concat(CAST(page_id AS VARCHAR), '.css') FROM pages WHERE page_id % 2 = 1")
def detect_media(spark, d):
    rows = fx.pages(spark, d).select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("p"), F.encode(F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.concat(F.lit("/* a */ p{margin:0} "), F.col("url"))), "UTF-8").alias("c"))
    media = content.with_media(rows, "c", "p")
    return media.select("page_id", "media", content.effective_path(F.col("p"), F.col("media")).alias("path"))


_CLEAN_LINKS = f"""l AS (SELECT page_id, value, url, target FROM links_v UNION ALL
  SELECT page_id, concat('https://web.archive.org/web/20130101000000/', {BASE}, '#top'), url, {BASE} || '#top' FROM pages UNION ALL
  SELECT page_id, 'http://outside.test/x', url, 'http://outside.test/x' FROM pages),
k AS (SELECT *, regexp_extract(target, '^https?://([^/?#]*)', 1) AS host, {_sql_key("regexp_replace(target, '#.*$', '')")} AS key, CASE WHEN contains(target, '#') THEN '#top' ELSE '' END AS frag FROM l)"""


@query(f"""WITH {fx.MANIFEST}, {fx.LINKS}, {_CLEAN_LINKS}
SELECT page_id, CASE WHEN path IS NOT NULL THEN substr(path, 6) || frag WHEN ends_with('.' || host, '.example.com') OR ends_with('.' || host, '.example.net') THEN '#' ELSE value END AS value FROM k LEFT JOIN url_map_v USING (key)""")
def clean_pages(spark, d):
    out = site.clean_pages(fx.archived(spark, d), site.build_url_map(fx.manifest(spark, d)), fx.scope(spark), css_href="/style.css", js_href="/script.js")
    return content.extract_links(out.select("page_id", "html")).select("page_id", "value")


@query("SELECT page_id, concat('/style.css|https://web.archive.org/web/20130101000000im_/http://cdn', page_id % 3, '.test/i', page_id % 10, '.png') AS loaded, false AS archived FROM pages")
def clean_page_assets(spark, d):
    out = site.clean_pages(fx.archived(spark, d), site.build_url_map(fx.manifest(spark, d)), fx.scope(spark), css_href="/style.css")
    first = lambda p: F.regexp_extract("html", p, 1)
    loaded = F.concat_ws("|", first('<link rel="stylesheet" href="([^"]*)"'), first('<img src="([^"]*)"'))
    return out.select("page_id", loaded.alias("loaded"), F.contains("html", F.lit('src="/web/')).alias("archived"))


@query("""SELECT page_id, concat('a{b:url("_external/', page_id % 3, '.png")} c{d:url("_external/', page_id % 3, '.png")} e{f:url(gone.png)}') AS style, concat('x:url(&quot;own', page_id, '.png&quot;)') AS attribute FROM pages""")
def clean_styles(spark, d):
    # Styles that name images by absolute and wrapped URLs, and from the host's root.
    i = F.col("page_id").cast("string")
    cdn = F.concat(F.lit("http://cdn"), (F.col("page_id") % 3).cast("string"), F.lit(".test/b.png"))
    style = F.concat(F.lit("<style>a{b:url("), cdn, F.lit(')} c{d:url("/web/20130101000000im_/'), cdn, F.lit('")} e{f:url(gone.png)}</style><p style="x:url(/own'), i, F.lit('.png)">'))
    pages = fx.archived(spark, d).withColumn("html", F.concat(style, "html"))
    root = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    own = F.struct(F.concat(root, F.lit("/own"), i, F.lit(".png")).alias("key"), F.concat(F.lit("site/own"), i, F.lit(".png")).alias("path"))
    shared = F.struct(cdn.alias("key"), F.concat(F.lit("site/_external/"), (F.col("page_id") % 3).cast("string"), F.lit(".png")).alias("path"))
    known = fx.pages(spark, d).select(F.explode(F.array(own, shared)).alias("e")).select("e.*").distinct()
    out = site.clean_pages(pages, known, fx.scope(spark))
    return out.select("page_id", F.regexp_extract("html", "<style>(a[{]b.*?)</style>", 1).alias("style"), F.regexp_extract("html", '<p style="([^"]*)"', 1).alias("attribute"))


_SITE = f"SELECT 'site' AS target, concat('site/', page_id, '.html') AS path, 'html' AS media, {_TITLE} AS title FROM pages"


@query(_SITE)
def clean_site(spark, d):
    raw = fx.archived(spark, d).select("local_path", F.encode("html", "UTF-8").alias("content"))
    return site.clean_site(fx.whole_manifest(spark, d), raw, fx.scope(spark)).select("target", "path", "media", "title")


@query(f"{_MANIFEST_SQL} SELECT target, key FROM c UNION ALL SELECT 'com', concat('http://cdn', i, '.test/i.png') FROM (SELECT DISTINCT page_id % 3 AS i FROM pages)")
def archive_pipeline(spark, d):
    rows, settings = fx.captures(spark, d), fx.EXTERNAL
    html = F.concat("html", F.lit('<img src="http://cdn'), (F.col("page_id") % 3).cast("string"), F.lit('.test/i.png">'))
    archive = fx.pages(spark, d).select(urls.normalize_url(F.col("url"), settings.ignore).alias("key"), F.encode(html, "UTF-8").alias("content"))
    images = fx.pages(spark, d).select(F.concat(F.lit("http://cdn"), (F.col("page_id") % 3).cast("string"), F.lit(".test/i.png")).alias("key"), F.encode(F.lit("GIF\x00"), "UTF-8").alias("content")).distinct()
    archive = archive.unionByName(images).groupBy("key").agg(F.min("content").alias("content"))
    manifest, external, clean = site.archive_pipeline(rows, settings, archive)
    entries = manifest.select("target", "key", "local_path").union(external.select("target", "key", "local_path"))
    return entries.join(clean.select(F.col("path").alias("local_path")), "local_path").select("target", "key")


@query(f"WITH {fx.MANIFEST} SELECT local_path FROM whole_v WHERE key_seq % 3 = 1 AND key_seq % 10 <> 1")
def reclean_affected(spark, d):
    # Images of one server have come; the pages that load them are cleaned again.
    pages = fx.archived(spark, d)
    raw = pages.select("local_path", F.encode("html", "UTF-8").alias("content"))
    clean = pages.select("local_path", "html", F.lit("html").alias("media"))
    obtained = pages.filter("page_id % 10 <> 1").select(F.concat(F.lit("http://cdn1.test/i"), (F.col("page_id") % 10).cast("string"), F.lit(".png")).alias("original")).distinct()
    return site.reclean_affected(clean, obtained, fx.whole_manifest(spark, d), raw, fx.scope(spark)).select(F.col("path").alias("local_path"))


# --- streams -------------------------------------------------------------------------


def _in_files(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` as a stream of at least two batches: a written table, about half its files at a time."""
    spark = rows.sparkSession
    rows.repartition(max(2, rows.rdd.getNumPartitions())).write.parquet(root)
    files = spark.read.parquet(root).select("_metadata.file_path").distinct().count()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(root)


@query(_SITE)
def clean_stream(spark, d):
    root = work_dir(spark, "clean_stream")
    raw = fx.archived(spark, d).select("local_path", F.encode("html", "UTF-8").alias("content"))
    jobs.clean_stream(_in_files(raw, f"{root}/raw"), lambda: fx.whole_manifest(spark, d), fx.scope(spark), f"{root}/clean", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/clean").select("target", "path", "media", "title")


@query("SELECT page_id, concat('s', page_id, '.css') AS href FROM pages")
def clean_stream_links(spark, d):
    # Stylesheets that scripts serve arrive first; pages that load them come in later batches.
    root, i = work_dir(spark, "clean_stream_links"), F.col("page_id").cast("string")
    sheet = F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("/sheet"), i)
    entries = fx.pages(spark, d).select(sheet.alias("original"), F.concat(F.lit("site/s"), i, F.lit(".html")).alias("local_path"), F.lit("site").alias("target"), F.col("page_id").alias("key_seq"))
    manifest = fx.whole_manifest(spark, d).select(entries.columns).union(entries)
    sheets = entries.select("local_path", F.encode(F.lit("p{margin:0}"), "UTF-8").alias("content"))
    html = F.concat("html", F.lit('<link rel="stylesheet" href="/sheet'), i, F.lit('">'))
    for rows in (sheets, fx.archived(spark, d).select("local_path", F.encode(html, "UTF-8").alias("content"))):
        rows.write.mode("append").parquet(f"{root}/raw")
        raw = spark.readStream.schema(rows.schema).parquet(f"{root}/raw")
        jobs.clean_stream(raw, lambda: manifest, fx.scope(spark), f"{root}/clean", f"{root}/state").awaitTermination()
    pages = spark.read.parquet(f"{root}/clean").filter("media = 'html'")
    page_id = F.regexp_extract("path", "site/([0-9]+)[.]html", 1).cast("long")
    return pages.select(page_id.alias("page_id"), F.regexp_extract(F.decode("content", "UTF-8"), '<link rel="stylesheet" href="(s[0-9][^"]*)"', 1).alias("href"))


@query(f"{_MANIFEST_SQL} SELECT target, key, count(*) AS n FROM c GROUP BY ALL")
def merge_stream(spark, d):
    root = work_dir(spark, "merge_stream")
    jobs.merge_stream(_in_files(fx.captures(spark, d), f"{root}/captures"), fx.SETTINGS, f"{root}/manifest", f"{root}/state").awaitTermination()
    return jobs.merged_manifest(spark, f"{root}/manifest").groupBy("target", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.MANIFEST} SELECT target, CASE WHEN key_seq % 6 = 0 THEN 'fail' ELSE 'ok' END AS outcome, count(*) AS n FROM manifest_v GROUP BY ALL")
def progress_stream(spark, d):
    root, name = work_dir(spark, "progress_stream"), f"progress_{uuid.uuid4().hex}"
    log = fx.manifest(spark, d).select("target", F.when(F.col("key_seq") % 6 == 0, F.lit("fail")).otherwise(F.lit("ok")).alias("outcome"))
    jobs.progress_stream(_in_files(log, f"{root}/log"), name, f"{root}/state").awaitTermination()
    return spark.table(name)
