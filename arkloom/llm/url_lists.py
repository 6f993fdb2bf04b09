"""URL filters from dated lists: validity intervals and an as-of join.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep

#: Intervals are broadcast up to this number (about 100 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
#: Intervals of a key from which on captures meet only those of their own slice of time, and slices.
HISTORY, SLICES = 64, 1024
#: After the end of any list.
FOREVER = 1 << 62


def host_of(url: Column) -> Column:
    """The host of a URL, in lower case and without user and port; null if it has none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def plain_url(url: Column) -> Column:
    """The URL without scheme, fragment and trailing slashes: what lists name pages by."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "/+$", "")


def keys_of(url: Column) -> Column:
    """What an entry may name a capture by: its plain URL, its host, and every parent domain
    of two labels or more."""
    labels = F.split(host_of(url), "[.]")
    depth = F.size(labels)
    starts = F.when(depth >= 2, F.sequence(F.lit(1), depth - 1)).otherwise(F.array(F.lit(1)))
    domains = F.transform(starts, lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, depth), ".")))
    url_key = F.array(F.concat(F.lit("url:"), plain_url(url)))
    return F.when(host_of(url).isNull(), F.when(url.isNotNull(), url_key).otherwise(F.array().cast("array<string>"))).otherwise(F.array_distinct(F.concat(url_key, domains)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from dated entries (list, key, action, at).

    An entry ``add`` opens an interval and ``remove`` closes it at the next entry's time;
    intervals hold ``since`` and not ``until``. Of entries at one time, ``remove`` wins.
    A second ``add`` in a row only starts a new interval where the last one ends. Entries
    with a null in any column are left out; repeated entries are one.
    """
    known = entries.select("list", "key", "action", "at").filter("list IS NOT NULL AND key IS NOT NULL AND action IN ('add', 'remove') AND at IS NOT NULL")
    one = known.groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    after = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return one.withColumn("until", F.coalesce(after, F.lit(FOREVER))).filter("action = 'add'").select("list", "key", F.col("at").alias("since"), "until")


def _of_long_histories(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """(url, at, list) of the captures and the intervals at their time, of keys that have so many that
    a capture must not meet all of them: both are dealt to slices of time first. An interval
    goes to each slice that it reaches, in all to no more than there are intervals and slices."""
    times = keyed.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = (times["lo"] or 0), (times["hi"] or 0)
    slice_of = lambda at: F.floor((at - F.lit(lo)) / F.lit((hi - lo) // SLICES + 1)).cast("int")
    first, last = F.greatest("since", F.lit(lo)), F.least(F.col("until") - 1, F.lit(hi))
    sliced = spans.filter(first <= last).withColumn("slice", F.explode(F.sequence(slice_of(first), slice_of(last))))
    sliced = broadcast_if_small(keep(sliced, "sliced_intervals"), BROADCAST_ROWS)
    own = keyed.withColumn("own", slice_of(F.col("at")))
    same = (own["key"] == sliced["of"]) & (own["own"] == sliced["slice"])
    return own.join(sliced, same & (sliced["since"] <= own["at"]) & (own["at"] < sliced["until"])).select("url", "at", "list")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``n_active`` (entries active when each was fetched), ``lists`` (their lists,
    sorted) and ``blocked`` (whether there is any), all columns kept.

    The as-of join is an equality on the key and an interval test on the time: the intervals
    of one key in one list do not overlap, so a capture meets one entry of a list and key at
    most. Captures of a common host meet the host's few entries; Spark may split such a key,
    as nothing is grouped by it. Of a key with more than ``HISTORY`` intervals they meet those
    of their slice of time only. What was found is counted per distinct (url, time).

    A null url has no keys and a null time meets no interval: such captures are not blocked.
    Repeated captures get equal results; columns of ``captures`` that are named like the three
    new ones give way to them. Without entries nothing is blocked; without captures
    there are no rows.
    """
    asked = captures.select(F.col(url_col).alias("url"), F.col(time_col).alias("at")).filter("url IS NOT NULL AND at IS NOT NULL").distinct()
    keyed = asked.select("url", "at", F.explode(keys_of(F.col("url"))).alias("key"))
    spans = intervals(entries).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    spans = keep(spans.withColumnsRenamed({"key": "of", "n": "history"}), "intervals")
    now = (spans["since"] <= keyed["at"]) & (keyed["at"] < spans["until"])
    active = keyed.join(broadcast_if_small(spans.filter(F.col("history") <= HISTORY), BROADCAST_ROWS), (keyed["key"] == spans["of"]) & now).select("url", "at", "list")
    long = spans.filter(F.col("history") > HISTORY)
    if not long.isEmpty():
        active = active.unionByName(_of_long_histories(keyed, long))
    found = active.groupBy("url", "at").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("list")).alias("names"))
    kept = [c for c in captures.columns if c.lower() not in ("n_active", "lists", "blocked")]
    c, f = captures.alias("captures_"), found.alias("found_")
    joined = c.join(f, (F.col(f"captures_.`{url_col}`") == F.col("found_.url")) & (F.col(f"captures_.`{time_col}`") == F.col("found_.at")), "left")
    return joined.select(
        *[F.col(f"captures_.`{x}`") for x in kept],
        F.coalesce("found_.n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("found_.names", F.array().cast("array<string>")).alias("lists"),
        F.col("found_.n").isNotNull().alias("blocked"),
    )


def fetch_times(pages: DataFrame) -> DataFrame:
    """``pages`` as captures: each at a minute of a year that its id sets."""
    return pages.select("page_id", "url", (F.pmod(F.col("page_id") * 7919, F.lit(525_600))).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that the pages themselves set: of every host on one list and every domain
    on another, added, removed and added again, and of every seventh page's own URL."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).filter("h IS NOT NULL").distinct()
    domains = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("d")).filter("d <> ''").distinct()
    day = lambda c, k: F.conv(F.substring(F.md5(F.concat(F.lit(k), c)), 1, 6), 16, 10).cast("long") % 525_600
    row = lambda name, key, action, at: F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), at.alias("at"))
    h, d, u = F.concat(F.lit("host:"), F.col("h")), F.concat(F.lit("host:"), F.col("d")), F.concat(F.lit("url:"), plain_url(F.col("url")))
    of_hosts = hosts.select(F.explode(F.array(row("malware", h, "add", day(F.col("h"), "a")), row("malware", h, "remove", day(F.col("h"), "b")), row("malware", h, "add", day(F.col("h"), "c")))).alias("e"))
    of_domains = domains.select(F.explode(F.array(row("adult", d, "add", day(F.col("d"), "d")), row("adult", d, "remove", day(F.col("d"), "d") + 40_000))).alias("e"))
    own = pages.filter("page_id % 7 = 0 AND url IS NOT NULL").select(F.explode(F.array(row("takedown", u, "add", F.pmod(F.col("page_id") * 104_729, F.lit(525_600))))).alias("e"))
    return of_hosts.unionByName(of_domains).unionByName(own).select("e.*")


def op4(pages: DataFrame) -> DataFrame:
    out = evaluate(fetch_times(pages), sample_entries(pages))
    return out.select("page_id", "url", "fetched_at", "n_active", F.array_join("lists", ",").alias("lists"), "blocked")


SQL = r"""
WITH cap AS (
  SELECT page_id, url, (page_id * 7919) % 525600 AS fetched_at,
         regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS h,
         regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/+$', '') AS plain
  FROM pages),
hosts AS (SELECT DISTINCT h FROM cap WHERE h <> ''),
domains AS (SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS d FROM hosts),
entries AS (
  SELECT 'malware' AS list, 'host:' || h AS key, v.action, CAST('0x' || substr(md5(v.k || h), 1, 6) AS BIGINT) % 525600 AS t
  FROM hosts CROSS JOIN (VALUES ('add', 'a'), ('remove', 'b'), ('add', 'c')) AS v(action, k)
  UNION ALL
  SELECT 'adult', 'host:' || d, v.action, CAST('0x' || substr(md5('d' || d), 1, 6) AS BIGINT) % 525600 + v.later
  FROM domains CROSS JOIN (VALUES ('add', 0), ('remove', 40000)) AS v(action, later) WHERE d <> ''
  UNION ALL
  SELECT 'takedown', 'url:' || plain, 'add', (page_id * 104729) % 525600 FROM cap WHERE page_id % 7 = 0),
one AS (SELECT list, key, t, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY list, key ORDER BY t), 4611686018427387904) AS t_end FROM one),
keyed AS (
  SELECT DISTINCT url, fetched_at, 'url:' || plain AS key FROM cap
  UNION SELECT DISTINCT url, fetched_at, 'host:' || array_to_string(string_split(h, '.')[i:], '.')
  FROM (SELECT *, unnest(range(1, len(string_split(h, '.')))) AS i FROM cap WHERE h <> '')),
found AS (
  SELECT url, fetched_at, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM keyed JOIN spans USING (key) WHERE action = 'add' AND t <= fetched_at AND fetched_at < t_end GROUP BY ALL)
SELECT page_id, cap.url, cap.fetched_at, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM cap LEFT JOIN found ON found.url = cap.url AND found.fetched_at = cap.fetched_at
"""
