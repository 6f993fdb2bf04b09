"""From captures to a manifest: filters, one snapshot per URL, local paths, merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.work import asked_of, broadcast_if_small, keep, ranked

MATCHES = ("exact", "prefix", "host", "domain")
#: Targets up to which each one is an expression of its own.
MOST_EXPRESSIONS = 32


@dataclass(frozen=True)
class Target:
    """A site to rebuild: which captures belong to it."""

    name: str
    url: str
    match: str = "domain"
    since: str = ""
    until: str = ""
    html_only: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    localize_assets: bool = False

    def __post_init__(self) -> None:
        if self.match not in MATCHES:
            raise ValueError(f"match must be one of {MATCHES}")


@dataclass(frozen=True)
class Settings:
    snapshot: str = "latest"
    ignore: tuple[str, ...] = ()
    external_asset: bool = False
    external_exclude: tuple[str, ...] = ()
    kill_redirects: bool = False
    targets: tuple[Target, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        closest_to(self.snapshot)


def closest_to(strategy: str) -> int | None:
    """The moment of ``closest:<4 to 14 digits>``, filled up to 14; None for the other strategies."""
    if strategy in ("first", "last", "latest"):
        return None
    kind, _, moment = strategy.partition(":")
    if kind != "closest" or not (moment.isdigit() and 4 <= len(moment) <= 14):
        raise ValueError(f"unknown snapshot strategy {strategy!r}")
    return int(moment.ljust(14, "0"))


def snapshot_measure(strategy: str) -> Column:
    """What a snapshot strategy keeps the least of: ``first``, ``last``/``latest`` or
    ``closest:<4 to 14 digits>`` (the distance of the numbers, not of the times)."""
    moment = closest_to(strategy)
    if strategy == "first":
        return F.rpad("timestamp", 14, " ")
    if strategy in ("last", "latest"):
        return -F.rpad("timestamp", 14, "0").cast("decimal(20,0)")
    return F.abs(F.col("timestamp").cast("decimal(20,0)") - F.lit(moment).cast("decimal(20,0)"))


def capture_filter(captures: DataFrame, since: str = "", until: str = "", html_only: bool = True, status: str = "200") -> DataFrame:
    """Captures with the status, of HTML if so wanted, in the window of dates (both ends included).

    The window compares text with bounds padded to 14 digits, so it reaches the scan.
    """
    out = captures.filter(F.col("statuscode") == status)
    if html_only:
        out = out.filter(F.col("mimetype") == "text/html")
    return out.filter(_in_window(since, until))


def _in_window(since: str, until: str) -> Column:
    inside = F.lit(True)
    if since:
        inside = inside & (F.col("timestamp") >= since.ljust(14, "0"))
    return inside & (F.col("timestamp") <= until.ljust(14, "9")) if until else inside


def _bare_key(url: Column) -> Column:
    """The canonical key without its scheme."""
    return F.regexp_replace(urls.normalize_url(url), "^[a-z][a-z0-9+.-]*://", "")


def _matches(host: Column, key: Column, url: str, match: str) -> Column:
    wanted = F.lit(url if "//" in url else f"http://{url}")
    if match in ("host", "domain"):
        base = urls.host_of(wanted)
        return host == base if match == "host" else urls.host_in_scope(host, base)
    return key == _bare_key(wanted) if match == "exact" else F.startswith(key, _bare_key(wanted))


def matches(original: Column, url: str, match: str) -> Column:
    """Whether a capture belongs to a URL: exactly, as a prefix, by its host, or by its domain."""
    return _matches(urls.host_of(original), _bare_key(original), url, match)


def site_key(host: Column) -> Column:
    """A host's labels from the last one on, with a dot behind each: those of a domain begin alike."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def _pruned(captures: DataFrame, targets: tuple[Target, ...]) -> DataFrame:
    """What no target can want dropped by plain comparisons of columns, which reach the scan: status,
    type, the dates that all windows lie in and, where captures have a ``site`` (see
    :func:`arkloom.sources.tables.write_captures`), the domains."""
    rows = captures.filter("statuscode = '200'")
    if all(t.html_only for t in targets):
        rows = rows.filter("mimetype = 'text/html'")
    rows = rows.filter(_in_window(min((t.since for t in targets), default=""), "" if any(not t.until for t in targets) else max((t.until.ljust(14, "9") for t in targets), default="")))
    if "site" in captures.columns and 0 < len(targets) <= MOST_EXPRESSIONS:
        ends = [(".".join(_plain_host(t.url).split(".")[::-1]) + ".", t.match == "domain") for t in targets]
        wanted = F.lit(False)
        for end, below in ends:
            wanted = wanted | (F.startswith("site", F.lit(end)) if below else F.col("site") == end)
        rows = rows.filter(wanted)
    return rows


def _plain_host(url: str) -> str:
    """The clean host of a target's URL, as :func:`arkloom.functions.urls.host_of` gives it."""
    host = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip(), flags=re.I)
    host = re.split("[/?#]", host)[0].strip().lower()
    return re.sub(r":(80|443)$", "", host).removesuffix(".")


def of_targets(captures: DataFrame, targets: tuple[Target, ...]) -> DataFrame:
    """The captures that belong to targets, with ``target`` and ``target_ord``, once for each target
    that they belong to. The captures are gone through once for all targets.

    A few targets are one expression each; more than ``MOST_EXPRESSIONS`` are a table that captures
    are joined with, see :func:`_joined`.
    """
    if not targets:
        return captures.limit(0).withColumns({"target_ord": F.lit(0), "target": F.lit("")})
    rows = urls.settled(_pruned(captures, targets), _host=urls.host_of(F.col("original")))
    by_key = any(t.match in ("exact", "prefix") for t in targets)
    rows = urls.settled(rows, _key=_bare_key(F.col("original"))) if by_key else rows.withColumn("_key", F.lit(None).cast("string"))
    if len(targets) > MOST_EXPRESSIONS:
        return _joined(rows, targets).drop("_host", "_key")
    of = []
    for n, t in enumerate(targets):
        own = _matches(F.col("_host"), F.col("_key"), t.url, t.match) & _wanted(t.include, t.exclude) & _in_window(t.since, t.until)
        of.append(F.when(own & (F.col("mimetype") == "text/html") if t.html_only else own, F.lit(n)))
    names = F.array(*[F.lit(t.name) for t in targets])
    rows = rows.withColumn("target_ord", F.explode(F.array_compact(F.array(*of))))
    return rows.withColumn("target", F.get(names, F.col("target_ord"))).drop("_host", "_key")


def _joined(rows: DataFrame, targets: tuple[Target, ...]) -> DataFrame:
    """``rows`` (_host, _key ...) joined with the targets by equality, whatever their number.

    A capture is looked up by its host, by its host's domains above, by its bare key, and by
    the beginnings of this that are as long as some target's prefix; each only if there are
    such targets. Windows and patterns are columns of the targets' table.
    """
    spark = rows.sparkSession
    fields = "target_ord int, target string, url string, match string, since string, until string, html_only boolean, include array<string>, exclude array<string>"
    listed = [(n, t.name, t.url if "//" in t.url else f"http://{t.url}", t.match, t.since.ljust(14, "0") if t.since else "", t.until.ljust(14, "9") if t.until else "", t.html_only, list(t.include), list(t.exclude)) for n, t in enumerate(targets)]
    table = spark.createDataFrame(listed, fields)
    sought = F.when(F.col("match").isin("host", "domain"), urls.host_of(F.col("url"))).otherwise(_bare_key(F.col("url")))
    table = keep(table.withColumn("_sought", F.concat("match", F.lit(" "), sought)).withColumnsRenamed({"html_only": "_html", "since": "_since", "until": "_until", "include": "_include", "exclude": "_exclude"}).drop("url"), "targets")
    kinds = {t.match for t in targets}
    asked = []
    if "host" in kinds:
        asked.append(F.array(F.concat(F.lit("host "), "_host")))
    if "domain" in kinds:
        asked.append(F.transform(urls.host_suffixes(F.col("_host")), lambda h: F.concat(F.lit("domain "), h)))
    if "exact" in kinds:
        asked.append(F.array(F.concat(F.lit("exact "), "_key")))
    if "prefix" in kinds:
        sizes = [r["n"] for r in table.filter("match = 'prefix'").select((F.char_length("_sought") - 7).alias("n")).distinct().collect()]  # lengths of URLs
        fitting = F.filter(F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: n <= F.char_length("_key"))
        asked.append(F.transform(fitting, lambda n: F.concat(F.lit("prefix "), F.substring(F.col("_key"), F.lit(1), n))))
    sought = rows.withColumn("_sought", F.explode(F.array_compact(F.concat(*asked))))
    found = sought.join(broadcast_if_small(table.drop("match")), "_sought")
    within = ((F.col("_since") == "") | (F.col("timestamp") >= F.col("_since"))) & ((F.col("_until") == "") | (F.col("timestamp") <= F.col("_until")))
    finds = lambda patterns: F.exists(patterns, lambda p: F.regexp_like("original", p))
    wanted = within & (~F.col("_html") | (F.col("mimetype") == "text/html")) & ((F.size("_include") == 0) | finds("_include")) & ~finds("_exclude")
    return found.filter(wanted).drop("_sought", "_since", "_until", "_html", "_include", "_exclude")


def _wanted(include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    found = F.lit(not include)
    for p in include:
        found = found | F.col("original").rlike(p)
    for p in exclude:
        found = found & ~F.col("original").rlike(p)
    return found


def include_exclude(captures: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``original`` one of ``include`` finds (all if there is none) and none of ``exclude``."""
    return captures.filter(_wanted(include, exclude))


def select_snapshot(captures: DataFrame, strategy: str, by: tuple[str, ...] = ("target", "urlkey"), order: str = "seq", first: str = "grp_seq") -> DataFrame:
    """One row per group: the snapshot that the strategy wants, ties to the smallest ``order``.

    ``first`` is the group's smallest ``order``. Minima are combined before the shuffle, so a
    URL captured very often is no burden.
    """
    rest = [c for c in captures.columns if c not in by]
    rows = captures.withColumn("_m", snapshot_measure(strategy))
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("_m", order)).alias("_best"), F.min(order).alias("_first"))
    return best.select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest], F.col("_first").alias(first))


def collapse_canonical(snapshots: DataFrame, strategy: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The second pass, over the survivors of the first: one row per canonical key and target."""
    keyed = urls.settled(snapshots, key=urls.normalize_url(F.col("original"), ignore))
    return select_snapshot(keyed, strategy, by=("target", "key"), order="grp_seq", first="key_seq")


def directory_stems(paths: DataFrame) -> DataFrame:
    """(prefix, stem_key): the stems that other paths lie below, or that have queries or end in /."""
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size("stem") - 1, F.lit(1))), lambda i: F.array_join(F.slice("stem", 1, i), "/"))
    above = F.when(F.size("stem") > 1, above).otherwise(F.array().cast("array<string>"))
    own = F.when((F.size("query_parts") > 0) | F.col("slash"), F.array(F.array_join("stem", "/"))).otherwise(F.array().cast("array<string>"))
    return paths.select("prefix", F.explode(F.concat(above, own)).alias("stem_key")).distinct()


def with_path_parts(rows: DataFrame, original: str = "original", ignore: tuple[str, ...] = ()) -> DataFrame:
    base = urls.without_fragment(F.col(original))
    path = F.regexp_replace(F.regexp_extract(base, urls.PARTS, 4), ";[^/]*$", "")
    query = F.regexp_replace(urls.filter_query(F.regexp_extract(base, urls.PARTS, 6), ignore), r"^\?+", "")
    return rows.withColumns({"stem": urls.stem_segments(urls.percent_decoded(path)), "query_parts": urls.query_segments(query), "slash": F.endswith(path, F.lit("/")) & (path != "/")})


def _numbered(path: Column, n: Column) -> Column:
    html = F.endswith(path, F.lit(".html"))
    stem = F.when(html, F.substring(path, F.lit(1), F.char_length(path) - 5)).otherwise(path)
    return F.when(n <= 1, path).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), F.when(html, F.lit(".html")).otherwise(F.lit(""))))


def _parent(path: Column) -> tuple[Column, Column]:
    """The path that a name would be made from and its number, null where it is made from none:
    a_2.html from a.html, a.png_2 from a.png."""
    form = r"^(.+)_([1-9][0-9]{0,17})([.]html)?$"
    stem, number, html = (F.regexp_extract(path, form, k) for k in (1, 2, 3))
    made = (number != "") & ((number != "1")) & ((html != "") | ~F.endswith(stem, F.lit(".html")))
    return F.when(made, F.concat(stem, html)), F.when(made, number.try_cast("long"))


def _tangled(names: DataFrame, contested: DataFrame, by: tuple[str, ...], path: str) -> DataFrame | None:
    """(by, path) of the names that the numbering of contested ones may meet, and of what meets
    them; None if nothing does.

    A path that k rows claim in vain gives at most the numbers up to k + 1 and as many more as
    there are names with a number of it. A name so met may be displaced and be numbered in
    turn, so its own numbers are looked for next; names get longer each time.
    """
    parent, number = _parent(F.col(path))
    children = names.select(*by, path, "n", parent.alias("_parent"), number.alias("_number")).filter("_parent IS NOT NULL")
    claims = contested.select(*by, F.col(path).alias("_parent"), F.col("claims"))
    found = None
    while True:
        own = children.join(broadcast_if_small(claims), [*by, "_parent"])
        many = own.groupBy(*by, "_parent").agg(F.count(F.lit(1)).alias("_many"))
        met = keep(own.join(many, [*by, "_parent"]).filter("_number <= claims + 1 + _many").select(*by, path, "n", "_parent"), "met_names")
        if met.isEmpty():
            return found
        new = met.select(*by, path).union(met.select(*by, "_parent")).distinct()
        found = keep(new if found is None else found.union(new).distinct(), "tangled")
        claims = keep(met.filter("n > 0").select(*by, F.col(path).alias("_parent"), F.col("n").alias("claims")), "displaced")


def dedupe_paths(rows: DataFrame, order: str, path: str = "path", by: tuple[str, ...] = ("prefix",), used: DataFrame | None = None) -> DataFrame:
    """``rows`` with their ``path`` made unique in ``order`` (a whole number): a taken one gets _2,
    _3 ... before ``.html`` or at its end, skipping what is taken by then. ``used`` (by, path)
    holds paths that are taken already. ``by`` and ``path`` are not null.

    1. Paths that one row has and ``used`` has not stay as they are; one aggregate tells them.
    2. Where no other name ends in a number that the numbering of a path comes to, the place
       among the rows with this path is the number. Places are counted in parts, so a path of
       very many rows is no burden.
    3. What is left, the rows of paths whose numbers meet other names and of these names, is
       numbered in waves by :func:`_wave`; only paths and places are sent there.
    """
    keys = [*by, path]
    claimed = rows.select(*keys, F.lit(1).alias("n"), F.lit(False).alias("used"))
    if used is not None:
        # Names of other families than the rows' ones can't be met.
        family = F.regexp_replace(F.regexp_replace(F.col(path), "[.]html$", ""), r"(_\d+)+$", "")
        used = asked_of(used.select(*keys, family.alias("_family")), rows.select(*by, family.alias("_family")), [*by, "_family"], "families")
        claimed = claimed.union(used.select(*keys).distinct().select(*keys, F.lit(0), F.lit(True)))
    names = claimed.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("used").alias("used"))
    contested = keep(names.filter("n > 0 AND (n > 1 OR used)").withColumn("claims", F.col("n") - 1 + F.col("used").cast("int")), "contested")
    if contested.isEmpty():
        return rows
    tangled = _tangled(names, contested, by, path)
    settle = contested.select(*keys, "used", F.lit(False).alias("_tangled"))
    if tangled is not None:
        tangled = names.join(broadcast_if_small(tangled), keys, "left_semi").select(*keys, "used", F.lit(True).alias("_tangled"))
        settle = keep(settle.union(tangled).groupBy(*keys).agg(F.max("used").alias("used"), F.max("_tangled").alias("_tangled")), "settle")
    flags = broadcast_if_small(settle.select(*keys, F.col("used").alias("_used"), "_tangled"))
    places = ranked(rows.join(flags, keys), keys, [order])
    free = places.filter("NOT _tangled").withColumn(path, _numbered(F.col(path), F.col("_rank") + F.col("_used").cast("int")))
    out = rows.join(broadcast_if_small(settle.select(*keys)), keys, "left_anti").select(rows.columns).unionByName(free.select(rows.columns))
    if tangled is None:
        return out

    hard = keep(places.filter("_tangled").select(*keys, F.col("_rank"), F.col(order).cast("long").alias("_at")), "tangled_rows")
    first = hard.filter("_rank = 1").select(*keys, "_at")
    parent, number = _parent(F.col(path))
    waiting = settle.filter("_tangled").select(*keys, "used").join(first, keys, "left").withColumns({"_parent": parent, "_number": number})
    waiting = keep(waiting, "tangled_names")
    above = waiting.select(*by, F.col(path).alias("_parent"))
    now = waiting.join(above, [*by, "_parent"], "left_anti").select(*keys, F.col("used").alias("taken"))
    found = None
    while True:
        named, now = _wave(keep(now, "wave"), hard, waiting, by, path)
        found = named if found is None else found.union(named)
        if now.isEmpty():
            break
    walked = places.filter("_tangled").join(found, [*keys, "_rank"]).withColumn(path, F.col("_new"))
    return out.unionByName(walked.select(rows.columns))


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the names that paths' numbering may meet (by, path, number, before, rows, ...) in
    order, with one count as its state: how many numbers of the path are passed over so far.
    Adds that count and whether the name is passed over (2), given away (1) or not come to (0)."""
    group, passed = None, 0
    for batch in batches:
        *keys, number, before, rows = (batch.column(c).to_pylist() for c in range(batch.num_columns))
        counts, states = [], []
        for *key, n, b, m in zip(*keys, number, before, rows):
            if key != group:
                group, passed = key, 0
            place = n - 1 - passed  # of the row that comes to this number
            states.append(0 if place > m else 2 if place > b else 1)
            passed += states[-1] == 2
            counts.append(passed)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(states, pa.int32())], names=[*batch.schema.names, "passed", "state"])


def _wave(now: DataFrame, hard: DataFrame, waiting: DataFrame, by: tuple[str, ...], path: str) -> tuple[DataFrame, DataFrame]:
    """The new names (keys, _rank, _new) of the rows of names ``now`` (keys, taken), and the names that
    come next: those with a number of theirs, each with whether it is taken before its own rows come.

    The j-th row that finds its path taken comes to the smallest number that no row before it
    has come to and that is free at its time. A name with such a number is passed over if its
    own first row stands before, else it is given away. Which ones are is told by one pass
    over them in order; the numbers are then the rows' places among rows and passed names,
    counted in parts. So neither a path of many rows nor one with many numbered names is a
    group in memory.
    """
    keys = [*by, path]
    rows = hard.join(now, keys).withColumn("_j", F.col("_rank") - F.when(F.col("taken"), F.lit(0)).otherwise(F.lit(1)))
    rows = keep(rows.select(*keys, "_rank", "_at", "_j"), "wave_rows")
    late = rows.filter("_j > 0")
    to_parent = [*by, F.col("_parent").alias(path)]
    met = waiting.join(now.select(*by, F.col(path).alias("_parent")), [*by, "_parent"])
    met = keep(met.select(*to_parent, F.col(path).alias("_name"), "_number", "used", "_at"), "wave_names")
    # How many late rows stand before a name's first own row: its place among both kinds less that among names.
    timed = met.filter("NOT used")
    both = late.select(*keys, "_at", F.col(path).alias("_name"), F.lit(False).alias("met")).union(timed.select(*keys, "_at", "_name", F.lit(True)))
    among = ranked(both, keys, ["_at", "_name"], "_all").filter("met").select(*keys, "_name", "_all")
    before = ranked(timed.select(*keys, "_at", "_name"), keys, ["_at", "_name"], "_own").join(among, [*keys, "_name"])
    before = before.select(*keys, "_name", (F.col("_all") - F.col("_own")).alias("_before"))
    many = late.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    asked = met.join(before, [*keys, "_name"], "left").join(many, keys, "left")
    asked = asked.select(*keys, F.col("_number"), F.coalesce("_before", F.lit(0)).cast("long").alias("_before"), F.coalesce("_rows", F.lit(0)).cast("long").alias("_rows"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in asked.dtypes)
    told = keep(asked.repartition(*keys).sortWithinPartitions(*keys, "_number").mapInArrow(_passed, f"{kinds}, passed long, state int"), "wave_states")
    # The i-th passed number s stands behind s - i rows; so a row's place among both is its number less 1.
    marks = told.filter("state = 2").select(*keys, F.lit(None).cast("long").alias("_rank"), (F.col("_number") - F.col("passed")).alias("_pos"), F.lit(0).alias("row"))
    mixed = late.select(*keys, F.col("_rank").cast("long").alias("_rank"), F.col("_j").cast("long").alias("_pos"), F.lit(1).alias("row")).union(marks)
    numbered = ranked(mixed, keys, ["_pos", "row"], "_n").filter("row = 1")
    named = numbered.select(*keys, "_rank", _numbered(F.col(path), F.col("_n") + 1).alias("_new"))
    named = named.union(rows.filter("_j = 0").select(*keys, F.col("_rank").cast("long"), F.col(path).alias("_new")))
    states = told.select(*keys, "_number", "state")
    following = met.join(states, [*keys, "_number"]).select(*by, F.col("_name").alias(path), (F.col("used") | (F.col("state") == 1)).alias("taken"))
    return keep(named, "wave_named"), following


def assign_local_paths(rows: DataFrame, order: str, ignore: tuple[str, ...] = (), used: DataFrame | None = None) -> DataFrame:
    """``rows`` (prefix, original) with ``local_path``, unique within a prefix. They are read twice, and
    written with the paths that are to be made unique.

    A query becomes folders below the stem; a URL with others below it, or with a slash at its
    end, becomes an index; assets keep their names, pages get ``.html``.
    """
    parts = with_path_parts(rows, ignore=ignore).withColumn("stem_key", F.array_join("stem", "/"))
    folders = directory_stems(parts).withColumn("folder", F.lit(True))
    joined = parts.join(folders, ["prefix", "stem_key"], "left")
    last = F.element_at("stem", -1)
    path = (
        F.when(F.size("query_parts") > 0, F.concat(F.array_join(F.concat("stem", "query_parts"), "/"), F.lit(".html")))
        .when(F.size("stem") == 0, F.lit("index.html"))
        .when(F.col("folder"), F.concat("stem_key", F.lit("/index.html")))
        .when(urls.has_asset_extension(last), F.col("stem_key"))
        .otherwise(F.concat("stem_key", F.lit(".html")))
    )
    named = joined.withColumn("local_path", F.when(F.col("prefix") != "", F.concat("prefix", F.lit("/"), path)).otherwise(path))
    named = named.drop("stem", "query_parts", "slash", "stem_key", "folder")
    return dedupe_paths(keep(named, "named_paths"), order, "local_path", ("prefix",), used)


def url_snapshots(captures: DataFrame, settings: Settings) -> DataFrame:
    """One capture per target and URL, with ``grp_seq``: the first of the two choices."""
    return select_snapshot(of_targets(captures, settings.targets).select("target", "target_ord", "urlkey", "original", "timestamp", "seq"), settings.snapshot)


def page_snapshots(captures: DataFrame, settings: Settings) -> DataFrame:
    """One capture per page of the targets, as it was chosen: what a manifest has but for its paths."""
    return collapsed(url_snapshots(captures, settings), settings)


def collapsed(snapshots: DataFrame, settings: Settings) -> DataFrame:
    """One capture per page of :func:`url_snapshots`: the second of the two choices."""
    one = collapse_canonical(snapshots, settings.snapshot, settings.ignore)
    return one.select("original", "key", "timestamp", "target", "target_ord", "key_seq")


def build_manifest(captures: DataFrame, settings: Settings) -> DataFrame:
    """One row per page of the targets: original, key, timestamp, wayback_url, local_path, target,
    and ``target_ord`` and ``key_seq`` to order them by.

    The captures are gone through once; the chosen ones, a narrow row per page, are written,
    and paths are made from these.
    """
    return with_local_paths(page_snapshots(captures, settings), settings)


def with_local_paths(snapshots: DataFrame, settings: Settings) -> DataFrame:
    """The manifest of chosen captures (see :func:`page_snapshots`), which are written."""
    one = keep(snapshots, "page_snapshots")
    paths = assign_local_paths(one.withColumn("prefix", F.col("target")), "key_seq", settings.ignore)
    return paths.select("original", "key", "timestamp", urls.capture_url(F.col("timestamp"), F.col("original")).alias("wayback_url"), "local_path", "target", "target_ord", "key_seq")


def limit_urls(manifest: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, targets in their order and keys ascending (a top-k, not a sort)."""
    return manifest.orderBy("target_ord", "target", "key").limit(n)


def new_entries(existing: DataFrame, new: DataFrame, ignore: tuple[str, ...] = (), taken: DataFrame | None = None) -> DataFrame:
    """Those of ``new`` (original, timestamp, target, local_path, key_seq ...) whose key ``existing``
    lacks, the first of each key (by target_ord where there is one, key_seq and target); their
    paths give way to existing ones, or to those of ``taken`` (local_path)."""
    key = urls.normalize_url(F.col("original"), ignore)
    known = existing.select(key.alias("key")).distinct()
    fresh = urls.settled(new, key=key).join(known, "key", "left_anti")
    order = [c for c in ("target_ord", "key_seq", "target", "original", "local_path") if c in fresh.columns]
    rest = [c for c in fresh.columns if c != "key"]
    one = fresh.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e")).select("key", "_e.*").select(fresh.columns)
    taken = (existing if taken is None else taken).select(F.lit(1).alias("_all"), "local_path")
    return dedupe_paths(keep(one.withColumn("_all", F.lit(1)), "fresh_entries"), "key_seq", "local_path", ("_all",), taken).drop("_all")


def merge_manifest(existing: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``existing``, whose rows stay as they are, and its :func:`new_entries`."""
    return existing.unionByName(new_entries(existing, new, ignore), allowMissingColumns=True)


def remap_manifest(manifest: DataFrame, ignore: tuple[str, ...] = (), order: str = "key_seq") -> DataFrame:
    """Keys and paths anew from the originals, without reading any source."""
    keyed = manifest.withColumns({"key": urls.normalize_url(F.col("original"), ignore), "prefix": F.col("target")}).drop("local_path")
    return assign_local_paths(keyed, order, ignore).drop("prefix")
