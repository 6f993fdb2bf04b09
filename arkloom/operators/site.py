"""Jobs over a manifest and stored content: links, progress, discovery, the clean site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.operators import captures, content
from arkloom.work import asked_of, keep, ranked

# The most waves of a discovery, and the names of a site's own style and script.
MOST_WAVES = 5
STYLE_FILE, SCRIPT_FILE = "_style.css", "_site.js"


def build_url_map(main: DataFrame, external: DataFrame | None = None, raw: DataFrame | None = None, ignore: tuple[str, ...] = (), path: str = "local_path", order: str = "key_seq") -> DataFrame:
    """(key, path): the last entry of a key wins (by target_ord where there is one, ``order`` and
    target), external ones over all others; they count only where their bytes are there."""
    key = urls.normalize_url(F.col("original"), ignore)

    def entries(df: DataFrame, src: int) -> DataFrame:
        at = [F.col(c) for c in ("target_ord", order, "target") if c in df.columns]
        at = [F.lit(0).alias("target_ord"), *at] if "target_ord" not in df.columns else at
        at = at if "target" in df.columns else [*at, F.lit("").alias("target")]
        return df.select(key.alias("key"), F.col(path).alias("path"), F.struct(F.lit(src).alias("src"), *at, F.col(path).alias("last")).alias("o"))

    rows = entries(main, 0)
    if external is not None:
        there = external if raw is None else external.join(raw.select("local_path"), "local_path", "left_semi")
        rows = rows.unionByName(entries(there, 1))
    return rows.groupBy("key").agg(F.max_by("path", "o").alias("path"))


def in_scope(rows: DataFrame, scope: DataFrame, host: str = "host", keep: bool = True, most: int = 10_000) -> DataFrame:
    """Rows whose host is (or is not, without ``keep``) one of ``scope`` (host) or below it.

    Each host's domains above are joined by equality, so a large scope is no product; one of
    at most ``most`` hosts is broadcast.
    """
    hosts = scope.select(urls.clean_host(F.col("host")).alias("_scope")).distinct()
    small = F.broadcast(hosts) if hosts.limit(most + 1).count() <= most else hosts
    found = rows.select(F.col(host).alias("_host")).distinct().withColumn("_scope", F.explode(urls.host_suffixes(F.col("_host")))).join(small, "_scope", "left_semi").select("_host").distinct()
    return rows.join(found, F.col(host) == F.col("_host"), "left_semi" if keep else "left_anti")


def resolved_links(pages: DataFrame, url: str = "url", html: str = "html", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Links with ``target`` (absolute, with fragment), ``base``, ``key`` and ``host``."""
    return _resolved(content.extract_links(pages, html), url, ignore)


def _resolved(links: DataFrame, url: str, ignore: tuple[str, ...]) -> DataFrame:
    links = urls.settled(links, target=urls.resolve_href(F.col("value"), F.col(url))).filter("target IS NOT NULL")
    base = urls.without_fragment(F.col("target"))
    return urls.settled(links, base=base, key=urls.normalize_url(base, ignore), host=urls.host_of(base))


def classify_links(links: DataFrame, url_map: DataFrame, scope: DataFrame, from_path: Column | None = None) -> DataFrame:
    """``links`` with ``state``, ``path`` of a local target and, given ``from_path``, ``new_href``.

    Local links lead to a mapped key; dead ones lead into the scope but to nothing there is;
    all others are external and stay as they are.
    """
    mapped = links.join(url_map, "key", "left")
    hosts = in_scope(links.select("host").distinct(), scope).withColumn("_in", F.lit(True))
    out = mapped.join(hosts, "host", "left")
    out = out.withColumn("state", F.when(F.col("path").isNotNull(), F.lit("local")).when(F.col("_in"), F.lit("dead")).otherwise(F.lit("external"))).drop("_in")
    if from_path is None:
        return out
    href = F.when(F.col("state") == "local", F.concat(urls.relative_path(from_path, F.col("path")), urls.fragment(F.col("target")))).when(F.col("state") == "dead", F.lit("#")).otherwise(F.col("value"))
    return out.withColumn("new_href", href)


def rewrite_assets(refs: DataFrame, url_map: DataFrame, page_url: str = "url", from_path: Column | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Asset references with ``new``: the local path, an archive URL for what the archive's root
    serves, or the value as it is."""
    found = urls.settled(refs, _abs=F.when(F.col("grp").isin(40, 41), urls.resolve_css_ref(F.col("value"), F.col(page_url))).otherwise(urls.resolve_href(F.col("value"), F.col(page_url))))
    found = urls.settled(found, key=urls.normalize_url(urls.without_fragment(F.col("_abs")), ignore)).join(url_map.withColumnRenamed("path", "_to"), "key", "left")
    local = F.col("_to") if from_path is None else urls.relative_path(from_path, F.col("_to"))
    wrapped = F.startswith(F.col("value"), F.lit("/web/")) & ~F.col("grp").isin(40, 41)
    new = F.when(F.col("_to").isNotNull(), F.concat(local, urls.fragment(F.col("_abs")))).when(wrapped, F.concat(F.lit(urls.ARCHIVE), F.col("value"))).otherwise(F.col("value"))
    return found.withColumns({"new": new, "state": F.when(F.col("_to").isNotNull(), F.lit("local")).when(wrapped, F.lit("archive")).otherwise(F.lit("kept"))}).drop("_abs", "_to")


def drop_known(rows: DataFrame, *manifests: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key none of the manifests has. Of the manifests only the keys that rows have are
    looked at, so a small wave does not move a large manifest."""
    known = manifests[0].select("key")
    for m in manifests[1:]:
        known = known.union(m.select("key"))
    return rows.join(asked_of(known.withColumnRenamed("key", key), rows, [key], "asked_keys"), key, "left_anti")


def dedupe_references(refs: DataFrame, order: Column) -> DataFrame:
    """One row per base: fetch_url and kind of its first occurrence, ``found_in`` and place
    (``first``) of it, and the number of all pages that it is on."""
    best = F.min_by(F.struct("fetch_url", "kind", "found_in"), order).alias("_f")
    found = refs.groupBy("base").agg(best, F.min(order).alias("first"), F.count_distinct("found_in").alias("n_pages"))
    return found.select("base", "_f.fetch_url", "_f.kind", "_f.found_in", "n_pages", "first")


def _place(page: Column, grp: Column, pos: Column) -> Column:
    return F.struct(page.alias("page"), grp.cast("int").alias("grp"), pos.cast("int").alias("pos"))


def of_target(manifest: DataFrame, target: str | None) -> DataFrame:
    """The entries of one target, of all if none is named."""
    return manifest if target is None else manifest.filter(F.col("target") == target)


def pending(manifest: DataFrame, done: DataFrame, path: str = "local_path", target: str | None = None) -> DataFrame:
    """Entries whose file is not there yet."""
    return of_target(manifest, target).join(done.select(path), path, "left_anti")


def with_content(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    return manifest.join(raw, "local_path")


def scannable(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """Entries with their content that discovery goes through: pages by name that do not begin
    with an underscore."""
    pages = F.endswith(F.col("local_path"), F.lit(".html")) & ~F.startswith(F.substring_index("local_path", "/", -1), F.lit("_"))
    return with_content(manifest.filter(pages), raw)


def run_progress(manifest: DataFrame, raw: DataFrame, clean: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Per target: total, on_disk, pending, cleaned and failed."""
    rows = manifest.select("target", "local_path").join(raw.select("local_path", F.lit(True).alias("_raw")).distinct(), "local_path", "left")
    rows = rows.join(clean.select("local_path", F.lit(True).alias("_clean")).distinct(), "local_path", "left") if clean is not None else rows.withColumn("_clean", F.lit(None).cast("boolean"))
    failed = log.filter("outcome = 'fail'").select("local_path", F.lit(True).alias("_fail")).distinct() if log is not None else None
    rows = rows.join(failed, "local_path", "left") if failed is not None else rows.withColumn("_fail", F.lit(None).cast("boolean"))
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_raw")).alias("on_disk"), F.count_if(F.col("_raw").isNull()).alias("pending"), F.count_if(F.col("_clean")).alias("cleaned"), F.count_if(F.col("_fail")).alias("failed")
    )


def page_index(pages: DataFrame) -> DataFrame:
    """(target, rel_path, title, n_pages): the listing of each target, one row per page."""
    counts = pages.groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"))
    rel = F.when(F.startswith(F.col("local_path"), F.concat("target", F.lit("/"))), F.substring(F.col("local_path"), F.char_length("target") + 2, F.char_length("local_path"))).otherwise(F.col("local_path"))
    return pages.select("target", rel.alias("rel_path"), "title").join(counts, "target")


def affected_pages(references: DataFrame, obtained: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of the pages (found_in) that refer to a base obtained since."""
    pages = references.join(obtained.select("base").distinct(), "base", "left_semi").select(F.col("found_in").alias("local_path")).distinct()
    return manifest.join(pages, "local_path", "left_semi")


def asset_references(pages: DataFrame, html: str = "html", links: bool = False) -> DataFrame:
    """What pages load and, with ``links``, what any other src or href of them names, with base,
    fetch_url, kind and host."""
    wanted = content.is_asset_reference()
    wanted = wanted | F.col("attr").isin("src", "href") if links else wanted
    refs = content.fetchable(content.extract_references(pages, html).filter(wanted))
    refs = refs.withColumn("kind", F.when(F.col("tag") == "iframe", F.lit("iframe")).otherwise(F.lit("asset")))
    return urls.settled(refs, host=urls.host_of(F.col("base")))


def external_references(pages: DataFrame, scope: DataFrame, known: DataFrame, found_in: str, html: str = "html", exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """The bases outside the scope that pages load and that ``known`` (key) lacks, one row each."""
    refs = asset_references(pages, html).filter(~urls.is_archive_host(F.col("host")))
    for p in exclude:
        refs = refs.filter(~F.col("base").rlike(p))
    refs = urls.settled(in_scope(refs, scope, keep=False), key=urls.normalize_url(F.col("base"), ignore))
    new = drop_known(refs, known).withColumn("found_in", F.col(found_in))
    return dedupe_references(new, _place(F.col(found_in), F.col("grp"), F.col("ord")))


def _inscope(pages: DataFrame, scope: DataFrame, html: str, ignore: tuple[str, ...]) -> DataFrame:
    refs = content.fetchable(content.extract_references(pages, html).filter("attr IN ('src', 'href')"))
    refs = urls.settled(refs, host=urls.host_of(F.col("base")), key=urls.normalize_url(F.col("base"), ignore))
    return in_scope(refs, scope)


def inscope_references(pages: DataFrame, scope: DataFrame, known: DataFrame, found_in: str, html: str = "html", ignore: tuple[str, ...] = ()) -> DataFrame:
    """The bases in scope that any src or href of a page names and that ``known`` lacks."""
    refs = _inscope(pages, scope, html, ignore).withColumns({"kind": F.lit("asset"), "found_in": F.col(found_in)})
    return dedupe_references(drop_known(refs, known), _place(F.col(found_in), F.col("ord"), F.when(F.col("attr") == "src", 0).otherwise(1)))


def inscope_css_references(sheets: DataFrame, scope: DataFrame, known: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The bases in scope that stylesheets (local_path, css) name by absolute URLs and ``known`` lacks."""
    refs = content.css_references(sheets.select("local_path", "css"), absolute=True)
    base = urls.without_fragment(F.coalesce(urls.unwrap_archive_url(F.col("value")), F.col("value")))
    refs = urls.settled(refs, base=base).withColumns({"fetch_url": F.col("value"), "found_in": F.col("local_path"), "kind": F.lit("asset")})
    refs = urls.settled(refs, host=urls.host_of(F.col("base")), key=urls.normalize_url(F.col("base"), ignore))
    return dedupe_references(drop_known(in_scope(refs, scope), known), _place(F.col("local_path"), F.col("grp"), F.col("pos")))


def external_css_references(sheets: DataFrame, scope: DataFrame, known: DataFrame, exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """What stylesheets (original, timestamp, css) load from outside the scope, in any form of
    reference, each at its stylesheet's own time."""
    refs = content.css_references(sheets.select("original", "timestamp", "css")).withColumn("base", urls.without_fragment(urls.resolve_css_ref(F.col("value"), F.col("original"))))
    refs = refs.filter("base IS NOT NULL").withColumns({"host": urls.host_of(F.col("base")), "key": urls.normalize_url(F.col("base"), ignore), "kind": F.lit("asset"), "found_in": F.col("original")})
    refs = refs.withColumn("fetch_url", F.concat(F.lit(urls.ARCHIVE + "/web/"), F.coalesce("timestamp", F.lit("")), F.lit("id_/"), F.col("base"))).filter(~urls.is_archive_host(F.col("host")))
    for p in exclude:
        refs = refs.filter(~F.col("base").rlike(p))
    return dedupe_references(drop_known(in_scope(refs, scope, keep=False), known), _place(F.col("original"), F.col("grp"), F.col("pos")))


def _entries(found: DataFrame, prefix: Column, used: DataFrame | None, ignore: tuple[str, ...], wave: int) -> DataFrame:
    """``found`` in the order of first occurrence (``key_seq``), with paths that ``used`` lacks."""
    rows = ranked(found.withColumnRenamed("base", "original"), [], ["first", "original"], "key_seq")
    rows = rows.withColumns({"key_seq": F.col("key_seq") + F.lit(wave << 40), "prefix": prefix, "wave": F.lit(wave)})
    named = captures.assign_local_paths(rows, "key_seq", ignore)
    if used is not None:
        named = captures.dedupe_paths(named.withColumn("_all", F.lit(1)), "key_seq", "local_path", ("_all",), used.select(F.lit(1).alias("_all"), "local_path")).drop("_all")
    return named.withColumns({"key": urls.normalize_url(F.col("original"), ignore), "timestamp": urls.capture_timestamp(F.col("fetch_url"))})


ENTRY = ("original", "key", "timestamp", "wayback_url", "local_path", "target", "kind", "found_in", "key_seq", "wave")


def external_entries(found: DataFrame, target: str, used: DataFrame | None = None, ignore: tuple[str, ...] = (), wave: int = 0) -> DataFrame:
    """Manifest rows of external bases, below a folder of their own for each host."""
    named = _entries(found, F.concat(F.lit(f"{target}/_external/"), urls.safe_host(urls.host_of(F.col("original")))), used, ignore, wave)
    ts = F.col("timestamp")
    playback = F.concat(F.lit(urls.ARCHIVE + "/web/"), F.when(ts != "", F.concat(ts, F.lit("/"))).otherwise(F.lit("")), F.col("original"))
    url = F.when(F.col("kind") == "iframe", playback).otherwise(urls.raw_capture_url(F.col("fetch_url")))
    return named.withColumns({"wayback_url": url, "target": F.lit(target)}).select(*ENTRY)


def inscope_entries(found: DataFrame, target: str, used: DataFrame | None = None, ignore: tuple[str, ...] = (), wave: int = 0) -> DataFrame:
    """Manifest rows of bases in scope, in the target's own folder."""
    named = _entries(found, F.lit(target), used, ignore, wave)
    return named.withColumns({"wayback_url": urls.raw_capture_url(F.col("fetch_url")), "target": F.lit(target)}).select(*ENTRY)


def discover_external(pages: DataFrame, scope: DataFrame, manifest: DataFrame, archive: DataFrame, target: str, exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """All external entries in waves: what pages load, then what the iframes and stylesheets so
    obtained load, at most ``MOST_WAVES`` times.

    ``pages`` has local_path and html, ``archive`` the key and content of what can be had.
    Stylesheets are known by their content. Where a page and a stylesheet of one wave name the
    same base, the stylesheet's URL counts. Each wave is written, which cuts the lineage.
    """
    found, frontier, known, sheets = None, pages.select("local_path", "html"), manifest.select("key"), None
    for wave in range(MOST_WAVES):
        refs = external_references(frontier, scope, known, "local_path", exclude=exclude, ignore=ignore).withColumn("src", F.lit(0))
        if sheets is not None:
            refs = refs.unionByName(external_css_references(sheets, scope, known, exclude, ignore).withColumn("src", F.lit(1)))
            last = F.max_by(F.struct("fetch_url", "kind", "found_in", "n_pages"), "src").alias("l")
            refs = refs.groupBy("base").agg(last, F.min(F.struct("src", "first")).alias("first")).select("base", "l.*", "first")
        else:
            refs = refs.withColumn("first", F.struct("src", "first"))
        new = keep(external_entries(refs, target, found, ignore, wave), f"external_wave{wave}")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        known = manifest.select("key").union(found.select("key"))
        got = content.with_media(new.join(archive.select("key", "content"), "key"))
        page = (F.col("kind") == "iframe") & F.endswith(F.col("local_path"), F.lit(".html"))
        frontier = got.filter(page).select("local_path", content.decode_text(F.col("content")).alias("html"))
        sheets = got.filter(~page & (F.col("media") == "css")).select("original", "timestamp", content.decode_text(F.col("content")).alias("css"))
    return found if found is not None else new


def discover_inscope(clean: DataFrame, scope: DataFrame, manifest: DataFrame, archive: DataFrame, target: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Entries in scope in waves: what clean pages (local_path, html) still name elsewhere, then what
    the stylesheets so obtained name, at most ``MOST_WAVES`` times. Only files named .css are
    gone through again. Paths give way to the manifest's; each wave is written.
    """
    found, known, sheets = None, manifest.select("key"), None
    for wave in range(MOST_WAVES):
        if sheets is None:
            refs = inscope_references(clean.select("local_path", "html"), scope, known, "local_path", ignore=ignore)
        else:
            refs = inscope_css_references(sheets, scope, known, ignore)
        used = manifest.select("local_path") if found is None else manifest.select("local_path").union(found.select("local_path"))
        new = keep(inscope_entries(refs, target, used, ignore, wave), f"inscope_wave{wave}")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        known = manifest.select("key").union(found.select("key"))
        got = new.filter(F.endswith(F.col("local_path"), F.lit(".css"))).join(archive.select("key", "content"), "key")
        sheets = keep(got.select("local_path", content.decode_text(F.col("content")).alias("css")), f"sheets{wave}")
        if sheets.isEmpty():
            break
    return found if found is not None else new


def clean_pages(pages: DataFrame, url_map: DataFrame, scope: DataFrame, localize: bool | Column = True, kill_redirects: bool = False, css_href: str | Column | None = None, js_href: str | Column | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned pages (local_path, url, html ...) with their ``title``: artefacts gone, links local,
    dead or as they were, assets local where the map has them (on pages to localize).

    One pass over a page gives its title, links and assets, which are written; a second one
    applies what is to change.
    """
    here = F.col("local_path")
    wanted = localize if isinstance(localize, Column) else F.lit(localize)
    scanned = keep(content.with_scan(pages.select("local_path", "url", wanted.alias("localize"), "html")), "scanned")
    refs = content.references_of(scanned)
    links = classify_links(_resolved(refs.filter("tag = 'a' AND attr = 'href'"), "url", ignore), url_map, scope, here)
    edits = links.filter("state <> 'external'").select("local_path", "ord", "attr", F.col("value").alias("old"), F.col("new_href").alias("new"), F.when(F.col("state") == "dead", F.col("base")).alias("dead"))
    assets = rewrite_assets(refs.filter(F.col("localize") & content.is_asset_reference(any_css=True)), url_map, "url", here, ignore)
    edits = edits.unionByName(assets.filter("state <> 'kept'").select("local_path", "ord", "attr", F.col("value").alias("old"), "new", F.lit(None).cast("string").alias("dead")))
    titled = pages.drop("title").join(scanned.select("local_path", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title")), "local_path")
    return content.rewrite_pages(titled, edits, ["local_path"], css_href, js_href, kill_redirects)


def content_kinds(manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """(local_path, media, path) of the entries that have bytes: what they hold and the path that
    follows from it."""
    kinds = content.with_media(with_content(manifest.select("local_path").distinct(), raw.select("local_path", "content")))
    return kinds.select("local_path", "media", content.effective_path(F.col("local_path"), F.col("media")).alias("path"))


def clean_site(
    manifest: DataFrame,
    raw: DataFrame,
    scope: DataFrame,
    done: DataFrame | None = None,
    external: DataFrame | None = None,
    settings: captures.Settings | None = None,
    target: str | None = None,
    only: DataFrame | None = None,
    inject: bool = True,
    kinds: DataFrame | None = None,
    arrived: DataFrame | None = None,
) -> DataFrame:
    """(target, path, media, content, title) of every entry that has bytes and, unless all are to be
    redone, is not in ``done`` (path): binaries and others as they are, stylesheets and pages
    rewritten.

    ``external`` holds entries of other hosts, which links lead to only where their bytes are
    there. ``settings`` says what of the query keys ignore, whose assets become local (those of
    a target that asks for it, or all with external assets) and whether redirects go; without
    it assets become local. ``target`` narrows all to one target, ``only`` (local_path) the
    result to some entries. Pages load the site's own style and script unless ``inject`` is
    off. The title of what is no page is its URL.

    ``kinds`` is the written table of :func:`content_kinds` for ``raw``, made here if it is not given;
    ``arrived`` (local_path, path) is the same of bytes that are not in ``raw`` but were there
    before, to which links lead as well. Contents are read once for their kinds and once by
    each of the three ways to treat them.
    """
    settings = settings or captures.Settings(external_asset=True)
    ignore = settings.ignore
    main = of_target(manifest, target)
    other = of_target(external, target) if external is not None else main.limit(0)
    ord_ = lambda df: F.col("target_ord").cast("int") if "target_ord" in df.columns else F.lit(0)
    fields = ["original", "target", "local_path", "key_seq"]
    entries = main.select(*fields, ord_(main).alias("target_ord"), F.lit(False).alias("external")).union(other.select(*fields, ord_(other), F.lit(True)))
    kinds = keep(content_kinds(entries, raw), "kinds") if kinds is None else kinds
    there = kinds.select("local_path", F.col("path").alias("_p"))
    if arrived is not None:
        there = there.union(arrived.select("local_path", "path")).groupBy("local_path").agg(F.min("_p").alias("_p"))
    placed = entries.join(there, "local_path", "left").filter("NOT external OR _p IS NOT NULL").withColumn("path", F.coalesce("_p", "local_path"))
    url_map = keep(build_url_map(placed.filter("NOT external"), placed.filter("external"), None, ignore, "path"), "url_map")
    todo = entries.select("local_path", "target", "original").join(kinds, "local_path")
    if done is not None:
        todo = todo.join(done.select("path"), "path", "left_anti")
    if only is not None:
        todo = todo.join(only.select("local_path").distinct(), "local_path", "left_semi")
    todo = keep(todo, "to_clean")
    with_bytes = lambda kind: todo.filter(kind).join(raw.select("local_path", "content"), "local_path")
    text = content.decode_text(F.col("content"))
    columns = ["target", "path", "media", "content", "title"]
    copied = with_bytes("media NOT IN ('css', 'html')").withColumn("title", F.col("original")).select(*columns)
    sheets = content.rewrite_css(with_bytes("media = 'css'").select("target", "media", "path", "original", text.alias("css")), url_map, "path", ignore=ignore)
    sheets = sheets.select("target", "path", "media", F.encode("css", "UTF-8").alias("content"), F.col("original").alias("title"))
    asked = F.col("target").isin([t.name for t in settings.targets if t.localize_assets]) | F.lit(settings.external_asset)
    pages = with_bytes("media = 'html'").select("target", "media", F.col("path").alias("local_path"), F.col("original").alias("url"), text.alias("html"))
    own = [urls.relative_path(F.col("local_path"), F.concat("target", F.lit(f"/{f}"))) if inject else None for f in (STYLE_FILE, SCRIPT_FILE)]
    cleaned = clean_pages(pages, url_map, scope, asked, settings.kill_redirects, *own, ignore)
    return copied.unionByName(sheets).unionByName(cleaned.select("target", F.col("local_path").alias("path"), "media", F.encode("html", "UTF-8").alias("content"), "title"))


def reference_index(clean: DataFrame) -> DataFrame:
    """(base, found_in), each once: what clean pages and stylesheets (local_path, html; media) still name
    elsewhere. Kept beside a clean site and added to as pages are cleaned, it tells who refers
    to a URL without reading any page again; see :func:`arkloom.sources.tables.write_references`."""
    refs = content.fetchable(content.extract_references(clean.filter("media = 'html'").select("local_path", "html")).filter("attr IN ('src', 'href') OR grp <> 99"))
    sheets = content.css_references(clean.filter("media = 'css'").select("local_path", F.col("html").alias("css")), absolute=True)
    named = urls.without_fragment(F.coalesce(urls.unwrap_archive_url(F.col("value")), F.col("value")))
    return refs.select("base", F.col("local_path").alias("found_in")).union(sheets.select(named.alias("base"), F.col("local_path").alias("found_in"))).distinct()


def reclean_affected(
    clean: DataFrame | None,
    obtained: DataFrame,
    manifest: DataFrame,
    raw: DataFrame,
    scope: DataFrame,
    settings: captures.Settings | None = None,
    external: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """The new state of all pages and stylesheets that refer to what has been ``obtained`` (original)
    since, for :func:`clean_site`'s result to be replaced with.

    Who refers is told by ``index`` (see :func:`reference_index`), of which only the obtained
    bases are read, or, without one, from all clean pages (clean: local_path, html; media).
    Only the affected contents are rewritten. All referrers count, not only the first one, and
    stylesheets as well; ``found_in`` is the path of the clean file.
    """
    index = reference_index(clean) if index is None else index
    wanted = obtained.select(urls.without_fragment(F.col("original")).alias("base")).distinct()
    if "bucket" in index.columns:
        wanted = wanted.withColumn("bucket", reference_bucket(F.col("base")))
    found = keep(index.join(wanted, wanted.columns, "left_semi").select("found_in").distinct(), "referrers")
    # A file may lie under another extension than its entry has.
    former = found.select("found_in").union(found.filter(F.col("found_in").rlike("[.](css|js)$")).select(F.regexp_replace("found_in", "[.](css|js)$", ".html"))).distinct()
    entries = manifest.select("local_path") if external is None else manifest.select("local_path").union(external.select("local_path"))
    affected = keep(entries.join(former.withColumnRenamed("found_in", "local_path"), "local_path", "left_semi"), "affected")
    return clean_site(manifest, raw, scope, external=external, settings=settings, only=affected)


#: Buckets of the bases in a kept index of references.
REFERENCE_BUCKETS = 256


def reference_bucket(base: Column) -> Column:
    return F.pmod(F.xxhash64(base), F.lit(REFERENCE_BUCKETS)).cast("int")


def archive_pipeline(rows: DataFrame, settings: captures.Settings, archive: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """From captures to the clean site: (manifest, external entries or None, clean site).

    ``archive`` has the key and content of what can be had, a row for each key. Without ``external_asset`` in the
    settings nothing is discovered.
    """
    spark = rows.sparkSession
    manifest = keep(captures.build_manifest(rows, settings), "manifest")
    scope = spark.createDataFrame([(t.url if "//" in t.url else f"http://{t.url}",) for t in settings.targets], "url string").select(urls.host_of(F.col("url")).alias("host"))
    raw = keep(manifest.join(archive.select("key", "content"), "key").select("local_path", "content"), "raw")
    external = None
    if settings.external_asset:
        pages = scannable(manifest, raw).select("local_path", content.decode_text(F.col("content")).alias("html"))
        external = discover_external(pages, scope, manifest, archive, settings.targets[0].name, settings.external_exclude, settings.ignore)
        raw = raw.unionByName(external.join(archive.select("key", "content"), "key").select("local_path", "content"))
    return manifest, external, clean_site(manifest, raw, scope, external=external, settings=settings)
