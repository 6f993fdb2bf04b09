"""Page content: media kinds, references, links, stylesheets, and the cleaned page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arkloom.functions import urls
from arkloom.work import keep, small_batches

# What marks content kinds, references, and what an archive adds to pages.
BINARY_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".ico", ".bmp", ".webp", ".swf", ".mp3", ".mp4", ".ogg", ".wav", ".flv", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip")
SCRIPT_STARTS = ("(function", "!function", ";(function", "function(", "function ", "var ", "let ", "const ", "window.", "document.", "jQuery", "$.fn", "$(", "(window", "(this", '"use strict"', "'use strict'", "/*!")
ASSET_ATTRIBUTES = (("img", "src"), ("script", "src"), ("source", "src"), ("video", "src"), ("audio", "src"), ("iframe", "src"), ("embed", "src"), ("object", "data"))
LINK_RELS = ("stylesheet", "icon", "apple-touch-icon", "shortcut icon")
LAZY_ATTRIBUTES = ("data-src", "data-original", "data-lazy-src")
TOOLBAR_IDS = ("wm-ipp", "wm-ipp-base", "wm-ipp-print", "donato", "playback", "wm-share", "wm-tabs", "wm-toolbar")
TOOLBAR_HOST = r"(?i)web-static\.archive\.org"
TOOLBAR_CODE = r"(?i)__wm\.|wombat|WB_wombat|RufflePlayer"
DEAD_LOCAL = r"^/(skins|extensions|opensearch_desc|favicon\.ico)"
REDIRECT_CALL = r',?\s*\["NoscriptOverride","redirectToJSPage",\[\],\[[^\]]*\]\]'
CSS_URL = r"""(?i)url\(\s*['"]?([^)'"]+?)['"]?\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+(?:url\(\s*)?['"]?([^)'";\s]+)"""
CSS_URL_ABSOLUTE = r"""(?i)url\(\s*["']?(https?://[^)"'<>\s]+)["']?\s*\)"""
CSS_IMPORT_ABSOLUTE = r"""(?i)@import\s+(?:url\(\s*)?["']?(https?://[^)"'<>\s]+)["']?"""

# --- kinds of content -------------------------------------------------------------------


def suffix(path: Column) -> Column:
    """The extension with its dot; none for a file that only begins with one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _head(content: Column, n: int) -> Column:
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def _starts(text: Column) -> Column:
    found = F.lit(False)
    for s in SCRIPT_STARTS:
        found = found | F.startswith(text, F.lit(s))
    return found


def with_media(rows: DataFrame, content: str = "content", path: str = "local_path") -> DataFrame:
    """``rows`` with ``media``: ``binary``, ``css``, ``js``, ``html`` or ``other``, from the first bytes
    and the path.

    A name of a binary kind or a zero byte early wins; pages named .html are looked into, as
    scripts that serve stylesheets or scripts were given that name.
    """
    comment = r"(?s)^/\*.*?\*/\s*"
    rows = urls.settled(rows, _early=_head(F.col(content), 4000))
    early = F.col("_early")
    rows = urls.settled(
        rows,
        _head=F.regexp_replace(F.substring(early, 1, 500), r"^\s+", ""),
        _top=F.regexp_replace(F.regexp_replace(F.substring(early, 1, 600), "^(?:\\s|ï»¿)+", ""), comment, ""),
    )
    rows = urls.settled(rows, _body=F.regexp_replace("_head", comment, ""), _code=F.regexp_replace("_top", r"^//[^\n]*(?:\n\s*|$)", ""))
    html = suffix(F.col(path)) == ".html"
    markup = F.lower(F.substring("_head", 1, 5)).isin("<!doc", "<html", "<?xml") | F.substring("_head", 1, 2).isin("<!", "<?")
    css = ~markup & ~_starts(F.col("_body")) & (F.instr(early, "{") > 0) & (F.instr(early, ":") > 0)
    media = (
        F.when(suffix(F.col(path)).isin(*BINARY_EXTENSIONS) | (F.instr(F.substring(early, 1, 512), "\x00") > 0), F.lit("binary"))
        .when(suffix(F.col(path)) == ".css", F.lit("css"))
        .when(suffix(F.col(path)) == ".js", F.lit("js"))
        .when(html & css, F.lit("css"))
        .when(html & ~F.startswith(F.col("_top"), F.lit("<")) & _starts(F.col("_code")), F.lit("js"))
        .when(html, F.lit("html"))
        .otherwise(F.lit("other"))
    )
    return urls.settled(rows, media=media).drop("_early", "_head", "_top", "_body", "_code")


def effective_path(path: Column, media: Column) -> Column:
    """A path named .html that holds a stylesheet or script gets that extension."""
    return F.when(F.endswith(path, F.lit(".html")) & media.isin("css", "js"), F.concat(F.substring(path, F.lit(1), F.char_length(path) - 5), F.lit("."), media)).otherwise(path)


def decode_text(content: Column) -> Column:
    """UTF-8, broken bytes as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


# --- the scanner and the rewriter -------------------------------------------------------

# Comments, tags and other declarations, each up to its end or the page's. A quote holds a >
# only after an =. Nothing is gone back over, so the time is in proportion to the page.
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
#: Elements whose content is text; those that hide the rest of the page if they never end come first.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea")}
_TO_THE_END = ("script", "style")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _spans(text: str) -> tuple[dict[str, tuple[str, int, int]], int]:
    """The attributes of a tag's text, the first of each name, as (value, start, end), and where
    the last one ends."""
    out: dict[str, tuple[str, int, int]] = {}
    last = 0
    for m in _ATTR.finditer(text):
        value, last = m[2] or "", m.end()
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        out.setdefault(m[1].lower(), (unescape(value[1:-1] if quoted else value), m.start(), m.end()))
    return out, last


def _tokens(html: str) -> Iterator[tuple[re.Match, str]]:
    """Tags and comments in order, each with the raw text of a script, style or title after it."""
    at, endless = 0, set()
    while m := _TOKEN.search(html, at):
        at, raw, name = m.end(), "", (m["name"] or "").lower()
        if name in _RAW and not m["end"] and name not in endless:
            close = _RAW[name].search(html, at)
            if close or name in _TO_THE_END:
                raw = html[at : close.start() if close else len(html)]
                at += len(raw)
            else:
                endless.add(name)
        yield m, raw


_CSS_VALUE = re.compile(CSS_URL)


def _scanned(html: str) -> tuple[str, list[tuple]]:
    """The title and (ord, grp, tag, attr, rel, value) of the references in document order; ``grp``
    is the place of their kind among the kinds that win over each other."""
    out, groups = [], {pair: k for k, pair in enumerate(ASSET_ATTRIBUTES)}
    lazy = {a: len(groups) + 1 + k for k, a in enumerate(LAZY_ATTRIBUTES)}
    title: list[str] | None = None
    heading: list[str] | None = None
    at, inside = 0, False
    for n, (m, raw) in enumerate(_tokens(html)):
        if inside:
            heading.append(html[at : m.start()])
        at = m.end() + len(raw)
        tag = (m["name"] or "").lower()
        if not tag or m["end"]:
            inside = inside and tag != "h1"
            continue
        if tag == "title" and title is None:
            title = re.split("<[^>]*>", raw)
        elif tag == "h1" and heading is None:
            heading, inside = [], True
        attrs = {k: v for k, (v, _, _) in _spans(m["attrs"])[0].items()}
        for attr, value in attrs.items():
            grp = groups.get((tag, attr), lazy.get(attr, len(groups) if (tag, attr) == ("link", "href") else None))
            if (tag, attr) == ("a", "href") or attr in ("src", "href") or grp is not None:
                out.append((n, 99 if grp is None else grp, tag, attr, attrs.get("rel", ""), value))
            elif attr == "style":
                out += [(n, 41, tag, "style", "", v[1]) for v in _CSS_VALUE.finditer(value)]
        if tag == "style":
            out += [(n, 40, tag, "text", "", v[1]) for v in _CSS_VALUE.finditer(raw)]
    if inside:
        heading.append(html[at:])
    return "".join(unescape(x).strip() for x in (title if title is not None else heading or ())), out


_REFERENCE = T.StructType([T.StructField(n, t) for n, t in (("ord", T.IntegerType()), ("grp", T.IntegerType()), ("tag", T.StringType()), ("attr", T.StringType()), ("rel", T.StringType()), ("value", T.StringType()))])
_REFERENCE_ARROW = pa.struct([(n, pa.int32() if n in ("ord", "grp") else pa.string()) for n in _REFERENCE.names])
#: Pages whose references are Python objects at a time.
SCAN_ROWS = 200


def _scan_columns(html: pa.Array) -> pa.Array:
    """Titles and references of some pages, as Arrow holds them."""
    titles, ends = [], [0]
    columns: list[list] = [[] for _ in _REFERENCE.names]
    for x in html:
        title, refs = _scanned(x.as_py() or "")
        titles.append(title)
        for column, values in zip(columns, zip(*refs)):
            column.extend(values)
        ends.append(ends[-1] + len(refs))
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REFERENCE_ARROW)], fields=list(_REFERENCE_ARROW))
    refs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=pa.list_(pa.field("element", _REFERENCE_ARROW)))
    return pa.StructArray.from_arrays([pa.array(titles, pa.string()), refs], names=["title", "refs"])


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("refs", T.ArrayType(_REFERENCE))]))
def scan_html(html: pa.Array) -> pa.Array:
    """Title and references of pages, each page gone through once. Null is an empty page.

    A batch may have very many references, so those of ``SCAN_ROWS`` pages at a time are objects.
    """
    return pa.concat_arrays([_scan_columns(html.slice(at, SCAN_ROWS)) for at in range(0, max(1, len(html)), SCAN_ROWS)])


def page_title(html: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(scan_html(html)["title"], F.lit("")), fallback)


def with_scan(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``title`` and ``refs`` in the place of their html: all that later steps need
    from one pass over the markup."""
    rest = [c for c in pages.columns if c not in (html, "title", "refs")]
    return small_batches(pages).select(*rest, scan_html(F.col(html)).alias("_s")).select(*rest, "_s.title", "_s.refs")


def references_of(scanned: DataFrame) -> DataFrame:
    """The rows of :func:`with_scan`, one per reference: ord, grp, tag, attr, rel, value.

    From a plain explode Spark infers a filter on the list's size, for which it would scan
    the pages once more.
    """
    rest = [c for c in scanned.columns if c not in ("title", "refs")]
    return scanned.select(*rest, F.explode_outer("refs").alias("_r")).select(*rest, "_r.*").filter("ord IS NOT NULL")


def extract_references(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without their html, one row per reference: ord, grp, tag, attr, rel, value. They are
    written, as what follows reads them more than once."""
    return keep(references_of(with_scan(pages, html)), "references")


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every link of every page in order."""
    return extract_references(pages, html).filter("tag = 'a' AND attr = 'href'")


def is_asset_reference(any_css: bool = False) -> Column:
    """Of the scanner's rows: those that load something, never links to other pages. A page's own
    styles count where they name absolute URLs (discovery), or with all they name (rewriting)."""
    pair = F.lit(False)
    for tag, attr in ASSET_ATTRIBUTES:
        pair = pair | ((F.col("tag") == tag) & (F.col("attr") == attr))
    rels = F.exists(F.split("rel", r"\s+"), lambda r: r.isin(*LINK_RELS))
    css = F.col("grp").isin(40, 41) & F.lower("value").rlike("^https?://") if not any_css else F.col("grp").isin(40, 41)
    return pair | F.col("attr").isin(*LAZY_ATTRIBUTES) | ((F.col("tag") == "link") & (F.col("attr") == "href") & rels) | css


def fetchable(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose reference can be fetched, with ``base`` (original, no fragment) and ``fetch_url``.

    Archive-wrapped references keep their own URL, those relative to the archive's root get
    its host, plain ones the archive's raw form; all others are left out.
    """
    v = urls.trimmed(F.col(value))
    inner = urls.unwrap_archive_url(v)
    plain, rooted = v.rlike("^https?://"), F.startswith(v, F.lit("/web/"))
    wrapped = plain & F.contains(v, F.lit("web.archive.org"))
    base = urls.without_fragment(F.when(wrapped | rooted, inner).when(plain, v))
    fetch = F.when(wrapped, v).when(plain, F.concat(F.lit(urls.ARCHIVE + "/web/id_/"), base)).when(rooted, F.concat(F.lit(urls.ARCHIVE), v))
    return urls.settled(urls.settled(rows, base=base), fetch_url=fetch).filter("base IS NOT NULL AND fetch_url IS NOT NULL")


def css_references(sheets: DataFrame, css: str = "css", absolute: bool = False) -> DataFrame:
    """One row per url() and @import of stylesheets: ``value``, ``grp`` (0 or 1) and ``pos``."""
    rest = [c for c in sheets.columns if c != css]
    parts = None
    for grp, pattern in enumerate((CSS_URL_ABSOLUTE, CSS_IMPORT_ABSOLUTE) if absolute else (CSS_URL, CSS_IMPORT)):
        found = sheets.select(*rest, F.lit(grp).alias("grp"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(css), F.lit("")), F.lit(pattern), F.lit(1))).alias("pos", "value"))
        parts = found if parts is None else parts.unionByName(found)
    return parts


class _Open:
    """The elements that are open at a place of a page, the innermost one last."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.counts: Counter[str] = Counter()

    def enter(self, m: re.Match, name: str) -> None:
        """A start tag, unless the element has no content or ends itself."""
        if name not in _VOID and not m[0].endswith("/>"):
            self.names.append(name)
            self.counts[name] += 1

    def leave(self, name: str) -> bool:
        """An end tag ends the innermost element of that name and all within it; whether there was one."""
        if not self.counts[name]:
            return False
        while True:
            last = self.names.pop()
            self.counts[last] -= 1
            if last == name:
                return True


def _rewritten(html: str, edits: list[dict], css_href: str | None, js_href: str | None, kill_redirects: bool) -> str:
    """The page with its edits applied; text that nothing touches stays byte for byte.

    An element that goes takes what is in it: up to its own end tag, or, where that is missing,
    to the end of the element around it.
    """
    by_ord: dict[int, list[dict]] = {}
    for e in edits:
        by_ord.setdefault(e["ord"], []).append(e)
    out: list[str] = []
    at, head = 0, None
    around, gone = _Open(), _Open()
    link = f'<link rel="stylesheet" href="{escape(css_href)}">' if css_href else ""
    script = f'<script src="{escape(js_href)}"></script>' if js_href else ""
    for n, (m, raw) in enumerate(_tokens(html)):
        if not gone.names:
            out.append(html[at : m.start()])
        at = m.end() + len(raw)  # both go on from here, whatever becomes of them
        name, source = (m["name"] or "").lower(), m[0]
        if gone.names:
            if not m["end"]:
                gone.enter(m, name) if name else None
                continue
            if gone.leave(name) or not around.counts[name]:
                continue
            gone = _Open()  # the element around ends, and so does this one
        if m["comment"] is not None:
            c = m["comment"]
            if not ("archive.org" in c or "FILE ARCHIVED" in c or "WAYBACK" in c.upper()):
                out.append(source)
            continue
        if not name:
            out.append(source)
            continue
        if m["end"]:
            around.leave(name)
            if name == "head" and head == "open":
                out.append(script)
                head = "done"
            if name != "base":
                out.append(source)
            continue
        attrs = {k: v for k, (v, _, _) in _spans(m["attrs"])[0].items()}
        target = attrs.get("src") or attrs.get("href") or ""
        foreign = attrs.get("id") in TOOLBAR_IDS or name in ("script", "style", "link") and (re.search(TOOLBAR_HOST, target) or re.search(TOOLBAR_CODE, raw) or re.search(TOOLBAR_CODE, target) or re.search(DEAD_LOCAL, target))
        if foreign or name == "base" or kill_redirects and name == "meta" and attrs.get("http-equiv", "").lower() == "refresh":
            gone.enter(m, name)
            continue
        around.enter(m, name)
        changes: dict[str, str] = {}
        styles: dict[str, dict[str, str]] = {"text": {}, "style": {}}
        for e in by_ord.get(n, ()):
            if e["attr"] in styles:
                styles[e["attr"]][e["old"]] = e["new"]
            else:
                changes[e["attr"]] = e["new"]
                if e["dead"]:
                    changes |= {"data-broken": e["dead"], "class": " ".join([*attrs.get("class", "").split(), "dead"])}
        if styles["text"]:
            raw = _with_css(raw, styles["text"])
        if styles["style"]:
            changes["style"] = _with_css(attrs["style"], styles["style"])
        if changes:
            source = _with_attributes(m, changes)
        if kill_redirects and name == "script" and "src" not in attrs and "redirectToJSPage" in raw:
            raw = re.sub(REDIRECT_CALL, "", raw)
        out += [source, raw]
        if name == "head" and head is None:
            out.append(link)
            head = "open"
    if not gone.names:
        out.append(html[at:])
    page = "".join(out)
    if head is None and (link or script):
        block = f"<head>{link}{script}</head>"
        first = re.search(r"<html\b[^>]*>", page, re.I)
        page = page[: first.end()] + block + page[first.end() :] if first else block + page
    elif head == "open":
        page += script
    return page


def _with_css(text: str, new: dict[str, str]) -> str:
    """A stylesheet's text with the url() of the values in ``new`` replaced, where they stand."""
    return _CSS_VALUE.sub(lambda m: f'url("{new[m[1]]}")' if m[1] in new else m[0], text)


def _with_attributes(m: re.Match, changes: dict[str, str]) -> str:
    """A tag with attributes changed in their places, or added after the last one."""
    spans, last = _spans(m["attrs"])
    attrs, out, at = m["attrs"], [], 0
    for name in sorted((x for x in changes if x in spans), key=lambda x: spans[x][1]):
        _, start, end = spans[name]
        out += [attrs[at:start], f'{name}="{escape(changes[name])}"']
        at = end
    out.append(attrs[at:last])
    out += [f' {name}="{escape(value)}"' for name, value in changes.items() if name not in spans]
    return f"<{m['name']}{''.join(out)}{attrs[last:]}{'>' if m[0].endswith('>') else ''}"


def rewrite_pages(pages: DataFrame, edits: DataFrame, key: list[str], css_href: str | Column | None = None, js_href: str | Column | None = None, kill_redirects: bool = False, html: str = "html") -> DataFrame:
    """``pages`` with archive artefacts gone and ``edits`` (key, ord, attr, old, new, dead) applied.

    The edits of a page are gathered beside it, bounded by the page itself; the html moves once.
    """
    listed = edits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "attr", "old", "new", "dead"))).alias("_edits"))

    @F.arrow_udf("string")
    def run(texts: pa.Array, edit_lists: pa.Array, css: pa.Array, js: pa.Array) -> pa.Array:
        rows = (tuple(v.as_py() for v in row) for row in zip(texts, edit_lists, css, js))
        return pa.array((None if t is None else _rewritten(t, x or [], c, j, kill_redirects) for t, x, c, j in rows), pa.string())

    css, js = (x if isinstance(x, Column) else F.lit(x).cast("string") for x in (css_href, js_href))
    return small_batches(pages).join(listed, key, "left").withColumn(html, run(F.col(html), F.col("_edits"), css, js)).drop("_edits")


def strip_archive_artifacts(html: Column, kill_redirects: bool = False) -> Column:
    """The page without toolbar elements, archive scripts, styles and comments."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((None if t is None else _rewritten(t, [], None, None, kill_redirects) for t in (x.as_py() for x in texts)), pa.string())

    return run(html)


def rewrite_css(sheets: DataFrame, url_map: DataFrame, path: str = "local_path", css: str = "css", url: str = "original", ignore: tuple[str, ...] = ()) -> DataFrame:
    """Stylesheets in which each url() that the map knows leads to its local file; all else stays."""
    hits = F.regexp_extract_all(F.col(css), F.lit(CSS_URL), F.lit(0))
    values = F.regexp_extract_all(F.col(css), F.lit(CSS_URL), F.lit(1))
    gaps = sheets.withColumns({"_gaps": F.split(F.col(css), CSS_URL, -1), "_hits": F.arrays_zip(hits.alias("hit"), values.alias("value"))})
    refs = gaps.select(path, url, F.posexplode("_hits").alias("pos", "r"))
    found = urls.settled(refs, abs=urls.resolve_css_ref(F.col("r.value"), F.col(url))).filter("abs IS NOT NULL").select(path, "pos", "abs")
    found = urls.settled(found, key=urls.normalize_url(urls.without_fragment(F.col("abs")), ignore))
    mapped = found.join(url_map.select("key", F.col("path").alias("_to")), "key")
    new = F.concat(F.lit('url("'), urls.relative_path(F.col(path), F.col("_to")), urls.fragment(F.col("abs")), F.lit('")'))
    edits = mapped.groupBy(path).agg(F.map_from_entries(F.collect_list(F.struct("pos", new.alias("new")))).alias("_new"))
    joined = gaps.join(edits, path, "left")
    pieces = F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("_new"), i), F.get(F.col("_hits"), i)["hit"], F.lit(""))))
    return joined.withColumn(css, F.array_join(pieces, "")).drop("_gaps", "_hits", "_new")
