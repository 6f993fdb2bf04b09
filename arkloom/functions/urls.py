"""URL and path columns: canonical keys, references to absolute URLs, local paths.

Every function takes and gives columns of built-in functions only, so all of them run inside
Spark's generated code. A null in gives a null out unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is replaced in path segments, and the extensions of pages that scripts
# and servers make.
UNSAFE, UNSAFE_HOST = r"[^A-Za-z0-9._()-]", r"[^A-Za-z0-9._-]"
SOURCE_EXTENSIONS = ("php", "php3", "php4", "php5", "phtml", "asp", "aspx", "jsp", "jspx", "cgi", "pl", "do", "action", "cfm", "htm", "html", "shtml", "xhtml")
ARCHIVE = "https://web.archive.org"
NO_PAGE = r"^(#|mailto:|javascript:|tel:|data:)"

#: scheme, authority with its slashes, authority, path, query with its mark, query.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"
MOST = 150


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once: later filters and columns use the values,
    where Spark would otherwise copy a long expression into every place that names it."""
    for name, value in columns.items():
        rows = rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))
    return rows


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def fragment(url: Column) -> Column:
    """From the first # on, with it; empty if there is none."""
    return F.substring(url, F.char_length(without_fragment(url)) + 1, F.char_length(url))


def clean_host(authority: Column) -> Column:
    """In lower case, without white space around, one port 80 or 443, and then one dot at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(authority)), ":(80|443)$", ""), "[.]$", "")


def host_of(url: Column) -> Column:
    """The clean host; empty for a relative URL."""
    return clean_host(_part(url, 3))


def percent_decoded(text: Column) -> Column:
    """%XX decoded as UTF-8 (broken sequences become U+FFFD); + and malformed % stay."""
    return F.url_decode(F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_decoded(text: Column) -> Column:
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def filter_query(query: Column, ignore: tuple[str, ...] = ()) -> Column:
    """``?`` and the query without the parameters of ``ignore``; empty if nothing is left.

    Without ``ignore`` the query stays as it is. With it the parameters are decoded and encoded
    again in order, and one without = gets it.
    """
    if not ignore:
        return F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")) if query is not None else query
    tokens = F.filter(F.split(query, "&"), lambda t: t != "")
    pairs = F.transform(tokens, lambda t: F.struct(_form_decoded(F.substring_index(t, "=", 1)).alias("k"), _form_decoded(F.when(F.contains(t, F.lit("=")), F.regexp_replace(t, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(*ignore))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit(""))


def normalize_url(url: Column, ignore: tuple[str, ...] = ()) -> Column:
    """The canonical key: scheme and host folded, path decoded with single slashes and none at
    its end, no parameters of the last segment, no fragment, the query filtered."""
    base = without_fragment(trimmed(url))
    scheme = F.coalesce(F.nullif(F.lower(_part(base, 1)), F.lit("")), F.lit("http"))
    path = percent_decoded(F.regexp_replace(_part(base, 4), ";[^/]*$", ""))
    path = F.regexp_replace(F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "/{2,}", "/"), "(?<=.)/$", "")
    return F.concat(scheme, F.lit("://"), host_of(base), path, filter_query(_part(base, 6), ignore))


def unwrap_archive_url(href: Column) -> Column:
    """The original URL inside an archive's playback URL, absolute or relative to its root; else null."""
    return F.nullif(F.regexp_extract(href, r"(?i)^(?:https?://web\.archive\.org)?/web/\d+[a-z_]*/(https?://.+)$", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path beginning with /, its . and .. segments resolved."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s)),
    )
    ends = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def join_url(base: Column, ref: Column) -> Column:
    """An absolute base and a reference, joined as RFC 3986 says (the fragment is not looked at)."""
    scheme, root, path = _part(base, 1), _part(base, 2), _part(base, 4)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    ref_path, ref_query = _part(ref, 4), _part(ref, 5)
    folder = F.regexp_replace(path, "[^/]*$", "")
    found = F.when(ref_path == "", path).when(F.startswith(ref_path, F.lit("/")), _without_dots(ref_path)).otherwise(_without_dots(F.concat(folder, ref_path)))
    query = F.when((ref_path == "") & (ref_query == ""), _part(base, 5)).otherwise(ref_query)
    return (
        F.when(ref == "", base)
        .when(_part(ref, 1) != "", ref)
        .when(_part(ref, 2) != "", F.concat(scheme, F.lit(":"), ref))
        .otherwise(F.concat(scheme, F.lit(":"), root, found, query))
    )


def resolve_href(href: Column, page_url: Column) -> Column:
    """The absolute original URL that a link on a page leads to, with its fragment; null for empty
    links and those that lead to no page."""
    base = without_fragment(href)
    target = F.coalesce(unwrap_archive_url(base), F.when(F.lower(base).rlike("^https?://"), base), join_url(page_url, base))
    return F.when((href != "") & ~F.lower(trimmed(href)).rlike(NO_PAGE), F.concat(target, fragment(href)))


def resolve_css_ref(ref: Column, css_url: Column) -> Column:
    """The absolute URL of a stylesheet's reference; null for empty ones and data."""
    ref = trimmed(F.regexp_replace(trimmed(ref), "^['\"]+|['\"]+$", ""))
    found = F.coalesce(unwrap_archive_url(ref), F.when(F.lower(ref).rlike("^https?://"), ref), F.when(F.startswith(ref, F.lit("//")), F.concat(F.lit("http:"), ref)), join_url(css_url, ref))
    return F.when((ref != "") & ~F.startswith(F.lower(ref), F.lit("data:")), found)


def host_in_scope(host: Column, base: Column) -> Column:
    """Whether a host is the base or below it; both are cleaned."""
    host, base = clean_host(host), clean_host(base)
    return (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def host_suffixes(host: Column) -> Column:
    """The host and all domains above it, for equality joins with a large scope."""
    labels = F.split(clean_host(host), "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_archive_host(host: Column) -> Column:
    return (host == "") | (host == "archive.org") | F.endswith(host, F.lit(".archive.org"))


def safe_segment(segment: Column) -> Column:
    safe = F.regexp_replace(percent_decoded(segment), UNSAFE, "_")
    return F.when(safe.isin("", ".", ".."), F.lit("_")).otherwise(F.substring(safe, 1, MOST))


def safe_host(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(host, UNSAFE_HOST, "_"), F.lit("")), F.lit("_host"))


def _extension(segment: Column) -> Column:
    return F.lower(F.substring_index(segment, ".", -1))


def stem_segments(path: Column) -> Column:
    """Safe segments of an already decoded path, each without a source extension."""
    safe = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), safe_segment)
    named = r"(?i)^(.+)\.(" + "|".join(SOURCE_EXTENSIONS) + ")$"
    return F.transform(safe, lambda s: F.regexp_replace(s, named, "$1"))


def query_segments(query: Column) -> Column:
    """a=1&b=2 as [a, 1, b, 2]; blank values are left out."""

    def one(token: Column) -> Column:
        name, value = F.substring_index(token, "=", 1), F.regexp_replace(token, "^[^=]*=", "")
        return F.when(F.contains(token, F.lit("=")) & (value != ""), F.array(safe_segment(name), safe_segment(value))).otherwise(F.array(safe_segment(name)))

    return F.flatten(F.transform(F.filter(F.split(query, "&"), lambda t: t != ""), one))


def has_asset_extension(segment: Column) -> Column:
    return F.contains(segment, F.lit(".")) & ~_extension(segment).isin(*SOURCE_EXTENSIONS)


def relative_path(from_file: Column, to_file: Column) -> Column:
    """The path of ``to_file`` as seen from the folder of ``from_file``."""
    here, there = F.split(from_file, "/"), F.split(to_file, "/")
    here = F.slice(here, F.lit(1), F.size(here) - 1)
    differs = F.filter(F.sequence(F.lit(1), F.least(F.size(here), F.size(there)) + 1), lambda i: ~F.coalesce(F.get(here, i - 1).eqNullSafe(F.get(there, i - 1)) & (i <= F.least(F.size(here), F.size(there))), F.lit(False)))
    common = F.array_min(differs) - 1
    up = F.array_repeat(F.lit(".."), (F.size(here) - common).cast("int"))
    down = F.slice(there, (common + 1).cast("int"), F.greatest(F.size(there) - common, F.lit(0)).cast("int"))
    return F.coalesce(F.nullif(F.array_join(F.concat(up, down), "/"), F.lit("")), F.lit("."))


def capture_url(timestamp: Column, original: Column) -> Column:
    return F.concat(F.lit(ARCHIVE + "/web/"), timestamp, F.lit("id_/"), original)


def raw_capture_url(url: Column) -> Column:
    """The first playback prefix with the modifier for raw bytes."""
    return F.regexp_replace(url, r"^(.*?web\.archive\.org/web/\d+)[a-z_]*/", "$1id_/")


def capture_timestamp(url: Column) -> Column:
    return F.regexp_extract(url, r"/web/(\d+)", 1)
