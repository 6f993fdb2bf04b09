"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Lines in a sliding window, and the characters in one from which text surges.
WINDOW, SURGE = 3, 86
#: What a line in a marked article weighs more: as many such lines as a window holds surge.
BONUS = SURGE // WINDOW + 1

# Element names by their role in HTML, and words in class, id or role
# attributes that mark what is not the article.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form menu dialog select button fieldset object applet map datalist".split())
MARKED = frozenset("article main".split())
# End tags that may be left out: which elements a start tag ends, and what lies between at most.
P_ENDS = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
ROW, CELL = frozenset("tr td th caption".split()), frozenset("td th".split())
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]), "td": CELL, "th": CELL, "tr": ROW}
ENDS |= dict.fromkeys(("tbody", "thead", "tfoot"), ROW | {"tbody", "thead", "tfoot"})
LOOSE = frozenset("address div p".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
PARTS = BLOCK | NEVER | MARKED | {"body", "optgroup"}
OTHER = re.compile(
    r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup"
    r"|sidebars?|rail|widgets?|related|recommend\w*|menus?|nav\w*|breadcrumbs?|pagination|pager|masthead|topbar|footers?|copyright"
    r"|comments?|commentlist|disqus|respond|repl(?:y|ies)|share|sharing|social|toolbar|login|search|forms?",
    re.I,
)
# With these a word above makes a compound that is as foreign: cookie-bar, site-footer, related-posts.
BESIDE = re.compile(r"site|page|main|global|top|bottom|primary|secondary|posts?|list|items?|box|block|area|container|wrap(?:per)?|inner|bar|links?|buttons?|icons?|section|thread|unit|slot|policy|text|title|message|\d+", re.I)
HEADER = re.compile(r"(?:(?:site|page|main|top|global)[_-]?)?header", re.I)
ROLE = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())

#: Elements whose content is no markup of the page's text.
RAW = frozenset("script style noscript template svg iframe textarea annotation annotation-xml canvas audio video".split())
#: What a form has in it that is the wrapper of a whole page.
PAGE = frozenset("h1 nav header footer article main".split())
# Comments, tags, and other declarations, each up to its end or the page's. A quote holds a >
# only after an =. Nothing is gone back over, so the time is in proportion to the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


def _other(value: str, in_article: bool) -> bool:
    """Whether a class or id names what is not the article: by a whole name, never by a part of one."""
    for token in value.split():
        if OTHER.fullmatch(token) or not in_article and HEADER.fullmatch(token):
            return True
        parts = [x for x in re.split("[_-]+", token) if x]
        if len(parts) > 1 and any(map(OTHER.fullmatch, parts)) and all(OTHER.fullmatch(x) or BESIDE.fullmatch(x) for x in parts):
            return True
    return False


def _foreign(name: str, attrs: str, in_article: bool, named: bool = True) -> bool:
    """Whether an element and all in it lie outside the article's text; ``named``: also by class
    or id, and as a header or form."""
    if name in NEVER and (named or name != "form") or named and name == "header" and not in_article:
        return True
    if not attrs:
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if named and key in ("class", "id") and name not in ("html", "body") and _other(value, in_article):
            return True
        if key == "role" and value.lower() in ROLE or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _ends(tags: list[tuple[str, bool, str, int, int]]) -> list[int]:
    """Of each start tag (name, closing, attrs ...), the number of the tag that ends its element.

    That is its end tag, the next one of an element around it, a start tag before which HTML
    lets its end tag be left out, ``</body>``, or the page's end. An end tag of what is not
    open has no effect, and one of a phrase (``</b>``) ends no block.
    """
    ends = [len(tags)] * len(tags)
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = {}  # of each name the places in the stack

    def pop_to(depth: int, at: int) -> None:
        while len(stack) > depth:
            name, i = stack.pop()
            ends[i] = at
            open_at[name].pop()

    def innermost(names: Iterable[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=-1)

    def last(names: frozenset[str], walls: frozenset[str]) -> int:
        """The innermost open element of these names, unless there is a wall within it."""
        d = innermost(names)
        return d if d > innermost(walls - names) else -1

    for i, (name, closing, _, _, _) in enumerate(tags):
        if closing:
            if name in ("body", "html"):
                pop_to(0, i)
            elif open_at.get(name):
                d = innermost((name,)) if name in PARTS else last(frozenset([name]), PARTS)
                if d >= 0:
                    pop_to(d, i)
            continue
        if name in P_ENDS and open_at.get("p") and (d := last(frozenset(["p"]), PARTS)) >= 0:
            pop_to(d, i)
        if names := ENDS.get(name):
            if name in TABLE:
                while (d := last(names, frozenset(["table"]))) >= 0:
                    pop_to(d, i)
            elif (d := last(names, PARTS - LOOSE - (frozenset(["option"]) if name == "optgroup" else frozenset()))) >= 0:
                pop_to(d, i)
                if name == "optgroup" and stack and stack[-1][0] == "optgroup":
                    pop_to(len(stack) - 1, i)
        if name in VOID:
            ends[i] = i
        else:
            open_at.setdefault(name, []).append(len(stack))
            stack.append((name, i))
    return ends


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """The page stripped of markup: (text, characters outside links, the marked article it lies in:
    1 for the first outermost one, 0 for none).

    A line ends at every block element and line break. What lies in a foreign element is one
    empty line, so that the text there dives; in a marked article, what lies in foreign
    elements that follow each other is one such line. Neither a marked article (unless it
    lies in another one) nor what holds one is foreign by its class or id, nor is a form that
    the whole page lies in.
    """
    lines: list[tuple[str, int, int]] = []
    text: list[str] = []
    linked = 0
    links = article = posts = which = 0  # posts: the articles among the marked elements that are open
    tags, pieces, at = [], [], 0  # the text before each tag, and after the last one
    while token := TOKEN.search(html, at):
        pieces.append(html[at : token.start()])
        at = token.end()
        if name := (token["name"] or "").lower():
            if name not in RAW:
                tags.append((name, bool(token["end"]), token["attrs"], len(pieces) - 1, at))
            elif not token["end"] and not re.search(r"(?:^|[\s\"'])/$", token["attrs"]):
                close = CLOSE[name].search(html, at)
                at = close.end() if close else len(html)
    pieces.append(html[at:])
    ends = _ends(tags)
    # Characters before each piece, and tags of the page's own parts before each tag.
    chars = [0, *accumulate(len(x.strip()) for x in pieces)]
    parts = [0, *accumulate(t[0] in PAGE and not t[1] for t in tags)]
    body = next((t[3] + 1 for t in reversed(tags) if t[0] == "body" and not t[1] or t[0] in ("head", "title") and t[1]), 0)

    def whole(i: int) -> bool:
        """Whether a form is the wrapper of the page: it has the page's parts, or all its text."""
        stop = ends[i]
        if parts[stop] > parts[i + 1]:
            return True
        last = tags[stop][3] + 1 if stop < len(tags) else len(pieces)
        return chars[last] - chars[tags[i][3] + 1] == chars[-1] - chars[min(body, tags[i][3] + 1)] > 0

    # Marked articles that end what is skipped: those that are foreign in no way.
    clean = [i for i, t in enumerate(tags) if t[0] in MARKED and not t[1] and not _foreign(t[0], t[2], True)]

    def end_line() -> None:
        nonlocal linked
        if text:
            if line := " ".join(unescape("".join(text)).split()):
                lines.append((line, max(0, len(line) - linked), which if article else 0))
            text.clear()
            linked = 0

    def add(first: int, last: int) -> None:
        nonlocal linked
        for piece in pieces[first:last]:
            if piece:
                text.append(piece)
                if links:
                    linked += len(piece)

    i, piece = 0, 0
    while i < len(tags):
        name, closing, attrs, before, _ = tags[i]
        add(piece, before + 1)
        piece = before + 1
        if name == "a":
            links = 0 if closing else 1
        elif name in BLOCK or name in MARKED:
            end_line()
            links = 0
            if name in MARKED and closing:
                article = max(0, article - 1)
                posts = max(0, posts - (name == "article"))
        if closing or name in VOID:
            i += 1
            continue
        inside = bisect_right(clean, i)  # the next clean article
        inner = clean[inside] if inside < len(clean) and clean[inside] < ends[i] else None
        named = inner is None and not (name in MARKED and not posts) and not (name == "form" and whole(i))
        if _foreign(name, attrs, article > 0, named):
            end_line()
            if not (article and lines and lines[-1][:2] == ("", 0) and lines[-1][2]):
                lines.append(("", 0, which if article else 0))
            if not attrs.endswith("/"):
                links = 0
                if inner is not None:
                    i, piece = inner, tags[inner][3] + 1  # not closed, or around the article itself
                    continue
                stop = ends[i]
                if stop == len(tags):
                    return lines
                i, piece = stop, tags[stop][3] + 1
                if tags[stop][1] and tags[stop][0] == name:
                    i += 1
                continue
        elif name in MARKED:
            which += article == 0
            article += 1
            posts += name == "article"
        i += 1
    add(piece, len(pieces))
    end_line()
    return lines


def main_text(html: str | None) -> str:
    """The text between the surges and dives of the line-block distribution.

    The weight of a line is its number of characters outside links, and 0 in foreign
    elements. A line that has such characters and lies in a marked article weighs ``BONUS``
    more, less than ``SURGE``, so the lengths decide on every page. With s[i] the weight of the ``WINDOW`` lines from i on,
    text surges at the first s[i] over ``SURGE`` and dives where s falls to 0 or a marked
    article begins or ends, so that neither side carries the other; the lines between with
    text of their own are joined by a line feed. What surges outside of marked articles stays
    only if it has as much text, all together, as surges in the longest of them:
    blocks that no name tells from the article are shorter than it, while a teaser or a
    comment that is marked does not replace the text beside it. A page in which nothing surges
    gives the lines of its heaviest run. None and a page without text give "".
    """
    if not html:
        return ""
    lines = lines_of(html)
    weights = [own + BONUS if marked and own else own for _, own, marked in lines]
    n = len(lines)
    sums = [0] * n
    runs: list[tuple[int, int]] = []  # where the windows' sums stay above 0
    i = 0
    while i < n:
        j = i
        while j < n and bool(lines[j][2]) == bool(lines[i][2]):
            j += 1
        start = None
        for k in range(i, j):
            sums[k] = sum(weights[k : min(k + WINDOW, j)])
            if sums[k] and start is None:
                start = k
            elif not sums[k] and start is not None:
                runs.append((start, k))
                start = None
        if start is not None:
            runs.append((start, j))
        i = j
    surging = [run for run in runs if max(sums[run[0] : run[1]]) > SURGE]
    sizes: dict[int, int] = {0: 0}  # of what surges in each marked article, and beside them
    for k in (k for run in surging for k in range(*run)):
        sizes[lines[k][2]] = sizes.get(lines[k][2], 0) + lines[k][1]
    if sizes[0] < max(sizes.values()):
        surging = [run for run in surging if lines[run[0]][2]]
    kept = surging or sorted(runs, key=lambda r: -sum(weights[r[0] : r[1]]))[:1]
    out: list[str] = []
    for i, j in kept:
        while i < j and not weights[i] and not lines[i][2]:  # a window surges before its first heavy line
            i += 1
        while j > i and not weights[j - 1]:
            j -= 1
        out += [lines[k][0] for k in range(i, j) if lines[k][0]]
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    The whole html is read. A null or empty html, and one without text, gives "" and 0;
    null ids and urls stay null; repeated rows give repeated results; an empty table gives
    an empty result. Broken markup never fails: an element that is never closed ends with
    the page, and one that hides a marked article does not hide it. Other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return small_batches(pages).select("page_id", "url", html_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op2(pages: DataFrame) -> DataFrame:
    return extract(pages)
