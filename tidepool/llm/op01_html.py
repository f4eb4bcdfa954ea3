"""HTML main text by line-block distribution.

Markup is stripped to lines: every block element's text is a line, with its length,
its characters inside links and the element it stands in.  Elements that never hold
the article (scripts, styles, navigation, page headers, footers, asides, forms,
hidden parts, and parts whose class or id is one for adverts, menus, notices,
comments, ...) give lines of length 0, as do lines that are mostly links.  A class or
id counts as a whole word of its value and never takes out an element with most of
the page's text, or with articles of its own that hold half of the text of all.  Where the page marks its
article (``article`` or ``main``), lines outside it have length 0, too, and parts
taken out inside it leave no line at all.

Sums of lengths over windows of ``WIDTH`` lines then show the article: sums rise from
0, surge to at least ``SURGE`` characters (or the page's highest sum, if less), and
dive to 0 again.  Lines with text between such a rise and its dive are kept, and so are lines of
links with text before and after them in the stretch; all stretches with a surge in page order.

Cases: null or empty html, or html without text, gives the empty string; broken
markup is read the way browsers do (open elements end with their parent, stray end
tags are ignored, a ``<`` that opens no tag is text); character references are
decoded once; repeated pages are extracted alike; columns other than the html pass
through.  A tag whose quoted value is never closed ends at its first ``>``; a self-closed tag holds
nothing.  One forward scan, a page at a time, linear for any markup: nothing is searched twice, and
stray end tags cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.common import table

WIDTH = 3
SURGE = 86
LINK_SHARE = 0.5

_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_TAG_STOP = re.compile(r"=\s*([\"'])|>")  # a quote opens a value after an equals sign only
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav footer aside form head button select object audio video canvas dialog menu fieldset".split())
_MAIN = frozenset(("article", "main"))
# an open element of these ends where one of its like begins
_ENDS = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
_SCOPE = frozenset("ul ol dl table tr td div section article main body blockquote aside nav footer header form".split())
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_TEXT = re.compile(
    r"(?:(?:site|page|global|main|top|bottom|left|right|primary|secondary|user|reader|post|article|entry|blog|cookie|email|social|nav)[-_]+)?"
    r"(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|"
    r"footer|masthead|site-header|page-header|topbar|comments?|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|skip-link|sr-only|tags)"
    r"(?:[-_]*\d+|[-_]+(?:list|area|section|bar|box|block|wrapper|container|links?|items?|buttons?|icons?|posts?|articles|stories|form|thread|unit|slot|banner|widget|notice|consent|menu|nav))*+",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _tag_end(html: str, at: int) -> int:
    """Where the ``>`` of a tag is whose name ends at ``at``; -1 if there is none.

    A quoted value ends at the next quote of its kind, if white space, a slash or the tag's end
    follows; any other quote opens the value of a later tag, and the tag ends at the first ``>``.
    """
    while stop := _TAG_STOP.search(html, at):
        if not stop[1]:
            return stop.start()
        close = html.find(stop[1], stop.end())
        if close < 0 or not (html[close + 1 : close + 2].isspace() or html[close + 1 : close + 2] in ("/", ">")):
            return html.find(">", stop.end())
        at = close + 1
    return -1


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, is end tag, name, attributes) of each piece of markup, in one scan; comments and
    declarations have no name.  What follows an end that the caller sends is looked at next."""
    at, last = 0, html.rfind(">")  # beyond it no tag ends
    while m := _OPENS.search(html, at):
        name, attributes = (m[2] or "").lower(), ""
        if m[0] == "<!--":
            empty = re.compile(r"-?>").match(html, m.end())
            stop = empty.end() if empty else html.find("-->", m.end()) + 3
            at = stop if stop > 2 else len(html)
        else:
            stop = -1 if m.start() > last else _tag_end(html, m.end()) if name else html.find(">", m.end())
            if stop < 0:  # a "<" that opens no tag is text
                at = m.end()
                continue
            at, attributes = stop + 1, html[m.end() : stop]
        skip_to = yield m.start(), at, bool(m[1]), name, attributes
        if skip_to is not None:
            at = skip_to


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends with a slash of its own, not one of an unquoted value."""
    rest = attributes[:-1]
    return attributes.endswith("/") and (not rest or rest[-1].isspace() or rest[-1] in "\"'" or "=" not in rest.rsplit(None, 1)[-1])


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element never holds the article, and whether its class or id says so."""
    if name in _NEVER or name == "header" and not in_article:
        return True, False
    named = False
    if not attributes or name in ("html", "body"):
        return False, False
    for m in _ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in _MAIN and any(map(_NOT_TEXT.fullmatch, value.split())):
            named = True
        if key in ("class", "id") and name in _MAIN and re.search(r"\bcomments?\b", value, re.I):
            return True, False
        if key == "role" and value.lower() in _ROLES:
            return True, False
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return True, False
    return False, named


def _without_named(lines: list[tuple[str, bool, bool, int]], named: list[tuple[int, int, bool]]) -> list[tuple[str, bool, bool, int]]:
    """``lines`` with those in ``named`` stretches (begin, end, in article) as boilerplate, unless a stretch is the page's text."""
    if not named:
        return lines
    of_text = [0 if boilerplate or link_chars > LINK_SHARE * len(text) else len(text) for text, boilerplate, _, link_chars in lines]
    text_to = [0, *accumulate(of_text)]
    article_to = [0, *accumulate(n if article else 0 for n, (_, _, article, _) in zip(of_text, lines, strict=True))]
    depth = [0] * (len(lines) + 1)
    for begin, end, in_article in named:
        most = 2 * (text_to[end] - text_to[begin]) > text_to[-1]
        articles = 0 if in_article else article_to[end] - article_to[begin]
        if not most and not (articles and 2 * articles >= article_to[-1]):
            depth[begin] += 1
            depth[end] -= 1
    return [(text, boilerplate or d > 0, article, link_chars) for (text, boilerplate, article, link_chars), d in zip(lines, accumulate(depth[:-1]), strict=True)]


def lines_of(html: str) -> list[tuple[str, bool, bool, int]]:
    """(text, in boilerplate, in article, characters inside links) of each block, in page order."""
    out: list[tuple[str, bool, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, is boilerplate, first line if named as boilerplate, else -1
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    scopes: list[int] = []  # where the open containers are
    named: list[tuple[int, int, bool]] = []
    parts: list[str] = []
    link_chars = skip = articles = links = 0

    def end_line() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((text, skip > 0, articles > 0, link_chars))
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = unescape(raw)
            parts.append(text)
            if links:
                link_chars += len(" ".join(text.split()))

    def close(upto: int) -> None:
        """Close the open elements from ``upto`` on."""
        nonlocal skip, articles, links
        while len(stack) > upto:
            name, boilerplate, begin = stack[-1]
            if name in _BLOCK:
                end_line()
            stack.pop()
            places[name].pop()
            if name in _SCOPE:
                scopes.pop()
            skip -= boilerplate
            articles -= name in _MAIN
            if begin >= 0:
                named.append((begin, len(out), articles > 0))
            links -= name == "a"

    def innermost(name: str) -> int:
        """Where the innermost open element of a name is; -1 if none is open."""
        return places[name][-1] if places.get(name) else -1

    text_from = 0
    scan = _tags(html)
    tag = next(scan, None)
    while tag is not None:
        begin, end, is_end, name, attributes = tag
        add(html[text_from:begin])
        skip_to = None
        if not name or not is_end and name in ("svg", "math") and _self_closed(attributes):
            pass
        elif is_end:
            if innermost(name) >= 0:
                close(innermost(name))
        elif name in _RAW_END:
            stop = _RAW_END[name].search(html, end)
            skip_to = end = stop.end() if stop else len(html)
        else:
            if name in _BLOCK:
                # a block ends an open paragraph and the open element of its like, within the nearest container
                like = max(map(innermost, ("p", *_ENDS.get(name, ()))))
                if like >= 0 and like >= (scopes[-1] if scopes else 0):
                    close(like)
                end_line()
            if name == "br":
                parts.append(" ")
            if name not in _VOID and not attributes.endswith("/"):
                boilerplate, is_named = _is_boilerplate(name, attributes, articles > 0)
                places.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append((name, boilerplate, len(out) if is_named else -1))
                skip += boilerplate
                articles += name in _MAIN
                links += name == "a"
        text_from = end
        try:
            tag = scan.send(skip_to)
        except StopIteration:
            tag = None
    add(html[text_from:])
    close(0)
    end_line()
    return _without_named(out, named)


def main_lines(lines: list[tuple[str, bool, bool, int]]) -> list[str]:
    """Lines between surge and dive of the line-block distribution."""
    marked = any(article and not boilerplate for _, boilerplate, article, _ in lines)
    rows: list[tuple[str, int, bool]] = []  # text, length, is a line of links
    for text, boilerplate, article, link_chars in lines:
        if marked and article:
            if not boilerplate:
                rows.append((text, len(text), False))
        else:
            eligible, of_links = not boilerplate and not marked, link_chars > LINK_SHARE * len(text)
            rows.append((text, len(text) if eligible and not of_links else 0, eligible and of_links))
    lengths = [n for _, n, _ in rows]
    window = [sum(lengths[k : k + WIDTH]) for k in range(len(lengths))]
    surge = min(SURGE, max(window, default=0))
    kept: list[str] = []
    begin = 0
    for k in range(len(rows) + 1):
        if k == len(rows) or not window[k]:  # a dive: the stretch before it counts if it surged
            if begin < k and max(window[begin:k]) >= surge:
                full = [j for j in range(begin, k) if lengths[j]]
                kept += [text for text, n, of_links in rows[full[0] : full[-1] + 1] if n or of_links]
            begin = k + 1
    return kept


def main_text(html: str | None) -> str:
    return "\n\n".join(main_lines(lines_of(html or "")))


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out``; the html column is dropped, all others pass through."""
    kept = [c for c in pages.columns if c not in (html_col, out)]
    rows = pages.select(*kept, F.col(html_col))
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], texts], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
