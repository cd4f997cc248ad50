"""Main-text extraction by line-block distribution.

A page is cut into lines at block elements. Each line has a weight: its characters
outside links, or 0 in page furniture (navigation, header, footer, sidebar, form,
advert, notice, comments; by element, role, or class and id words). Weights are
summed over a sliding window of lines. Reading rises into text at a surge point
(a weighted line whose window reaches the threshold) and leaves it at a dive point
(a window that is empty). The weighted lines between surge and dive are the text.

The threshold is ``min_block`` characters, and where no window reaches it the fullest
window's. A page that marks its article (``article``, ``main`` or role=main) has weight
only inside the mark. There a surge that reaches the threshold (at most ``least_share``
of the fullest window) begins where its windows rise from empty, so headlines and short
first lines stay, while a stray line apart from the text reaches no surge and goes.

Furniture that wraps the article mark, or most of the text of a page without one,
does not count as furniture, nor do the headings in an ``article``'s own header. An unclosed
head ends at the first block element.

Defined results: null, empty or markup-only html gives the empty string; unclosed
elements end with the page; an unclosed script, style or comment swallows the rest;
repeated rows are read alike; there are no ties to break; a very long page is read in
time linear in its length; the input's columns are kept in a struct, so their names
cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideline.llm.columns import row_of

#: Elements whose content is never text.
_SILENT = "script|style|noscript|template|iframe|object|svg|math|canvas|textarea|select|title"
#: Elements that are page furniture.
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "audio", "video"}
_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert",
    "alertdialog", "form", "toolbar",
}
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "comment", "comments", "commentlist", "disqus",
    "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal",
    "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related",
    "recommended", "toolbar", "skip", "copyright",
}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a new block of the same list closes.
_CLOSED_BY_BLOCK = {"p"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math|iframe|object)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    rf"|<(?P<silent>{_SILENT})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/><]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL | re.IGNORECASE,
)
#: How a token begins: a tag with its name, or a comment or declaration without.
_BEGINS = re.compile(r"<(?:[!?]|/?(?P<name>[a-zA-Z][^\s/><]*))")
_SILENT_NAMES = frozenset(_SILENT.split("|"))
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
#: A slash that ends a tag, and not the value of an attribute without quotes.
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


#: Why an element is furniture: hidden or by role; by its tag or a whole name; by a form's tag or a part of a name.
_HIDDEN, _NAMED, _LOOSE = 1, 2, 3


def _furniture(tag: str, attrs: str) -> int:
    """One of the three reasons, or 0."""
    found = 0
    if tag in _FURNITURE:
        found = _LOOSE if tag in ("form", "fieldset") else _NAMED
    if tag in ("html", "body", "article", "main") or not attrs:
        return found
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return found or _HIDDEN
        if name == "role" and value.lower() in _ROLES:
            return found or _HIDDEN
        if name in ("class", "id") and any(x.lower() in _NAMES for x in _PART.findall(value)):
            whole = any(x.lower() in _NAMES for x in value.split())
            found = min(found or _LOOSE, _NAMED if whole else _LOOSE)
    return found


def _wrappers(kinds: list[int], parents: list[int], raw: list[tuple[str, int, bool, int]], marks: list[int]) -> list[bool]:
    """Of each element that looks like furniture, whether it wraps the page's text and so does not count.

    ``parents`` are the furniture round it, which comes before it, or -1; lines and marks have their innermost
    furniture. While every mark of the article is inside furniture, the outermost element round
    the most marked text is a wrapper. On a page without marks, one known only loosely
    is if it holds most of the text. Weights are summed up the tree once.
    """
    open_ = [False] * len(kinds)
    if -1 in marks:
        return open_
    weights, fits, below = [0] * len(kinds), [False] * len(kinds), [[] for _ in kinds]
    total = 0
    for _, weight, inside, of in raw:
        total += weight
        if of >= 0:
            weights[of] += weight if inside or not marks else 0
            fits[of] |= not marks
    for of in marks:
        fits[of] = kinds[of] != _HIDDEN
    roots = []
    for x in range(len(kinds) - 1, -1, -1):
        up = parents[x]
        if not marks and kinds[x] != _LOOSE:
            below_fits, fits[x] = fits[x], False
        else:
            below_fits = fits[x]
        if up >= 0:
            weights[up] += weights[x]
            fits[up] |= below_fits and (not marks or kinds[up] != _HIDDEN)
            below[up].append(x)
        else:
            roots.append(x)
    direct = set(marks)
    heap = [(-weights[x], x) for x in roots if fits[x]]
    heapq.heapify(heap)
    while heap:
        less, x = heapq.heappop(heap)
        if not marks and -2 * less <= total:
            break
        open_[x] = True
        if x in direct:
            break
        for y in below[x]:
            if fits[y]:
                heapq.heappush(heap, (-weights[y], y))
    return open_


class _Ends:
    """Whether a tag that begins at a place ends at all. What one try has read, no later one reads again."""

    def __init__(self, page: str, stops: str):
        self.page, self.next = page, re.compile(f"[{stops}\"']")
        self.failed: set[int] = set()

    def at(self, place: int) -> bool:
        """Whether a ``>`` outside quotes comes before what stops a tag. ``place`` is outside quotes."""
        seen = []
        while place not in self.failed:
            seen.append(place)
            m = self.next.search(self.page, place)
            if m and m[0] == ">":
                return True
            close = self.page.find(m[0], m.end()) if m and m[0] in "\"'" else -1
            if close < 0:
                break
            place = close + 1
        self.failed.update(seen)
        return False


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and silent elements in order; a ``<`` that begins none is text."""
    shut, silent = _Ends(page, "<>"), _Ends(page, ">")
    at = page.find("<")
    while at >= 0:
        begins = _BEGINS.match(page, at)
        sure = begins and (not begins["name"] or (silent if begins["name"].lower() in _SILENT_NAMES else shut).at(begins.end()))
        m = _TOKEN.match(page, at) if sure else None
        if m:
            yield m
        at = page.find("<", m.end() if m else at + 1)


def page_lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """Lines as (text, weight or -1 for furniture, inside a marked article), and whether the page marks one."""
    raw: list[tuple[str, int, bool, int]] = []  # text, weight, inside, innermost furniture round it
    kinds: list[int] = []  # of each furniture element, why it is one
    parents: list[int] = []  # and the furniture round it
    within: list[int] = [-1]  # furniture that is open
    own: set[int] = set()  # headers of an article itself
    marks_at: list[int] = []
    parts: list[str] = []
    plain = 0  # characters outside links
    stack: list[tuple[str, bool, bool]] = []  # element, furniture, article
    where: dict[str, list[int]] = {}  # depths of the open elements of a tag
    blocks: list[int] = []  # depths of the open block elements
    article = links = 0
    head = False

    def cut() -> None:
        nonlocal plain
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                raw.append((text, min(len(text), plain), article > 0, within[-1]))
            parts.clear()
        plain = 0

    def pop_to(depth: int) -> None:
        nonlocal article, links
        while len(stack) > depth:
            tag, f, a = stack.pop()
            where[tag].pop()
            if tag in _BLOCK:
                blocks.pop()
            if f:
                within.pop()
            article -= a
            links -= tag == "a"

    def said(text: str) -> None:
        nonlocal plain
        if head:
            return
        text = entities.unescape(text)  # of a text node: a reference does not run across tags
        parts.append(text)
        if not links:
            plain += len(" ".join(text.split()))

    at = 0
    for m in _tokens(page):
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        attrs = m["attrs"] or ""
        opens = not m["close"]
        marks = opens and (tag in ("article", "main") or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None)
        kind = _furniture(tag, attrs) if opens and not marks else 0
        hides = kind > 0
        if tag == "head":
            head = opens
            continue
        # An unclosed head ends where the body or a block begins.
        head = head and not (opens and (tag in _BLOCK or marks))
        if tag in _BLOCK or hides or marks:
            cut()
            if opens and tag in _BLOCK and blocks:
                outer = stack[blocks[-1]][0]
                if outer in _CLOSED_BY_BLOCK or outer == tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    pop_to(blocks[-1])
        if opens:
            if tag not in _VOID and not _SELF_CLOSED.search(attrs):
                where.setdefault(tag, []).append(len(stack))
                if tag in _BLOCK:
                    blocks.append(len(stack))
                escapes = tag in _HEADINGS and not hides and within[-1] in own
                stack.append((tag, hides or escapes, marks))
                if escapes:
                    within.append(parents[within[-1]])
                if hides:
                    if where.get("article") and kind != _HIDDEN and (tag == "header" or "header" in attrs.lower()):
                        own.add(len(kinds))
                    parents.append(within[-1])
                    within.append(len(kinds))
                    kinds.append(kind)
                article += marks
                links += tag == "a"
                if marks:
                    marks_at.append(within[-1])
        else:
            if where.get(tag):
                depth = where[tag][-1]
                if any(f or a for _, f, a in stack[depth:]):
                    cut()
                pop_to(depth)
    if at < len(page):
        said(page[at:])
    cut()
    clear = _wrappers(kinds, parents, raw, marks_at)
    for x, up in enumerate(parents):  # whether all furniture round a place is wrappers
        clear[x] = clear[x] and (up < 0 or clear[up])
    clear.append(True)  # of -1
    lines = [(text, weight if clear[of] else -1, inside) for text, weight, inside, of in raw]
    return lines, any(clear[of] for of in marks_at)


def main_text(page: str | None, window: int = 3, min_block: int = 80, least_share: float = 0.125) -> str:
    if not page:
        return ""
    lines, marked = page_lines(page)
    if marked:  # a line that is all link still belongs to a marked article
        weights = [max(1, w) if inside and w >= 0 else 0 for _, w, inside in lines]
    else:
        weights = [max(0, w) for _, w, _ in lines]
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    fullest = max(sums, default=0)
    threshold = min(min_block, max(1, int(fullest * least_share)) if marked else fullest)
    kept, reading, rising = [], False, []
    for i, (text, _, _) in enumerate(lines):
        if not reading and weights[i] > 0 and sums[i] >= threshold > 0:
            reading = True  # surge
            kept += rising
        elif sums[i] == 0:
            reading = False  # dive
            rising = []
        if weights[i] > 0:
            if reading:
                kept.append(text)
            elif marked:
                rising.append(text)
    return "\n".join(kept)


def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``row``: the input's columns; ``text``: the page's main text, never null."""
    main_text_of = F.pandas_udf(_main_text, T.StringType())
    return pages.select(row_of(pages).alias("row"), F.col(html).cast("string").alias("html")).select(
        "row", F.coalesce(main_text_of("html"), F.lit("")).alias("text")
    )
