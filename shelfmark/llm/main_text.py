"""HTML extraction by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that stand for themselves; all other tags are part of the running text.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
#: Elements that are no part of an article.
LEFT = frozenset("nav footer aside dialog menu select search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form".split())
#: Words in classes and ids of what is no part of an article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs masthead "
    "topbar footer comment comments commentlist disqus replies respond share sharing social related recommended "
    "recommendations pagination pager toolbar".split()
)
#: Marks of places that also hold the title of a page.
_TITLES = frozenset("header banner masthead topbar".split())
#: Words that may stand beside marks in one name; with any other, as in has-sidebar or ad-free, it marks nothing.
_BESIDE = frozenset(
    "area article articles bar block body bottom box button buttons center column container entry "
    "form global group inline item items left link links list main page panel post posts primary right row "
    "secondary section site slot stories story text thread title top tree unit wrap wrapper".split()
)
_CLOSE_P = BLOCKS - {"html", "body", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: A start tag ends open elements of the first kind, as long as none of the second stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_EMPTY = frozenset(("hr",))
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marks(value: str) -> set[str]:
    """The marks among the names of a class or id, of those names that consist of marks and words beside them."""
    found: set[str] = set()
    for name in value.split():
        parts = set(_NAME.findall(name))
        marks = parts & _MARKS | parts & {"header"}
        if parts - marks <= _BESIDE:
            found |= marks
    return found


class _Page:
    """Block elements of a page in document order, with their texts."""

    def __init__(self, source: str) -> None:
        self.name: list[str] = ["#root"]
        self.parent: list[int] = [0]
        self.left: list[bool] = [False]  # never part of an article
        self.marked: list[bool] = [False]  # left unless the page's article or first heading is inside
        self.title: list[bool] = [False]  # marked, but as a place for titles only
        self.inside: list[bool] = [False]  # an article
        self.links: list[int] = [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._read(source)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.links.append(0)
        inside = self.inside[parent]
        self.inside.append(inside or name in ("article", "main"))
        left, marks = name in LEFT or (name == "header" and not inside), {"form"} & {name}
        if attributes and name not in ("html", "body", "main"):
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if key in ("class", "id"):
                    marks |= _marks(value) - ({"header"} if inside or name == "article" else set())
                elif name == "article":
                    continue
                elif key == "role":
                    left |= value in _ROLES
                else:
                    left |= key == "hidden" or value == "true" or (key == "style" and bool(_HIDDEN.search(value)))
        self.left.append(left)
        self.marked.append(bool(marks))
        self.title.append(bool(marks) and marks <= _TITLES)
        return len(self.name) - 1

    def _read(self, source: str) -> None:
        node, at, link = 0, 0, -1
        pieces: list[str] = []
        linked = 0
        name, parent = self.name, self.parent

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.runs.append((node, text, min(linked, len(text))))
                pieces.clear()
                linked = 0

        def close(names: frozenset | set, until: frozenset | set) -> None:
            """Leave the outermost open element of ``names`` below the next one of ``until``."""
            nonlocal node
            n, found = node, -1
            while n and name[n] not in until:
                if name[n] in names:
                    found = n
                n = parent[n]
            if found >= 0:
                flush()
                node = parent[found]

        size = len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else size]
            if text:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if link >= 0:
                    linked += len(text)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            end, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW:
                if not end and not attributes.endswith("/"):
                    after = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                    at = after.start() if after else size
            elif tag == "a":
                link = -1 if end else node
                self.links[node] += not end
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCKS:
                if end:
                    n = node
                    while n and name[n] != tag:
                        n = parent[n]
                    flush()
                    if n:
                        node = parent[n]
                else:
                    flush()
                    if tag in _CLOSE_P:
                        close({"p"}, BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
                    if tag in _ENDS:
                        close(*_ENDS[tag])
                    opened = self._open(tag, attributes, node)
                    if tag not in _EMPTY:
                        node = opened
                if link >= 0 and link > node:
                    link = -1  # its element was left
        flush()


def _densities(page: _Page, keep: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Composite text density and density sum of every element, and its characters.

    With C characters, T tags, and LC and LT those in links, of a subtree, the density is
    ``C / T * log(C / LC * T / LT)`` to the base ``C * LC / (C - LC) + LC' * C / C' + e``, where the
    primes are those of the whole page. Zero denominators count as 1, and text without
    any link has a logarithm of 1 at least. Tags inside a running text count only as links.
    """
    n = len(page.name)
    chars, linked, tags, links = [0] * n, [0] * n, [1] * n, list(page.links)
    own = [0.0] * n
    for node, text, in_links in page.runs:
        if keep[node]:
            chars[node] += len(text)
            linked[node] += in_links
            own[node] += len(text)
    for node in range(n - 1, 0, -1):
        if keep[node]:
            up = page.parent[node]
            chars[up] += chars[node]
            linked[up] += linked[node]
            tags[up] += tags[node] + links[node]
            links[up] += links[node]
    ratio = linked[0] / max(1, chars[0])
    density, total, children = [0.0] * n, [0.0] * n, [False] * n
    for node in range(n - 1, -1, -1):
        c, lc = chars[node], linked[node]
        if c and keep[node]:
            base = math.log(c * lc / max(1, c - lc) + ratio * c + math.e)
            argument = c / max(1, lc) * tags[node] / max(1, links[node])
            density[node] = c / tags[node] * math.log(max(1.0 if lc else math.e, argument)) / base
        if not children[node]:
            total[node] = density[node]
        else:
            total[node] += own[node]
        if node and keep[node]:
            up = page.parent[node]
            children[up] = True
            total[up] += density[node]
    return density, total, chars


def _anchor(page: _Page) -> int:
    """The page's first heading, or its article, for whose sake marked elements are kept; 0 for none.

    It is the first h1 that is in no marked element, or else the first in a place for titles
    only. If there is none, and no article or main outside of marked elements has text, it
    is the longest article in one, or else the first h1, if that holds more text than is
    outside of all marked elements. Forms count as marked; a page without all these, whose
    text is in forms only, has its longest form with a paragraph instead.
    """
    n, name, parent = len(page.name), page.name, page.parent
    left, top, strong = list(page.left), [0] * n, [0] * n  # the outermost marked element around, and that not for titles
    free = [0] * n  # the article or main around
    for node in range(1, n):
        up = parent[node]
        left[node] = left[node] or left[up]
        top[node] = top[up] or (node if page.marked[node] else 0)
        strong[node] = strong[up] or (node if page.marked[node] and not page.title[node] else 0)
        free[node] = free[up] or (node if name[node] in ("article", "main") else 0)
    headings = [i for i in range(1, n) if name[i] == "h1" and not left[i]]
    for marked in (top, strong):
        found = [i for i in headings if not marked[i]]
        if found:
            return found[0]
    chars, outside, article = [0] * n, 0, False
    for node, text, _ in page.runs:
        if not left[node]:
            chars[node] += len(text)
            if not strong[node]:
                outside += len(text)
                article |= free[node] > 0
    if article:
        return 0
    for node in range(n - 1, 0, -1):
        chars[parent[node]] += chars[node]
    articles = [i for i in range(1, n) if name[i] in ("article", "main") and strong[i] and not left[i]]
    if articles:
        best = max(articles, key=lambda i: (chars[i], -i))
        return best if chars[best] > outside else 0
    if headings:
        return headings[0] if chars[strong[headings[0]]] > outside else 0
    told = {strong[node] for node, *_ in page.runs if name[node] == "p"}
    forms = [i for i in told if name[i] == "form" and not left[i]]
    return max(forms, key=lambda i: (chars[i], -i)) if forms and not outside else 0


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in order, joined by two line feeds.

    Elements that are no article by name, role, class or id are left out, unless a form or one
    that only its class or id tells of holds the page's first heading or article (see
    :func:`_anchor`). A class or id tells by whole names, like ``comments`` or ``cookie-notice``;
    ``has-sidebar`` and ``ad-free`` are other names. Formulas are text. Of the rest,
    the element with the largest sum of its children's densities is the main text; the
    smallest density between it and the body is the threshold, and every element that
    reaches it adds the element of the largest sum inside it. An ``article`` or ``main`` element
    around a chosen one is taken whole, as are headings before it on the way to the body.
    Null, empty and text-free pages give an empty text.
    """
    if not source:
        return ""
    page = _Page(source)
    n, name, parent = len(page.name), page.name, page.parent
    holds = [False] * n
    node = _anchor(page) if any(page.marked) else 0
    while node:
        holds[node] = True
        node = parent[node]
    keep = [True] * n
    for node in range(1, n):
        keep[node] = keep[parent[node]] and not page.left[node] and not (page.marked[node] and not holds[node])
    density, total, chars = _densities(page, keep)
    if not chars[0]:
        return ""
    best = list(range(n))  # the element of the largest sum in a subtree, the outermost of equals
    for node in range(n - 1, 0, -1):
        up = parent[node]
        own = best[up] == up
        if keep[node] and (total[best[node]] > total[best[up]] or (total[best[node]] == total[best[up]] and not own)):
            best[up] = best[node]
    chosen = {best[0]}
    threshold, node = density[best[0]], best[0]
    while node:
        threshold = min(threshold, density[node])
        if name[node] == "body":
            break
        node = parent[node]
    chosen |= {best[i] for i in range(1, n) if keep[i] and chars[i] and density[i] >= threshold and total[i] > 0}
    taken = [False] * n
    for start in chosen:
        node, top = start, start
        while node:
            if name[node] in ("article", "main"):
                top = node
            node = parent[node]
        taken[top] = True
    first = best[0]
    above = set()
    node = first
    while node:
        node = parent[node]
        above.add(node)
    for node in range(1, n):
        heading = len(name[node]) == 2 and name[node][0] == "h" and name[node][1] in "123456"
        taken[node] = taken[node] or taken[parent[node]] or (heading and node < first and parent[node] in above)
    return "\n\n".join(text for node, text, _ in page.runs if taken[node] and keep[node])


def extract(
    pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars"
) -> DataFrame:
    """``pages`` without its html, with the main text and its code points.

    See :func:`main_text`. Rows are kept as they are; null ids and urls stay null; a column
    that already has the name of a new one is replaced; an empty table gives no rows.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)], F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            columns = [batch.column(i) for i in range(len(others))]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), sizes], [*others, text_col, chars_col])

    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema
    return rows.mapInArrow(run, schema.add(text_col, "string").add(chars_col, "long"))
