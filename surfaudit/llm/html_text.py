"""Main text of web pages from a stream of parser events.

Events become lines (one per block of text) with their text-to-tag ratio; ratios are smoothed
with a Gaussian and lines above the threshold are content (the CETR method of Weninger, Hsu and
Han, 2010).  The content region is the element that holds the bulk of those lines, or all articles,
so its short lines come along, as do headings before it and content lines beside it; parts of the page that are named or marked up as menus, adverts, comments and
the like are cut out of it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SIGMA = 1.0  # of the Gaussian, in lines
REACH = 2  # lines on either side that it takes in
BULK = 0.8  # share of the content that an element must hold to be gone into
TRUSTED = 0.4  # share of the content from which an article or main element is taken at its word
LINK_SHARE = 0.9  # share of link text from which a list is a menu

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(  # elements whose text is never part of an article
    "annotation annotation-xml aside audio button canvas datalist dialog footer form head iframe input label menu nav noscript object optgroup option "
    "script select style svg template textarea title video".split()
)
NAMED = frozenset(  # words of a class or id that say the same
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner "
    "cookie cookies consent gdpr notice notices notification alert toast popup modal overlay paywall subscribe subscription newsletter "
    "signup login search menu nav navbar navigation breadcrumb breadcrumbs pagination pager topbar masthead footer colophon copyright "
    "sidebar aside rail widget widgets related recommended share sharing social comment comments commentlist respond reply replies "
    "disqus discussion reactions feedback form".split()
)
NAMED_STEMS = ("cookie", "advert", "sponsor", "newsletter", "breadcrumb", "sidebar", "subscri", "navbar", "commentlist", "commentform", "commentbox")
THREADS = frozenset("comment comments commentlist commentbox respond reply replies disqus".split())  # as dense as articles
REMARKS = frozenset("comment comments commentlist commentbox respond reply replies disqus discussion reactions feedback".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# An element in the first column ends the nearest open one of the second, unless one of the third is in between.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
BARRIERS = frozenset("table td th caption template object".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Events(HTMLParser):
    """Collects elements (in page order, parents first) and lines of text pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.banned, self.core, self.inside = ["html"], [-1], [False], [False], [False]
        self.doubtful = [False]  # cut out for a name alone
        self.open, self.open_tags = [0], Counter()
        self.lines: list[tuple[int, int, list[tuple[int, str]]]] = []  # (element, tags, pieces)
        self.pieces: list[tuple[int, str]] = []
        self.tags = 0

    def flush(self) -> None:
        if any(not t.isspace() for _, t in self.pieces):
            self.lines.append((self.open[-1], self.tags, self.pieces))
            self.tags = 0
        self.pieces = []

    def _close_to(self, names: tuple[str, ...], barriers) -> None:
        if not any(self.open_tags[n] for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in names:
                self.open_tags.subtract(self.tag[k] for k in self.open[i:])
                del self.open[i:]
                return
            if tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self._close_to(("p",), BARRIERS)
            if tag in IMPLIED_END:
                self._close_to(*IMPLIED_END[tag])
        self.tags += 1
        if tag == "br":
            self.pieces.append((self.open[-1], " "))
        if tag in VOID:
            return
        banned, core, doubtful = self._judge(tag, attrs)
        self.doubtful.append(doubtful)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.banned.append(banned)
        self.core.append(core)
        self.inside.append(self.inside[self.open[-1]] or tag in ("article", "main"))
        self.open.append(len(self.tag) - 1)
        self.open_tags[tag] += 1

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self._close_to((tag,), BARRIERS - {tag})

    def handle_data(self, data):
        self.pieces.append((self.open[-1], data))

    def _judge(self, tag, attrs) -> tuple[bool, bool, bool]:
        """(cut out, is the article's own element, cut out for a name that a part of an article may bear)."""
        given = {k: v or "" for k, v in attrs}
        words = {w.lower() for w in _WORD.findall(f"{given.get('class', '')} {given.get('id', '')}")}
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))
        role = given.get("role", "").lower()
        if tag in ("html", "body"):
            return False, False, False
        if tag in ("article", "main") or role in ("main", "article"):
            return hidden or bool(words & REMARKS), not words & (REMARKS | {"related", "teaser", "ad", "promo"}), False
        if tag == "header" or "header" in words:
            return not self.inside[self.open[-1]], False, False
        if tag in HEADINGS or tag == "p":  # ids of these are made from their text
            words = {w.lower() for w in _WORD.findall(given.get("class", ""))}
        named = bool(words & NAMED) or any(w.startswith(NAMED_STEMS) for w in words)
        other = hidden or tag in SILENT or role in ROLES or bool(words & THREADS)
        return other or named, False, named and not other


def _smoothed(ratios: list[float]) -> list[float]:
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-REACH, REACH + 1)]
    n, out = len(ratios), []
    for i in range(n):
        near = [(w, ratios[i + d]) for d, w in enumerate(weights, -REACH) if 0 <= i + d < n]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, white space inside a block made one space, joined by line feeds."""
    if not html:
        return ""
    events = _Events()
    events.feed(html)
    events.close()
    events.flush()
    tag, parent, n = events.tag, events.parent, len(events.tag)

    holds = [False] * n  # the article's element lies inside: then it is no menu, whatever its name
    for i in range(n):
        at = i
        while events.core[i] and at >= 0 and not holds[at]:
            holds[at] = True
            at = parent[at]
    cut = [events.banned[i] and not (holds[i] and not events.core[i]) for i in range(n)]
    text, regions = _select(events, cut)
    within = [False] * n
    for i in range(n):
        up = parent[i]
        within[i] = i > 0 and (within[up] or events.inside[up] or (up in regions and tag[up] not in ("html", "body")))
    doubtful = [i for i in range(n) if events.doubtful[i] and cut[i] and within[i]]
    if doubtful:
        for i in doubtful:
            cut[i] = False
        if not _clear(events, cut, doubtful):
            return text
        text, _ = _select(events, cut)
    return text


def _below(cut: list[bool], parent: list[int]) -> list[bool]:
    out = [False] * len(cut)
    for i in range(1, len(cut)):
        out[i] = out[parent[i]] or cut[i]
    return out


def _ends(parent: list[int]) -> list[int]:
    """Where the elements below each one end: elements stand in page order, so these are a run."""
    end = list(range(1, len(parent) + 1))
    for i in range(len(parent) - 1, 0, -1):
        end[parent[i]] = max(end[parent[i]], end[i])
    return end


def _links(tag: list[str], parent: list[int]) -> list[int]:
    """The innermost link around each element, itself included; -1 for none."""
    out = [-1] * len(tag)
    for i in range(len(tag)):
        out[i] = i if tag[i] == "a" else out[parent[i]] if i else -1
    return out


def _clear(events: _Events, cut: list[bool], doubtful: list[int]) -> bool:
    """Cuts those of ``doubtful`` without a line as dense as content, or with links for text; True if one stays."""
    tag, parent, n = events.tag, events.parent, len(events.tag)
    banned, end, link = _below(cut, parent), _ends(parent), _links(tag, parent)
    densest, chars, links, ratios = [0.0] * n, [0] * n, [0] * n, []
    for element, tags, pieces in events.lines:
        size = len(" ".join("".join(t for e, t in pieces if not banned[e]).split()))
        if size and not banned[element]:
            ratios.append(size / max(1, tags))
            for e, t in pieces:
                if not banned[e]:
                    densest[e] = max(densest[e], ratios[-1] if e == element else len(t) / 2)  # inline: its own text and two tags
                    chars[e] += len("".join(t.split()))
                    links[e] += len("".join(t.split())) if _inside(e, element, link, end) else 0
    for i in range(n - 1, 0, -1):
        up = parent[i]
        densest[up] = max(densest[up], densest[i])
        chars[up] += chars[i]
        links[up] += links[i]
    threshold = _threshold(_smoothed(ratios)) if ratios else 0.0
    for i in doubtful:
        cut[i] = densest[i] < threshold or links[i] >= LINK_SHARE * chars[i]
    return not all(cut[i] for i in doubtful)


def _threshold(ratios: list[float]) -> float:
    mean = sum(ratios) / len(ratios)
    return min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))


def _select(events: _Events, cut: list[bool]) -> tuple[str, set[int]]:
    """The text that is left without the elements of ``cut``, and the elements it was taken from."""
    tag, parent, n = events.tag, events.parent, len(events.tag)
    banned, end, link = _below(cut, parent), _ends(parent), _links(tag, parent)
    lines, own, links = [], [], [0] * n  # own: link text of a line
    for element, tags, pieces in events.lines:
        text = " ".join("".join(t for e, t in pieces if not banned[e]).split())
        if text and not banned[element]:
            lines.append((element, tags, text))
            own.append(sum(len("".join(t.split())) for e, t in pieces if not banned[e] and _inside(e, element, link, end)))
            links[element] += own[-1]
    if not lines:
        return "", set()
    ratios = _smoothed([len(text) / max(1, tags) for _, tags, text in lines])
    threshold = _threshold(ratios)
    hot = [r >= threshold for r in ratios]

    chars, bulk = [0] * n, [0] * n  # all text and content text below an element
    for (element, _, text), h in zip(lines, hot):
        chars[element] += len("".join(text.split()))
        bulk[element] += len(text) if h else 0
    largest = [-1] * n  # child with most content
    for i in range(n - 1, 0, -1):
        up = parent[i]
        chars[up] += chars[i]
        bulk[up] += bulk[i]
        links[up] += links[i]
        if largest[up] < 0 or bulk[i] >= bulk[largest[up]]:
            largest[up] = i
    raw = [len(text) / max(1, tags) for _, tags, text in lines]
    solid = [hot[i] and raw[i] >= threshold and own[i] < LINK_SHARE * len("".join(lines[i][2].split())) for i in range(len(lines))]
    regions, scope = _regions(events, banned, bulk, largest, end, [e for (e, _, _), s in zip(lines, solid) if s])

    menu, within, near = [False] * n, [False] * n, [False] * n
    for i in range(n):
        up = parent[i]
        within[i] = i in regions or (up >= 0 and within[up])
        near[i] = i == scope or (up >= 0 and near[up])
        listed = tag[i] in ("ul", "ol", "dl") and chars[i] > 0 and links[i] >= LINK_SHARE * chars[i]
        menu[i] = listed or (up >= 0 and menu[up])
    kept = [i for i, (element, _, _) in enumerate(lines) if not menu[element] and (within[element] or (near[element] and solid[i]))]
    if all(tag[r] in ("html", "body") for r in regions):  # no element of its own: from the first content line to the last
        strong = [i for i in kept if hot[i]]
        kept = [i for i in kept if strong and strong[0] <= i <= strong[-1]]
    elif kept and not any(tag[lines[i][0]] == "h1" for i in kept):  # its title stands outside
        before = [i for i in range(kept[0]) if tag[lines[i][0]] in HEADINGS and not menu[lines[i][0]]]
        title = [i for i in before if tag[lines[i][0]] == "h1"][-1:]
        while before and before[-1] == kept[0] - 1:
            kept.insert(0, before.pop())
        kept = sorted({*kept, *title})
    return "\n".join(lines[i][2] for i in kept), regions


def _inside(element: int, line: int, link: list[int], end: list[int]) -> bool:
    """The piece is link text: a link lies between it and its line."""
    return link[element] >= 0 and (link[element] >= line or not line <= element < end[line])


def _regions(events: _Events, banned: list[bool], bulk: list[int], largest: list[int], end: list[int], solid: list[int]) -> tuple[set[int], int]:
    """The elements taken whole, and the one around them whose other content lines (their elements: ``solid``) come along.

    All articles if they have enough of the content, or the main element; else the smallest
    element with the bulk, gone into only while no content line stays outside.
    """
    total, solid = bulk[0], sorted(solid)
    lines_in = lambda e: bisect_left(solid, end[e]) - bisect_left(solid, e)
    for names in (("article",), ("main",)):
        own = [i for i, core in enumerate(events.core) if core and not banned[i] and (events.tag[i] in names or names == ("main",))]
        own = [i for i in own if bulk[i] > 0]
        top: list[int] = []
        for i in own:
            if not top or i >= end[top[-1]]:
                top.append(i)
        if top and sum(bulk[i] for i in top) >= TRUSTED * total:
            around = [i for i, core in enumerate(events.core) if core and not banned[i] and i < top[0] and top[-1] < end[i]]
            return set(top), max(around, default=-1)
    at = 0
    while largest[at] >= 0 and events.tag[largest[at]] in BLOCKS and bulk[largest[at]] >= BULK * total and bulk[largest[at]] > 0:
        into = largest[at]
        if events.tag[into] in (*HEADINGS, "p", "li", "td", "blockquote", "pre"):
            break
        if lines_in(at) > lines_in(into):
            return {into}, at
        at = into
    return {at}, -1


def extract_text(html: Column | str) -> Column:
    """Main text of a page; null and empty pages give an empty one."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(html)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; repeated rows and null ids are rows of their own.

    Null and empty html, and a page without text, give an empty text.  Pages are read whole; the
    work per element does not grow with the length of the page or the depth of its nesting.  Other
    columns are not read.
    """
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extract_text(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
