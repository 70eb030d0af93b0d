"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams a page's events. Text between two
block-level tags is a line, in menus and footers too. For each line the
text-to-tag ratio is taken (its characters outside links over the tags met in
it), the ratios are smoothed with a Gaussian along the page, and a threshold
between two clusters of smoothed ratios marks the lines of content. They select
the content regions:

* an ``article`` or ``main`` with a marked line (all of them, if none has one);
* on a page that has such an element, text outside of it only where the smoothed
  ratio is ``OUTSIDE`` times the threshold;
* wherever they are, elements whose class or id hints at adverts, sharing or
  promotion only where it is ``HINTED`` times the threshold;
* on other pages the innermost container of most of the marked text, with the
  lines around the marked ones.

Within a region every line is kept, however short, but for unmarked runs of
links and what the page declares to be something else by element, role or class
(menus, headers, footers, sidebars, notices, forms, reader comments). A class or
id declares so only if all its parts say so: ``story-notice-board`` is none.

Defined results: null or empty html, or a page without content, gives an empty
text; unclosed and stray tags are closed as a browser would; an unclosed
comment or script runs to the end; time and memory are linear in a page's
length, however deep its elements are nested; repeated rows give repeated rows;
an empty table gives an empty table; further columns stay, but for those named
text and n_chars, which are replaced.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("audio button canvas datalist embed head iframe input math meter noscript object option optgroup output progress script select style svg template textarea title video".split())
ASIDE = frozenset("aside dialog footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of a class or id that declare an element to be no part of the article, whatever its text.
OTHER = frozenset("breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pagination popup replies sidebar sidebars signup subscribe toolbar".split())
#: Parts that hint at such an element; its text counts if it is much denser than the threshold.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner promo promoted promotion promotions related recommended recommendations share sharing social sponsor sponsored widget widgets".split())
SUSPECT = HINTS | OTHER
#: Parts that say nothing about either.
NEUTRAL = frozenset("area bar block body bottom box button buttons center col column container form global inner item items left link links list main outer page panel primary right row secondary section site slot story top unit user wrap wrapper".split())
#: Words of a class or id that declare a container to hold the article, where no element says so.
HOLDS = frozenset("article content entry main post story".split())
REGIONS = frozenset("article body div main section table td".split())
#: Share of the marked text that a container must hold to be the article's; share of a line in links from which it is no text.
MOST = 0.7
LINKED = 0.8
#: Times the threshold that text must reach outside the page's article, and where a class or id hints at something else.
OUTSIDE = 1.5
HINTED = 3.0
#: Links that make an unmarked run a menu.
MENU = 3
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Line:
    """``region`` is the innermost container; ``within`` the article that holds the line, negative if only a class or id says so, 0 for none."""

    __slots__ = ("hinted", "linked", "links", "other", "ratio", "region", "text", "within")

    def __init__(self, text: str, ratio: float, linked: float, links: int, region: int, within: int, other: bool, hinted: bool) -> None:
        self.text, self.ratio, self.linked, self.links = text, ratio, linked, links
        self.region, self.within, self.other, self.hinted = region, within, other, hinted


def names(attrs: list[tuple[str, str | None]]) -> list[list[str]]:
    """The lower-case parts of each class and id of an element."""
    return [PART.findall(CAMEL.sub(" ", token).lower()) for name, value in attrs if name in ("class", "id") and value for token in value.split()]


def declares(found: list[list[str]], what: frozenset[str]) -> bool:
    """Whether a class or id has one of the words and besides it only words that say nothing."""
    return any(not what.isdisjoint(parts) and what.union(NEUTRAL).issuperset(parts) for parts in found)


def declared_other(tag: str, attrs: list[tuple[str, str | None]], found: list[list[str]], in_article: bool) -> bool:
    """Whether an element says of itself that it is not article text."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
    return declares(found, OTHER)


def hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) for name, value in attrs)


class Reader(HTMLParser):
    """Collects the lines of one page; each element costs the same, however deep it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # of each open element: tag, silent, declared other, hinted, region, article
        self.open: list[tuple[str, bool, bool, bool, int, int]] = []
        self.places: dict[str, list[int]] = {}  # of the open elements, by tag
        self.containers: list[int] = []  # places of the open elements that are regions
        self.parents: list[int] = [0]  # of each region; 0 is the page
        self.parts: list[str] = []
        self.tags = self.linked = self.anchors = 0

    def top(self) -> tuple[str, bool, bool, bool, int, int]:
        return self.open[-1] if self.open else ("", False, False, False, 0, 0)

    def line_ends(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, other, hinted, region, article = self.top()
                chars = max(0, len(text) - self.linked)
                self.lines.append(Line(text, chars / max(1, self.tags), 1 - chars / len(text), self.anchors, region, article, other, hinted))
            self.parts = []
        self.tags = self.linked = self.anchors = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            if tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                self.close_implied(tag, ("ul", "ol", "dl", "table", "menu", "select"))
            elif tag not in ("html", "head", "title"):
                self.close_implied("p", ("article", "section", "div", "main", "td", "li", "blockquote", "body"))
            self.line_ends()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, silent, other, hinted, region, article = self.top()
        if tag == "body":
            silent = other = hinted = False
        found = names(attrs) if attrs else []
        silent = silent or tag in SILENT
        other = other or declared_other(tag, attrs, found, article > 0)
        if attrs and tag not in ("html", "body", "main"):
            silent = silent or hidden(attrs)
            hinted = hinted or declares(found, SUSPECT)
        if tag in REGIONS:
            self.parents.append(region)
            region = len(self.parents) - 1
            self.containers.append(len(self.open))
            if not other and tag in ("article", "main"):
                article = region
            elif not other and not article and tag != "body" and any(not HOLDS.isdisjoint(parts) for parts in found):
                article = -region
        if tag == "a":
            self.anchors += 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, silent, other, hinted, region, article))

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; -1 for none."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close_implied(self, tag: str, stop: tuple[str, ...]) -> None:
        """A new item or paragraph ends an open one, unless a container stands between."""
        k = self.last(tag)
        if k >= 0 and k > max(self.last(s) for s in stop if s != tag):
            self.line_ends()
            self.cut(k)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            self.places[self.open.pop()[0]].pop()
            if self.containers and self.containers[-1] >= len(self.open):
                self.containers.pop()

    def handle_endtag(self, tag: str) -> None:
        k = self.last(tag)
        if k < 0 or (tag not in BLOCK and self.containers and self.containers[-1] > k):
            return
        if tag in BLOCK:
            self.line_ends()
        self.tags += 1
        self.cut(k)

    def handle_data(self, data: str) -> None:
        if self.top()[1]:
            return
        if self.places.get("a"):
            self.linked += len(data.strip())
        self.parts.append(data)

    def close(self) -> None:
        if self.rawdata.startswith("<!--") and not self.cdata_elem:
            self.rawdata = ""
        super().close()
        self.line_ends()


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = kernel[low - i + reach : high - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[low:high], strict=True)) / sum(w))
    return out


def threshold(values: list[float], rounds: int = 20) -> float:
    """The midpoint between the means of two clusters of values."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    for _ in range(rounds):
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            break
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if new == cut:
            break
        cut = new
    return cut


def select(lines: list[Line], parents: list[int], sigma: float) -> list[Line]:
    """The lines of the content regions, in page order."""
    if all(x.other for x in lines):
        return []
    smoothed = smooth([x.ratio for x in lines], sigma)
    cut = threshold(smoothed)
    marked = [v >= cut and not x.other and not x.hinted for x, v in zip(lines, smoothed, strict=True)]
    strong = [v >= (HINTED if x.hinted else OUTSIDE) * cut and not x.other for x, v in zip(lines, smoothed, strict=True)]
    articles = {x.within for x, m in zip(lines, marked, strict=True) if m and x.within > 0} or {x.within for x in lines if x.within > 0 and not x.other}
    if not articles:
        total = sum(len(x.text) for x, m in zip(lines, marked, strict=True) if m)
        articles = {x.within for x, m in zip(lines, marked, strict=True) if m and x.within}
        if sum(len(x.text) for x, m in zip(lines, marked, strict=True) if m and x.within) < MOST * total:
            articles = set()
    if articles:
        chosen = [x.within in articles for x in lines]
    else:
        chosen = _around_marked(lines, parents, marked)
    kept = [not x.other and (s or (c and not x.hinted)) for x, c, s in zip(lines, chosen, strong, strict=True)]
    return _without_menus(lines, kept, marked)


def _around_marked(lines: list[Line], parents: list[int], marked: list[bool]) -> list[bool]:
    """The lines around the marked ones within the innermost container of most of the marked text."""
    weight, last = [0] * len(parents), list(range(len(parents)))
    for x, m in zip(lines, marked, strict=True):
        weight[x.region] += len(x.text) if m else 0
    for r in range(len(parents) - 1, 0, -1):  # regions are numbered in page order, so a region's own are r to last[r]
        weight[parents[r]] += weight[r]
        last[parents[r]] = max(last[parents[r]], last[r])
    if not weight[0]:
        return [not x.other for x in lines]
    region = max(r for r, n in enumerate(weight) if n >= MOST * weight[0])
    own = [k for k, x in enumerate(lines) if region <= x.region <= last[region] and not x.other]
    hits = [i for i, k in enumerate(own) if marked[k]]
    first, end = hits[0], hits[-1]
    # lines around the marked ones belong to it as well, unless they are links
    while first and lines[own[first - 1]].linked < LINKED:
        first -= 1
    while end + 1 < len(own) and lines[own[end + 1]].linked < LINKED:
        end += 1
    chosen = [False] * len(lines)
    for k in own[first : end + 1]:
        chosen[k] = marked[k] or lines[k].linked < LINKED
    return chosen


def _without_menus(lines: list[Line], kept: list[bool], marked: list[bool]) -> list[Line]:
    """The kept lines but for unmarked runs of nothing but links, ``MENU`` of them or more."""
    out: list[Line] = []
    run: list[Line] = []
    for x, k, m in zip(lines, kept, marked, strict=True):
        if not k:
            continue
        if not m and x.links and x.linked >= LINKED:
            run.append(x)
            continue
        out += run if sum(r.links for r in run) < MENU else []
        run = []
        out.append(x)
    return out + (run if sum(r.links for r in run) < MENU else [])


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page; blocks are joined by a line end."""
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    return "\n".join(x.text for x in select(reader.lines, reader.parents, sigma))


def extract_pages(pages: DataFrame, sigma: float = 1.0, html_col: str = "html") -> DataFrame:
    """The table with its ``html`` replaced by ``text`` and ``n_chars``; other columns stay."""
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def extract(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py(), sigma) for x in batch.column(len(others))]
            columns = [*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    return pages.select(*[F.col(f"`{c}`") for c in others], F.col(html_col).cast("string")).mapInArrow(extract, f"{kinds + ', ' if kinds else ''}text string, n_chars long")
