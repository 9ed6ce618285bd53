"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's event parser walks the page once. Text gathers in lines (one for each block
element); what stands in scripts, styles, menus, page footers and headers, asides, forms and hidden elements is
left out by element and role. Each line has a text-to-tag ratio: its characters over the tags that opened or
closed in it. The ratios are smoothed with a Gaussian and clustered by a threshold on their spread; the lines of
the upper cluster are dense. The clusters then decide three things:

* Subtrees under suspicion. A class or id word as `sidebar` or `advert` makes an element suspect, no more. It goes
  if it holds less than MOSTLY of the page's dense text; a container around the article, whatever its class, stays.
  A suspect of reader comments also goes, however long, if BEFORE of the dense text stands outside and above it.
* Regions. Article and main elements are the content if together they hold MOSTLY of their own text and the dense text beside
  them that stands in no suspect; of them, one that has no dense line and is mostly links goes. Otherwise the body is: content runs from the first dense line to the last, with the lines
  around them that stand in the same containers, and the headings right above.
* Lists of links within a region. A run of lines that are not dense and mostly links goes; a dense paragraph of
  links stays, and so does a short paragraph without links.

White space in a block becomes one space, blocks are joined by two newlines. Null or empty html and pages
without text give the empty text. Unclosed and stray tags, comments and truncated pages are parsed as far
as they go. A very long page is parsed whole, in its task's memory. Repeated rows are extracted separately; columns
besides the id, the address and the html are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template nav footer aside form head iframe object svg math button select textarea dialog menu canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
CONTAINERS = frozenset("html body div section article main center td ul ol dl details figure blockquote".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
REGION = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id that mark what is not the article.
CLUTTER = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login footer foot header masthead topbar comment comments commentlist disqus replies reply respond related recommended share sharing social toolbar pagination pager widget copyright search skip hidden".split()
)
#: What follows a word of comments where it tells a page's state, not what an element holds.
STATES = frozenset("open opened closed enabled disabled on off allowed count number".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RADIUS = 2
#: Of the ratios' standard deviation: where the upper cluster starts.
SPREAD = 0.5
#: The share of a page's dense text from which a suspect subtree is taken for the page itself.
MOSTLY = 0.5
#: The share of a page's dense text above a suspect of reader comments from which it is one.
BEFORE = 0.2
#: The share of link text from which a line is mostly links.
LINKS = 0.5


class Line(NamedTuple):
    text: str
    tags: int
    region: int  # 0 is the body
    heading: bool
    suspects: tuple[int, ...]
    linked: int  # characters within links
    parent: int  # the container it stands in


class Lines(HTMLParser):
    """The lines of a page; comments: which of the suspect subtrees, numbered as they open, are of reader comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # element, left out, opens a region, suspect
        self.suspects: list[int] = []
        self.containers: list[int] = [0]
        self.opened = 0
        self.comments: list[bool] = []
        self.links = 0
        self.linked = 0
        self.out = 0
        self.text: list[str] = []
        self.tags = 0
        self.region = 0
        self.regions = 0
        self.nested = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.region, any(x[0] in HEADINGS for x in self.stack[-3:]), tuple(self.suspects), self.linked, self.containers[-1]))
        self.text, self.tags, self.linked = [], 0, 0

    def _judged(self, tag: str, attrs: list) -> tuple[bool, bool, bool]:
        """Whether an element is left out, suspect, and suspect of reader comments."""
        left = self._left_out(tag, attrs)
        words: set[str] = set()
        if not left and tag not in ("html", "body", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    for one in value.split():
                        parts = [w.lower() for w in _PARTS.findall(one)]
                        words.update(w for w, after in zip(parts, [*parts[1:], ""], strict=True) if not (w in COMMENTS and after in STATES))
        comments = not words.isdisjoint(COMMENTS)
        return left, comments or not (words.isdisjoint(CLUTTER) or tag == "article" or tag in HEADINGS), comments

    def _left_out(self, tag: str, attrs: list) -> bool:
        if tag in SKIP or tag == "header" and not self.region:
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden":
                return True
            if not value:
                continue
            if name == "role" and value.strip().lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
                return True
        return False

    def _pop(self, to: int) -> None:
        while len(self.stack) > to:
            if self.stack[-1][0] in BLOCK or self.stack[-1][3] and not self.out:
                self.end_line()
            tag, left, opened, suspect = self.stack.pop()
            if tag in CONTAINERS:
                self.containers.pop()
            self.out -= left
            self.links -= tag == "a"
            if suspect:
                self.suspects.pop()
            if opened:
                self.nested -= 1
                if not self.nested:
                    self.region = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            if not self.out or tag in REGION:
                self.end_line()
            if tag in ENDS_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close_implied(tag)
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag == "body" or tag in REGION:
            # a menu, header or form that was never closed ends here
            for k, (open_tag, left, _, _) in enumerate(self.stack):
                if left and open_tag in ("head", "nav", "header", "form", "title", "menu"):
                    self._pop(k)
                    break
        left, suspect, comments = self._judged(tag, attrs)
        if suspect and not self.out:
            # what was gathered before an inline suspect is not of it
            self.end_line()
        opens = tag in REGION and not left and not self.out
        if opens:
            self.nested += 1
            if self.nested == 1:
                self.regions += 1
                self.region = self.regions
        elif tag == "header" and self.region and not left:
            left = False
        self.stack.append((tag, left, opens, suspect))
        if tag in CONTAINERS:
            self.opened += 1
            self.containers.append(self.opened)
        self.out += left
        self.links += tag == "a"
        if suspect:
            self.suspects.append(len(self.comments))
            self.comments.append(comments)

    def _close_implied(self, tag: str) -> None:
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        stop = ("ul", "ol", "dl", "table", "select", "body", "article", "section", "div", "main", "aside", "blockquote")
        for k in range(len(self.stack) - 1, -1, -1):
            t = self.stack[k][0]
            if t in same or t == "p" and tag in ENDS_P:
                self._pop(k)
                return
            if t in stop:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return
            if self.stack[k][0] in REGION and tag not in ("body", "html", "main", "article"):
                return  # a stray end of something outside does not end the article
        if tag in BLOCK and not self.out:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.out:
            self.text.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """The ratios under a Gaussian of RADIUS lines; the weights of lines beyond the ends are left out."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * (RADIUS / 2) ** 2))
    return np.convolve(ratios, kernel, "same")[: len(ratios)] / np.convolve(np.ones(len(ratios)), kernel, "same")[: len(ratios)] if len(ratios) > len(x) else ratios


def content_lines(lines: list[Line]) -> np.ndarray:
    """Which lines are of the upper cluster, by their own ratio and by that of their surroundings."""
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines], float)
    around = smoothed(ratios)
    least = min(SPREAD * around.std(), ratios.max())
    content = (ratios >= least) & (around >= least)
    content[ratios.argmax()] = True
    return content


def without_suspects(lines: list[Line], comments: list[bool]) -> list[Line]:
    """The lines that no suspect subtree takes with it."""
    if not any(x.suspects for x in lines):
        return lines
    dense = content_lines(lines)
    weight = [len(x.text) * bool(d) for x, d in zip(lines, dense, strict=True)]
    of = [0] * len(comments)
    for x, w in zip(lines, weight, strict=True):
        for s in x.suspects:
            of[s] += w
    total, above = sum(weight), [0] * len(comments)
    for s in (k for k, c in enumerate(comments) if c):
        for x, w in zip(lines, weight, strict=True):
            if s in x.suspects:
                break
            above[s] += w
    gone = {s for s, w in enumerate(of) if w < MOSTLY * total or comments[s] and w < total and above[s] >= BEFORE * total}
    return [x for x in lines if gone.isdisjoint(x.suspects)]


def without_links(lines: list[Line], dense: np.ndarray) -> list[Line]:
    """Leaves out runs of two lines or more that are mostly links and not dense."""
    poor = [not d and x.linked >= LINKS * len(x.text) and not x.heading for x, d in zip(lines, dense, strict=True)]
    return [x for k, x in enumerate(lines) if not (poor[k] and (k and poor[k - 1] or k + 1 < len(poor) and poor[k + 1]))]


def main_blocks(html: str) -> list[str]:
    p = Lines()
    p.feed(html)
    p.close()
    p.end_line()
    lines = without_suspects(p.lines, p.comments)
    if not lines:
        return []
    dense = content_lines(lines)
    inside = sum(len(x.text) for x in lines if x.region)
    beside = sum(len(x.text) for x, d in zip(lines, dense, strict=True) if d and not x.region and not x.suspects)
    if inside and inside >= MOSTLY * (inside + beside):
        own = [x for x in lines if x.region]
        dense = content_lines(own)
        size, linked, keep = {}, {}, {x.region for x, d in zip(own, dense, strict=True) if d}
        for x in own:
            size[x.region] = size.get(x.region, 0) + len(x.text)
            linked[x.region] = linked.get(x.region, 0) + x.linked
        keep |= {r for r, n in size.items() if linked[r] < LINKS * n}
        return [x.text for x in without_links(own, dense) if x.region in keep]
    content = np.flatnonzero(dense)
    first, last = content[0], content[-1]
    top, end = lines[first].parent, lines[last].parent
    while first and lines[first - 1].parent == top:
        first -= 1
    while first and lines[first - 1].heading:
        first -= 1
    while last + 1 < len(lines) and lines[last + 1].parent == end:
        last += 1
    return [x.text for x in without_links(lines[first : last + 1], dense[first : last + 1])]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html)) if html else ""


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, text, n_chars for every page."""
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
