"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. Block tags cut the page into lines; a line's ratio is its text outside links
by its tags. A Gaussian smooths the ratios over neighbouring lines, and lines above a threshold (a share of the standard
deviation) cluster into content regions. The region with the most text names the page's content element, and all of that
element's lines are the article: short paragraphs below the threshold belong to it, boilerplate beside or inside it does not.

Lines of elements that say what they are (menus, headers, footers, asides, forms, scripts, styles, and elements whose class,
id or role names adverts, notices, sidebars, comments and the like) count as no text. Headings in an article's own header stay.

Defined results: a null or empty page, or one without text, has an empty text; unclosed, stray and wrongly nested tags are
closed as a browser would close blocks; character references are decoded, broken ones stay as written; equal pages
are answered each; ties between regions go to the first; a very long page is read whole, in time linear in its length; null
ids and urls are passed on; of other columns only html is read, the rest is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import table

#: Lines on each side that the Gaussian reaches, its deviation, and how many standard deviations of the smoothed ratios a content line exceeds.
REACH, SIGMA, DEVIATIONS = 4, 2.0, 1.0
#: Elements without an end tag, as the standard lists them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that the next block of such a kind ends.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose text is never the article's.
SILENT = frozenset("head title script style noscript template nav menu footer header aside form button select textarea iframe object svg canvas audio video map dialog search".split())
#: Words in class, id and role that name what is not the article, and those that turn such a word round (with-sidebar).
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner billboard breadcrumb breadcrumbs captcha comment comments commentlist complementary contentinfo cookie cookies consent "
    "disclaimer discussion disqus footer gdpr header masthead menu menubar nav navbar navigation newsletter notice notices notification pager pagination paywall popup modal promo promoted promotion "
    "related recommended recommendations replies respond responses search share sharing sidebar sidebars sidenav signup social sponsor sponsored sponsors subscribe subscription toolbar topbar tracking "
    "widget widgets".split()
)
ABOUT = frozenset("with without has no is show".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A heading after which readers speak.
READERS = re.compile(r"\W*(?:\d+ )?(?:(?:reader|user|leser) ?)?(?:comments?|kommentare?|commentaires?|comentarios?|replies|responses)\W*(?:\d+)?\W*", re.I)


@dataclass(slots=True)
class Element:
    """A block that holds lines; paragraphs and inline elements hold none of their own."""

    name: str
    parent: int
    article: bool
    end: int = 0  # elements from its own number up to this lie in it


@dataclass(slots=True)
class Open:
    """An open element in the parser's stack."""

    name: str
    element: int
    silent: bool
    link: bool


@dataclass(slots=True)
class Line:
    element: int
    text: str
    linked: int
    tags: int
    heading: bool

    def ratio(self) -> float:
        return max(len(self.text) - self.linked, 0) / max(self.tags, 1)


def named_other(attrs: dict[str, str]) -> bool:
    for token in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        words = {w.lower() for w in NAME.findall(token)} | {token.lower()}
        if words & OTHER and not words & ABOUT:
            return True
    return False


class Lines(HTMLParser):
    """Parser events to lines and the elements that hold them; every tag costs the same however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, False)]
        self.lines: list[Line] = []
        self.stack = [Open("", 0, False, False)]
        self.open_at: dict[str, list[int]] = {}  # places of the open elements of a name
        self.blocks = [0]  # places of open blocks, paragraphs among them
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self.mute = self.seen_article = False

    def cut(self) -> None:
        """End the line; silent text makes a line without text."""
        text = " ".join("".join(self.parts).split())
        if text or self.mute:
            self.lines.append(Line(self.stack[-1].element, text, self.linked, self.tags, any(self.open_at.get(h) for h in HEADINGS)))
            self.tags = 0
        self.parts, self.linked, self.mute = [], 0, False

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.open_at[gone.name].pop()
            self.elements[gone.element].end = len(self.elements)
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def is_silent(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether the element is none of the article's, given that what holds it may be so."""
        top = self.stack[-1]
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
            return True
        other = tag not in ("html", "body") and tag not in HEADINGS and named_other(attrs)
        if tag in ("article", "main") and not other:
            # a wrapper whose name only sounds like another part (or a form around the page) does not hide the first article
            wrapped = any(self.open_at.get(t) for t in SILENT - {"form"})
            return top.silent and (self.seen_article or wrapped)
        if tag in HEADINGS and top.silent and self.elements[top.element].name == "header":
            return not self.elements[top.element].article
        return top.silent or tag in SILENT or other

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        block = tag in BLOCK
        if tag == "br":
            self.parts.append(" ")
        if block:
            self.cut()
            at = self.blocks[-1]
            if self.stack[at].name == "p" or self.stack[at].name in HEADINGS and tag in HEADINGS or self.stack[at].name in ENDED_BY.get(tag, ()):
                self.pop_to(at)
                at = self.blocks[-1]
                if tag == "tr" and self.stack[at].name == "tr":  # the cell is ended, its row is too
                    self.pop_to(at)
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        top, silent = self.stack[-1], self.is_silent(tag, given)
        element = top.element
        if block and tag != "p" and tag not in HEADINGS:
            own = tag in ("article", "main") or given.get("role") == "main" or given.get("itemprop") == "articleBody"
            self.elements.append(Element(tag, top.element, self.elements[top.element].article or own))
            element = len(self.elements) - 1
            self.seen_article |= own and not silent
        if block:
            self.blocks.append(len(self.stack))
        self.open_at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Open(tag, element, silent, top.link or tag == "a"))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        places = self.open_at.get(tag)
        if places and (tag in BLOCK or places[-1] > self.blocks[-1]):  # an inline end tag closes no block
            self.pop_to(places[-1])

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.silent:
            self.parts.append(data)
            self.linked += len(data) * top.link
        elif self.stack[self.blocks[-1]].silent and not data.isspace():
            self.mute = True


def read_page(html: str) -> tuple[list[Line], list[Element]]:
    """Lines and elements; what is begun as a tag behind the page's last > is no tag and no text."""
    page = Lines()
    end = html.rfind(">") + 1
    page.feed(html[:end] + html[end:].partition("<")[0])
    page.close()
    page.cut()
    page.pop_to(1)
    page.elements[0].end = len(page.elements)
    return page.lines, page.elements


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """A Gaussian over the lines around; at the ends over those that are there."""
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    middle = slice(REACH, REACH + len(ratios))
    return np.convolve(ratios, weights)[middle] / np.convolve(np.ones(len(ratios)), weights)[middle]


def content_lines(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines exceed the threshold, and the clusters' numbers of all lines (neighbours above it share one)."""
    ratios = np.array([line.ratio() for line in lines])
    smooth = smoothed(ratios)
    above = (smooth >= min(DEVIATIONS * smooth.std(), smooth.max())) & (ratios > 0)
    return above, np.cumsum(above & ~np.concatenate([[False], above[:-1]]))


def without_readers(lines: list[Line], elements: list[Element]) -> list[Line]:
    """Without what follows a heading of readers' comments in the element that holds it."""
    out, closed = [], range(0)
    for line in lines:
        if line.element in closed:
            continue
        if line.heading and len(line.text) < 60 and READERS.fullmatch(line.text):
            closed = range(line.element, elements[line.element].end)
        else:
            out.append(line)
    return out


def content_element(lines: list[Line], elements: list[Element], above: np.ndarray, cluster: np.ndarray) -> int:
    """The outermost article that holds most of the largest region; without one the least element that leaves out no content line."""
    mass = np.array([max(len(line.text) - line.linked, 0) for line in lines]) * above
    if not mass.any():
        mass = np.array([len(line.text) for line in lines])
    region = np.bincount(cluster, mass).argmax()
    own = np.zeros(len(elements))
    for line, m in zip(lines, mass * (cluster == region), strict=True):
        own[line.element] += m
    articles: dict[int, float] = {}
    for k in np.flatnonzero(own).tolist():
        at, outer = k, -1
        while at > 0 and elements[at].article:
            if elements[at].name == "article" or outer < 0 or elements[outer].name != "article":
                outer = at
            at = elements[at].parent
        if outer >= 0:
            articles[outer] = articles.get(outer, 0) + own[k]
    if articles:
        return max(articles, key=lambda k: (articles[k], -k))
    held = np.zeros(len(elements), np.int64)  # content lines in each element and below
    for line in (line for line, a in zip(lines, above, strict=True) if a):
        held[line.element] += 1
    for k in range(len(elements) - 1, 0, -1):
        held[elements[k].parent] += held[k]
    return int(np.flatnonzero(held == held[0])[-1])


def main_text(html: str | None) -> str:
    lines, elements = read_page(html or "")
    lines = without_readers(lines, elements)
    if not any(line.text for line in lines):
        return ""
    above, cluster = content_lines(lines)
    element = content_element(lines, elements, above, cluster)
    kept = np.array([element <= line.element < elements[element].end for line in lines])
    if elements[element].name in ("", "html", "body"):  # no element of its own: from the first content line to the last
        places = np.flatnonzero(above & kept)
        if len(places):
            kept[: places[0]] = kept[places[-1] + 1 :] = False
    return " ".join(line.text for line, k in zip(lines, kept, strict=True) if k and line.text)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` and its length ``n_chars`` in code points; columns of these names are replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text)

    read = F.pandas_udf(run, "string")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*(F.col(f"`{c}`") for c in kept), read(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
