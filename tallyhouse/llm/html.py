"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing and threshold clustering.

Python's streaming HTML parser turns a page into lines, one for each block (paragraph, heading, list item, cell ...). Each line has a ratio of its
characters outside links to the tags within and since the line before. Ratios are smoothed over neighbouring lines with a Gaussian, and lines
above a threshold between the two clusters of ratios are content. Lines of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, told by their element or by the words of its class, id or role, never are.

Content lines select regions. Where they stand inside an ``article`` or ``main`` element (that with the most content), the region is the whole element: short
paragraphs between long ones and the heading belong to it. Else it is the span from the first to the last content line, with headings right before
it. All lines of a region but the excluded ones are the text.

Defined results: null, empty and text-free pages give an empty text; unclosed and stray tags are tolerated; a page cut off inside a tag loses that tag only;
line breaks within a block are white space; character references are decoded; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import common

# Element names of HTML, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    .split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
EXCLUDED = frozenset(
    "head title script style noscript template nav footer aside form select button textarea option fieldset iframe object svg canvas audio video dialog menu"
    .split()
)
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
EXCLUDED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSED_BY_BLOCK = frozenset(("p",))
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

SIGMA = 1.5
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    name: str
    excluded: bool
    region: int  # number of the innermost article or main element around, 0 for none


@dataclass
class Line:
    text: str
    linked: int
    tags: int
    excluded: bool
    regions: tuple[int, ...]
    heading: bool


@dataclass
class LineParser(HTMLParser):
    """Collects the lines of a page."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.regions = self.links = 0
        self.region_path: list[int] = []

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.open[-1] if self.open else None
                heading = any(e.name in HEADINGS for e in self.open[-3:])
                excluded = top is not None and top.excluded
                self.lines.append(Line(text, min(self.linked, len(text)), self.tags, excluded, tuple(self.region_path), heading))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _pop(self) -> None:
        element = self.open.pop()
        if element.region:
            self.region_path.pop()
        if element.name == "a":
            self.links -= 1

    def _excludes(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in EXCLUDED:
            return True
        if tag == "header" and not self.region_path:
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            if value and (
                (name in ("class", "id") and tag not in REGIONS and any(w.lower() in EXCLUDED_WORDS for w in WORD.findall(value)) and not self._titles(tag, value))
                or (name == "role" and value.lower() in EXCLUDED_ROLES)
                or (name in ("class", "id") and tag in REGIONS and any(w.lower() in ("comment", "comments", "ad", "advert", "sponsored", "related") for w in WORD.findall(value)))
                or (name == "aria-hidden" and value.lower() == "true")
            ):
                return True
            if name == "hidden":
                return True
        return False

    def _titles(self, tag: str, value: str) -> bool:
        """Headers of an article are part of it."""
        return bool(self.region_path) and tag in ("header", *HEADINGS) and {w.lower() for w in WORD.findall(value)} & EXCLUDED_WORDS <= {"header"}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            if tag == "hr":
                self._end_line()
            return
        inline = tag in INLINE
        if not inline:
            self._end_line()
            self._close_implied(tag)
        excluded = (bool(self.open) and self.open[-1].excluded) or self._excludes(tag, attrs)
        if inline and excluded and not (self.open and self.open[-1].excluded):
            self._end_line()
        region = 0
        if tag in REGIONS:
            self.regions += 1
            region = self.regions
            self.region_path.append(region)
        if tag == "a":
            self.links += 1
        self.open.append(Element(tag, excluded, region))

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph, and an item the item before it."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i].name
            if name in INLINE:
                continue
            if name in CLOSED_BY_BLOCK or (name == tag and name in CLOSED_BY_SAME):
                while len(self.open) > i:
                    self._pop()
            return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "circle", "rect", "use", "g"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == tag:
                if tag not in INLINE or self.open[i].excluded:
                    self._end_line()
                while len(self.open) > i:
                    self._pop()
                return
            if tag in INLINE and self.open[i].name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def ratios(lines: list[Line]) -> list[float]:
    """Characters outside links per tag of each line; 0 for excluded lines."""
    return [(len(line.text) - line.linked) / max(1, line.tags) if not line.excluded else 0.0 for line in lines]


def smoothed(raw: list[float]) -> list[float]:
    """Values averaged over the lines around with a Gaussian."""
    reach = math.ceil(2 * SIGMA)
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(reach + 1)]
    smooth = []
    for i in range(len(raw)):
        total = mass = 0.0
        for j in range(max(0, i - reach), min(len(raw), i + reach + 1)):
            weight = weights[abs(i - j)]
            total += weight * raw[j]
            mass += weight
        smooth.append(total / mass)
    return smooth


def threshold(values: list[float]) -> float:
    """The bound between a low and a high cluster of values: the middle of their means, moved until it is stable."""
    low, high = min(values), max(values)
    bound = (low + high) / 2
    for _ in range(50):
        below = [v for v in values if v < bound]
        above = [v for v in values if v >= bound]
        moved = (sum(below) / len(below) + sum(above) / len(above)) / 2 if below else low
        if abs(moved - bound) < 1e-9:
            break
        bound = moved
    return bound


def content_lines(lines: list[Line]) -> list[Line]:
    """The lines of a page's main text, in page order."""
    if not any(not line.excluded for line in lines):
        return []
    raw = ratios(lines)
    smooth = smoothed(raw)
    bound = threshold(smooth)
    content = [i for i, line in enumerate(lines) if not line.excluded and smooth[i] >= bound]
    if not content:
        content = [i for i, line in enumerate(lines) if not line.excluded]
    weight: dict[int, int] = {}
    for i in content:
        for region in lines[i].regions:
            weight[region] = weight.get(region, 0) + len(lines[i].text)
    if weight:
        most = max(weight.values())
        best = max(region for region, size in weight.items() if size == most)
        return [line for line in lines if best in line.regions and not line.excluded]
    solid = [i for i in content if raw[i] >= bound] or content  # a span begins and ends with lines that are content by themselves
    first, last = solid[0], solid[-1]
    while first and lines[first - 1].heading and not lines[first - 1].excluded:
        first -= 1
    return [line for line in lines[first : last + 1] if not line.excluded]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line ends."""
    parser = LineParser()
    parser.feed(html or "")
    return "\n".join(line.text for line in content_lines(parser.finish()))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the main ``text`` instead of ``html``, and ``n_chars``, its code points."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in column], pa.string())

    plain, old = common.guarded(pages)
    kept = {name: c for name, c in old.items() if name != html}
    extracted = plain.withColumn("text", text(old[html]))
    return extracted.select(*common.restored(kept, {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}))


def op3_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return extract(common.table(spark, directory, "pages").select("page_id", "url", "html"))
