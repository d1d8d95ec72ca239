"""HTML extraction: parser events, text-to-tag ratio per line, smoothing, clustering.

The standard library's parser streams events over the whole page. Text collects into
lines, one for each block element; a line's ratio is its characters over its tags. Lines
belong to regions, the nearest sectioning ancestors. Ratios are smoothed with a Gaussian
along a region's lines; a region has the mean of its smoothed ratios, weighed by
characters. What markup says of a region is a factor on that mean, not a verdict: NAMED
for each ancestor whose class or id is made up of names of adverts, notices, comments and
the like, BESIDE outside of article and main elements on a page that has any. A threshold
then clusters regions into content and rest: SHARE of the best mean; on pages without
article or main also SPREAD standard deviations of the ratios, and links must not be the
greater part. The best region is content (of equal ones the longer, then the first); a named
one only if it lies in an article or main or holds further named ones, as a page's layout
does. What stands in an article or main without a name of its own stays, whatever its
length; on other pages so does what stands in the smallest region that holds nearly all of
the content. Scripts, styles, forms, menus, page headers and footers, asides and what is
marked hidden are closed with their whole subtree. Nothing is dropped within a region.

Cases: null and empty pages, and pages without content, give an empty text; unclosed
and stray tags are repaired as a browser would (an open paragraph ends at the next
block, an end tag closes what is open inside it); malformed declarations are read as
text; very long pages are read whole; repeated rows return repeated rows; null page_ids
and urls pass through; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm.common import scan

SIGMA = 1.5
#: Share of the best region's mean ratio that content has.
SHARE = 0.005
#: Factors on a region's mean: per named ancestor, beside article and main.
NAMED, BESIDE = 1e-5, 1e-8
#: Without article or main: this share of the ratios' standard deviation, this share of link text.
SPREAD, LINK_SHARE = 0.5, 0.5
#: Share of the content's characters that its smallest common region holds.
NEARLY = 0.8
#: Unclosed formatting elements of a kind that go on in the next block, as in browsers.
GO_ON = 3

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer form head iframe input label legend map menu nav noscript object option script select style svg template textarea title video".split())
REGIONS = frozenset("article aside body div footer form header html main nav section table td".split())
CONTENT = frozenset("article main".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body html caption dd dt figcaption legend option tbody td tfoot th thead tr summary".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = frozenset("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that say nothing of what a named element holds.
NEUTRAL = frozenset("area bar block body bottom box col column container group head holder inner item items left links list main message outer page panel right row section site slot strip text title top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def names(value: str) -> bool:
    """Whether a class or id has a token made up of names and neutral words."""
    for token in value.lower().split():
        parts = {p for p in re.split("[-_]+", token) if p and not p.isdigit()}
        if parts & NAMES and parts <= NAMES | NEUTRAL:
            return True
    return False


class Region:
    """Named ancestors, whether in an article or main, the region around it, whether other
    named regions lie inside."""

    __slots__ = ("named", "content", "around", "layout")

    def __init__(self, named: int, content: bool, around: int):
        self.named, self.content, self.around, self.layout = named, content, around, False


class _Lines(HTMLParser):
    """Collects lines: (text, tags, link characters, number of the region)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, closed, a region, named
        self.count: Counter = Counter()  # open elements by tag
        self.hidden = self.links = self.content = self.named = 0
        self.all = [Region(0, False, -1)]
        self.regions = [0]
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, self.regions[-1]))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_PARAGRAPH:
                self._close({"p"}, REGIONS)
            if tag in SIBLINGS:
                self._close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select"} | (REGIONS - {"td"}))
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        hides = tag in NEVER or tag == "header" and not self.content
        named = False
        if not hides and attrs and tag not in ("html", "body"):
            for name, value in attrs:
                if value and name in ("class", "id") and tag in BLOCKS and tag != "p" and names(value):
                    named = True
                if value and (name == "role" and value.lower() in ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()):
                    hides = True
                if name == "hidden":
                    hides = True
        region = named or tag in REGIONS
        self.open.append((tag, hides, region, named))
        self.count[tag] += 1
        self.hidden += hides
        self.content += tag in CONTENT
        self.links += tag == "a"
        self.named += named
        if region:
            around = self.regions[-1]
            self.regions.append(len(self.all))
            self.all.append(Region(self.named, self.content > 0, around))
            if named:
                self.all[around].layout = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if self.count[tag]:
            while self._pop() != tag:
                pass

    def _close(self, tags: set[str], bounds: frozenset[str] | set[str]) -> None:
        """Close the nearest open element of these tags, unless a bound lies between."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                inline, kinds = [], Counter()
                while len(self.open) > i + 1:
                    x = self.open[-1]
                    self._pop()
                    if x[0] not in BLOCKS and not x[1] and kinds[x[0]] < GO_ON:
                        kinds[x[0]] += 1
                        inline.append(x)
                self._pop()
                for x in reversed(inline):  # as browsers do, unclosed formatting goes on
                    self.open.append(x)
                    self.count[x[0]] += 1
                    self.links += x[0] == "a"
                return
            if self.open[i][0] in bounds:
                return

    def _pop(self) -> str:
        tag, hides, region, named = self.open.pop()
        self.count[tag] -= 1
        self.hidden -= hides
        self.content -= tag in CONTENT
        self.links -= tag == "a"
        self.named -= named
        if region:
            self.regions.pop()
        return tag

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data.strip())


def _smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def parsed(html: str) -> _Lines:
    for attempt in range(2):
        parser = _Lines()
        try:
            parser.feed(html)
            parser.close()
            break
        except AssertionError:  # a malformed marked section
            html = html.replace("<![", "&lt;![")
    parser.flush()
    return parser


def chosen(lines: list[tuple[str, int, int, int]], regions: list[Region]) -> set[int]:
    """Numbers of the content regions."""
    ratios = [len(text) / max(1, tags) for text, tags, *_ in lines]
    held: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        held.setdefault(line[3], []).append(i)
    any_content = any(regions[k].content for k in held)
    mean, chars, linked = {}, {}, {}
    for k, at in held.items():
        r = regions[k]
        sizes = [len(lines[i][0]) for i in at]
        chars[k], linked[k] = sum(sizes), sum(lines[i][2] for i in at)
        smooth = sum(s * n for s, n in zip(_smooth([ratios[i] for i in at]), sizes)) / chars[k]
        mean[k] = smooth * NAMED**r.named * (BESIDE if any_content and not r.content else 1.0)
    able = [k for k in held if not regions[k].named or regions[k].content or regions[k].layout]
    if not able:
        return set()
    best = max(able, key=lambda k: (mean[k], chars[k]))
    least = min((regions[k].named for k in able if regions[k].content), default=0)
    if any_content:
        return {k for k in held if k == best or mean[k] >= SHARE * mean[best] or regions[k].content and regions[k].named == least}
    average = sum(ratios) / len(ratios)
    threshold = max(SHARE * mean[best], min(mean[best], SPREAD * math.sqrt(sum((r - average) ** 2 for r in ratios) / len(ratios))))
    sure = {k for k in held if k == best or linked[k] <= LINK_SHARE * chars[k] and mean[k] >= threshold}
    inside = _within(_common(sure, chars, regions), regions)
    return sure | {k for k in held if k in inside and regions[k].named <= regions[best].named and linked[k] <= LINK_SHARE * chars[k]}


def _common(sure: set[int], chars: dict[int, int], regions: list[Region]) -> int:
    """The smallest region that holds NEARLY all characters of the sure ones; regions are
    numbered from the outside in."""
    holds = [0] * len(regions)
    for k in sure:
        holds[k] = chars[k]
    for k in range(len(regions) - 1, 0, -1):
        holds[regions[k].around] += holds[k]
    return max(k for k in range(len(regions)) if holds[k] >= NEARLY * holds[0])


def _within(top: int, regions: list[Region]) -> set[int]:
    """The region and those inside of it; none if it is the whole page."""
    if top == 0:
        return set()
    inside = {top}
    for k in range(top + 1, len(regions)):
        if regions[k].around in inside:
            inside.add(k)
    return inside


def extract(html: str | None) -> str:
    """Main text of a page: its content lines in page order, joined by two newlines."""
    page = parsed(html) if html else None
    if page is None or not page.lines:
        return ""
    kept = chosen(page.lines, page.all)
    return "\n\n".join(text for text, _, _, region in page.lines if region in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of pages."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(h) for h in batch.column("html").to_pylist()]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return scan(pages, run, f"page_id {id_type}, url string, text string, n_chars long", "page_id", "url", "html")
