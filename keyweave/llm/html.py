"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into
lines.  A line's ratio is its text outside links over the tags in it.  The ratios,
smoothed by a Gaussian, are split at their deviation into content and the rest.  All
content is kept, with the short lines of the articles that hold some and of the
smallest region (main, section, ...) around all of it; runs of lines that are links
for the most part are lists of links and go wherever they stand.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden parts
are marked as the parser passes them, by their element or by the names of their class,
id and role.  A whole name marks by itself.  Where a name only begins or ends with such
a word the mark is void if the part holds an article or a main heading, or all but
nothing of the text stands elsewhere; where the word is ambiguous, a block of an
article goes only if its links or its ratio speak against it too.  A form around the
article is none.  Headings bear no marks.  Every step is linear in the page, however deep its tags are nested.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select option datalist textarea button".split())
ASIDE = frozenset("nav footer aside form menu dialog search header".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements a region of content may be.
REGION = frozenset("article main section div td body html".split())
#: A new one of these ends an open one.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "popup modal overlay sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies "
    "disqus respond discussion share sharing social related recommended subscribe newsletter signup login search widget pagination pager toolbar "
    "complementary contentinfo dialog alertdialog".split()
)
#: Marks that an article's own parts may bear too.
AMBIGUOUS = frozenset("discussion related share search header notice".split())
#: Marks of whole names that even an article element bears for itself.
OF_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended widget".split())
#: With one of these a compound name tells how the rest is laid out.
LAYOUT = frozenset("no not non has have with without hide hidden show is js one two three".split())
ARTICLE_WORDS = frozenset("article main content post entry story".split())

SIGMA = 1.0
#: Lines in a row that are links for the most part make a list of links.
LINK_RUN = 2
#: A compound name's mark is void where no more than one part in so many of the unmarked text stands elsewhere.
ELSEWHERE = 10

_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden").search
_PARTS = re.compile(r"[a-z0-9]+").findall
_NEVER_MARKED = frozenset(("html", "body", "main"))

#: How a mark is judged: by itself, by what its part holds, by the ratio and links of its text, by whether the article is in it.
CERTAIN, COMPOUND, DOUBTFUL, AROUND = 0, 1, 2, 3


@dataclass
class Mark:
    parent: int
    kind: int
    #: Whether headings in it stay where it goes.
    headings: bool
    #: Whether an unmarked article, or a heading of the first rank, stands in it.
    article: bool = False


@dataclass
class Line:
    pieces: list[str]
    tags: int
    links: int
    region: int
    mark: int
    heading: bool
    text: str = ""


@dataclass
class _Open:
    """An open element: its place in the tree of marks and regions, and what it is in."""

    tag: str
    silent: bool
    region: int
    mark: int
    article: bool  # in an article or main
    content: bool  # in an article or in a container named like one
    heading: bool


def marked_by(names: list[str], tag: str) -> tuple[bool, frozenset[str]]:
    """Whether a whole name of class, id or role marks the element, and the words that mark it."""
    whole = MARKS.intersection(names)
    if tag == "article":
        whole &= OF_ARTICLES
    if whole:
        return True, whole
    if tag == "article" or not ARTICLE_WORDS.isdisjoint(names):
        return False, frozenset()
    words = set()
    for name in names:
        parts = _PARTS(name)
        if len(parts) > 1 and LAYOUT.isdisjoint(parts):
            words |= MARKS & {parts[0], parts[-1]}
    return False, frozenset(words)


class _Lines(HTMLParser):
    """Cuts a page into lines, with the tree of its regions and that of its marks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.blocks: list[int] = []  # where block-level ones are
        self.lines: list[Line] = []
        self.regions: list[tuple[int, str]] = [(-1, "page")]  # parent, kind
        self.marks: list[Mark] = []
        self.links = 0
        self.line: Line | None = None

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed, and counting them takes a tenth of the time

    def _cut(self) -> None:
        if self.line:
            self.line.text = " ".join("".join(self.line.pieces).split())
            if self.line.text:
                self.lines.append(self.line)
        self.line = None

    def _mark(self, tag: str, attrs: dict, at: _Open) -> tuple[int, bool]:
        """The element's mark (its parent's if it has none of its own), and whether it is hidden."""
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool("style" in attrs and _HIDES(attrs["style"] or ""))
        names = [] if not attrs else f"{attrs.get('class') or ''} {attrs.get('id') or ''} {attrs.get('role') or ''}".lower().split()
        certain, words = (False, frozenset()) if tag in _NEVER_MARKED or tag in HEADING or not names else marked_by(names, tag)
        own_header = tag == "header" and at.article and words <= {"header"}
        kind = None
        if own_header:
            kind = CERTAIN  # an article's own header: its headings stay
        elif tag in ASIDE:
            kind = AROUND if tag == "form" and not certain else CERTAIN
        elif words and words <= AMBIGUOUS and tag in BLOCK and at.content and MARKS.isdisjoint((attrs.get("role") or "").lower().split()):
            kind = DOUBTFUL
        elif words and certain:
            kind = CERTAIN
        elif words and tag in BLOCK:
            kind = COMPOUND
        if kind is None:
            return at.mark, hidden
        self.marks.append(Mark(at.mark, kind, own_header or words == {"header"}))
        return len(self.marks) - 1, hidden

    def handle_starttag(self, tag: str, attrs) -> None:
        for open_tag in CLOSES.get(tag, ()):
            if self.stack and self.stack[-1].tag == open_tag:
                self._close(len(self.stack) - 1)
        if tag in BLOCK:
            self._cut()
        elif self.line is not None:
            self.line.tags += 1
            if tag == "br":
                self.line.pieces.append(" ")
        if tag in VOID:
            return
        at = self.stack[-1] if self.stack else _Open("", False, 0, -1, False, False, False)
        mark, hidden = self._mark(tag, dict(attrs), at) if attrs or tag in ASIDE else (at.mark, False)
        article, content, region = at.article or tag in ("article", "main"), at.content, at.region
        if tag in REGION:
            names = (dict(attrs).get("class") or "").lower().split() + [(dict(attrs).get("id") or "").lower()] if attrs else []
            kind = "article" if tag in ("article", "main") else "plain" if ARTICLE_WORDS.isdisjoint(names) else "named"
            self.regions.append((region, kind))
            region = len(self.regions) - 1
            content = content or (kind != "plain" and tag not in ("html", "body"))
        if mark >= 0 and mark == at.mark and (tag in ("article", "main", "h1")):
            self.marks[mark].article = True
        opened = _Open(tag, at.silent or hidden or tag in SILENT, region, mark, article, content, at.heading or tag in HEADING)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(opened)
        if tag == "a":
            self.links += 1

    def _close(self, place: int) -> None:
        """Closes the open element at this place of the stack and all in it."""
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag == "a":
                self.links -= 1
            if tag in BLOCK:
                self.blocks.pop()
                self._cut()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._cut()
        elif self.line is not None:
            self.line.tags += 1
        # a stray end tag closes nothing, and an inline one no block
        open_at = self.places.get(tag)
        if open_at and (tag in BLOCK or not self.blocks or open_at[-1] > self.blocks[-1]):
            self._close(open_at[-1])

    def handle_data(self, data: str) -> None:
        at = self.stack[-1] if self.stack else None
        if at and at.silent:
            return
        if self.line is None:
            if not data.strip():
                return
            self.line = Line([], 1, 0, at.region if at else 0, at.mark if at else -1, bool(at and at.heading))
        self.line.pieces.append(data)
        if self.links:
            self.line.links += len(data)

    def done(self) -> list[Line]:
        self.close()
        self._cut()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian over neighbouring lines; at the ends over those there are."""
    reach = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-((d / sigma) ** 2) / 2) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        out.append(sum(values[j] * weight[abs(i - j)] for j in near) / sum(weight[abs(i - j)] for j in near))
    return out


def scored(lines: list[Line]) -> tuple[list[float], float]:
    """The lines' smoothed ratios, and where content begins."""
    smooth = smoothed([max(0, len(line.text) - line.links) / line.tags for line in lines])
    mean = sum(smooth) / len(smooth)
    return smooth, min(math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), mean)


def cleared(lines: list[Line], marks: list[Mark]) -> list[Line]:
    """The lines whose marks don't hold."""
    if not marks:
        return lines
    sums = [[0, 0, 0] for _ in marks]  # text, links, tags of all in a part
    for line in lines:
        if line.mark >= 0:
            for k, n in enumerate((len(line.text), line.links, line.tags)):
                sums[line.mark][k] += n
    for i in range(len(marks) - 1, 0, -1):  # a part comes after those around it
        parent = marks[i].parent
        if parent >= 0:
            sums[parent] = [a + b for a, b in zip(sums[parent], sums[i])]
            marks[parent].article |= marks[i].kind != CERTAIN and marks[i].article
    free = [line for line in lines if line.mark < 0]
    elsewhere = sum(max(0, len(line.text) - line.links) for line in free)
    limit = scored(free)[1] if free else 0
    stays, headings = [], []  # whether a part stays, or its headings do
    for mark, (n, links, tags) in zip(marks, sums):
        if mark.kind == COMPOUND:
            void = mark.article or (2 * links <= n and elsewhere * ELSEWHERE <= n - links)
        elif mark.kind == AROUND:
            void = mark.article
        else:
            void = mark.kind == DOUBTFUL and 2 * links <= n and max(0, n - links) >= limit * tags
        outer = mark.parent < 0
        stays.append(void and (outer or stays[mark.parent]))
        headings.append((void or mark.headings) and (outer or headings[mark.parent]))
    return [line for line in lines if line.mark < 0 or stays[line.mark] or (line.heading and headings[line.mark])]


def in_link_lists(lines: list[Line]) -> list[bool]:
    """Which lines stand in a run of LINK_RUN or more lines, headings aside, that are links for the most part."""
    linked = [2 * line.links >= len(line.text) and not line.heading for line in lines]
    out, start = [False] * len(lines), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not linked[i]:
            if i - start >= LINK_RUN:
                out[start:i] = [True] * (i - start)
            start = i + 1
    return out


def chosen(lines: list[Line], regions: list[tuple[int, str]]) -> list[bool]:
    """Which lines are the main text: by their scores, and by the regions that these choose."""
    smooth, limit = scored(lines)
    listed = in_link_lists(lines)
    content = [s >= limit and not out for s, out in zip(smooth, listed)]
    plain = [2 * line.links < len(line.text) or line.heading for line in lines]

    def held(counted: list[bool]) -> list[int]:
        """The text of counted lines in each region and those in it."""
        sums = [0] * len(regions)
        for line, counts in zip(lines, counted):
            if counts:
                sums[line.region] += max(0, len(line.text) - line.links)
        for region in range(len(regions) - 1, 0, -1):  # a region comes after those around it
            sums[regions[region][0]] += sums[region]
        return sums

    mass = held(content)
    if not mass[0]:
        return [False] * len(lines)
    # of the outermost articles that hold content the short lines belong to it
    article = [-1] * len(regions)
    for region, (parent, kind) in enumerate(regions):
        article[region] = article[parent] if parent >= 0 and article[parent] >= 0 else region if kind == "article" else -1
    # and of the smallest region around all content
    root = max(region for region, m in enumerate(mass) if m == mass[0])
    if article[root] < 0:
        outer = root
        while outer >= 0:
            if regions[outer][1] == "named":
                root = outer
            outer = regions[outer][0]
    inside = [False] * len(regions)
    for region, (parent, _) in enumerate(regions):
        inside[region] = region == root or (parent >= 0 and inside[parent])
    return [
        not out and (good or unlinked) and (inside[line.region] or (article[line.region] >= 0 and mass[article[line.region]] > 0))
        for line, good, unlinked, out in zip(lines, content, plain, listed)
    ]


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by newlines; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = cleared(parser.done(), parser.marks)
    if not lines:
        return ""
    return "\n".join(line.text for line, keep in zip(lines, chosen(lines, parser.regions)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    Needs page_id, url, html; other columns are ignored.  A null or empty html, or one
    without main text, gives an empty text of 0 characters.  Broken markup is read as
    far as the parser can.  Equal rows give equal rows; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
