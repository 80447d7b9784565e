"""Main-text extraction from raw HTML.

Events of the standard library's streaming parser yield one line for each block. A line's
text-to-tag ratio is its characters divided by its tags; the ratios are smoothed by a Gaussian
and lines above a threshold form the content clusters. The clusters' text decides the region:
of the ``article`` and ``main`` elements those that hold it, on other pages the innermost
container that holds nearly all of it. Lines of the region stay, short ones too; at its edges,
outside an article, only clusters and titles do.

Navigation, footers, asides, scripts and other elements that are never content go. Class and id
names are weak evidence: they count only if each of their words speaks of page furniture, and
never against a container that holds the article or most of the text in question. All passes are
linear in the page, however deep it nests.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pieces, released

# Element, attribute and class names of HTML pages.
SILENT = {"script", "style", "noscript", "template", "title", "svg", "math", "canvas", "iframe", "object", "audio", "video", "textarea", "select", "datalist"}
#: Silent elements that hold no blocks: one that starts in them shows that they were never closed.
FLAT = {"svg", "math", "select", "datalist", "title", "textarea"}
NEVER = {"nav", "footer", "aside", "menu", "button", "dialog"}
FORMS = {"form", "fieldset"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "th", "ul", "ol", "li", "dl", "center", "blockquote", "figure", "details", "header"} | NEVER | FORMS
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "pre", "address", "hr", "figcaption", "caption", "thead", "tfoot", "summary", "legend", "hgroup", "search"}
PAGE = {"html", "body", "article", "main"}
#: Elements that end where such a one starts; a paragraph ends at every block.
LOOSE = {"p"}
IMPLIED = {"li": {"p", "li"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar"}
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
FURNITURE = COMMENTS | set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner banners sponsor sponsored promo promos promotion sidebar side rail nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead topbar header cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations widget widgets pagination pager search toolbar copyright disclaimer skip".split()
)
#: Words that say nothing beside those: "sidebar-content" is furniture, "social-history" isn't.
NEUTRAL = set(
    "box wrapper wrap container list area section block item items inner outer bar button buttons link links site page global main left right top bottom primary secondary "
    "form panel group row column slot zone region module component content body text title heading label icons post posts article articles entry story stories more thread small large "
    "sticky fixed by to the of and us our media policy message messages tools follow".split()
)
#: Beside one of these "header" is the header of the text, not of the page.
OWN_HEADER = {"post", "article", "entry", "story", "title"}
SIGMA = 1.0
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_TAG = re.compile(r"<[A-Za-z/!?]")
_SURE, _WEAK, _COMMENT, _HEADER = 1, 2, 4, 8


def named(value: str) -> int:
    """Weak evidence of a class or id value: 0, or _WEAK, _COMMENT and _HEADER added up."""
    if not value:
        return 0
    out, own = 0, False
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token) if not w.isdigit()]
        own = own or not OWN_HEADER.isdisjoint(words)
        said = {w for w in words if w in FURNITURE}
        if not said or any(w not in FURNITURE and w not in NEUTRAL for w in words):
            continue
        out |= _HEADER if said == {"header"} else _COMMENT | _WEAK if said & COMMENTS else _WEAK
    return out & ~_HEADER if own else out


@dataclass
class Line:
    """One block of a page: its text, how many tags it took, and where it stands."""

    text: str
    tags: int
    box: int
    heading: str
    hidden: int
    linked: int


@dataclass
class LineReader(HTMLParser):
    """Turns parser events into lines; keeps a stack of containers only, so that unclosed
    paragraphs and inline tags do no harm. Boxes are numbered from 0, parents before children."""

    lines: list[Line] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.name, self.bars = [-1], [""], [0]
        self.stack = [0]
        self.at: dict[str, list[int]] = {}  # places in the stack, by name
        self.silent: list[tuple[str, int, int]] = []  # name, number, height of the stack
        self.closed: set[int] = set()  # silent elements that were closed, so what they held goes
        self.n_silent = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.heading = ""
        self.in_link = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, max(1, self.tags), self.stack[-1], self.heading, self.silent[-1][1] if self.silent else 0, self.linked))
            self.tags = 0
        self.text, self.linked = [], 0

    def _end_silent(self, count: int, closed: bool) -> None:
        self.flush()
        for _ in range(count):
            _, number, height = self.silent.pop()
            if closed:
                self.closed.add(number)
                self._cut(height)

    def _cut(self, height: int) -> None:
        """Close the containers above this height of the stack."""
        while len(self.stack) > height:
            self.at[self.name[self.stack.pop()]].pop()

    def _open(self, tag: str, bars: int) -> None:
        self.parent.append(self.stack[-1])
        self.name.append(tag)
        self.bars.append(bars)
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.name) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.flush()
            self.n_silent += 1
            self.silent.append((tag, self.n_silent, len(self.stack)))
            return
        if self.silent and tag in BLOCKS and self.silent[-1][0] in FLAT:
            self._end_silent(1, True)
        if self.silent and tag not in BLOCKS:
            self.text.append(" ")
            return
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
        if tag == "a":
            self.in_link = True
        if tag not in BLOCKS:
            return
        self.flush()
        while self.name[self.stack[-1]] in IMPLIED.get(tag, LOOSE):
            self._cut(len(self.stack) - 1)
        if tag in HEADINGS:
            self.heading = tag
        elif tag not in VOID:
            self.heading = ""
        own = {k: v or "" for k, v in attrs}
        bars = 0
        if tag in NEVER or tag not in PAGE and own.get("role", "").lower() in ROLES or "hidden" in own or _NONE.search(own.get("style", "")):
            bars |= _SURE
        if tag in FORMS:
            bars |= _WEAK
        if tag == "header":
            bars |= _HEADER
        if tag not in PAGE or tag == "article":
            bars |= named(own.get("class", "")) | named(own.get("id", ""))
        if tag in CONTAINERS or tag == "p" and bars:
            self._open(tag, bars)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("svg", "math"):
            return
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in SILENT:
                k = next((k for k in range(len(self.silent) - 1, -1, -1) if self.silent[k][0] == tag), None)
                if k is not None:
                    self._end_silent(len(self.silent) - k, True)
                return
            if self.at.get(tag):
                place = self.at[tag][-1]
                while self.silent and place < self.silent[-1][2]:  # the element around it ends: it was never closed
                    self._end_silent(1, self.silent[-1][0] in FLAT)
        if tag == "a":
            self.in_link = False
        if tag not in BLOCKS:
            self.tags += 1
            return
        self.flush()
        self.tags += 1
        if tag in HEADINGS:
            self.heading = ""
        if self.at.get(tag):
            self._cut(self.at[tag][-1])

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What begins with ``<![`` is a comment up to the next ``>``; the parent class fails on unknown ones."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.in_link:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.flush()
        for name, number, _ in self.silent:
            if name in FLAT:
                self.closed.add(number)


def smooth(values: Sequence[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        got = total = 0.0
        for k in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[k - i + reach]
            got += w * values[k]
            total += w
        out.append(got / total)
    return out


class _Boxes:
    """Sums and marks over the tree of containers, each in one pass."""

    def __init__(self, page: LineReader) -> None:
        self.parent, self.name, self.bars = page.parent, page.name, list(page.bars)

    def mass(self, lines: Sequence[Line]) -> list[int]:
        """Characters of the lines in each box, inner boxes included."""
        out = [0] * len(self.parent)
        for x in lines:
            out[x.box] += len(x.text)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def inside(self, roots: set[int]) -> list[int]:
        """For each box the outermost of ``roots`` that holds it, or -1."""
        out = [-1] * len(self.parent)
        for i in range(len(out)):
            up = out[self.parent[i]] if i else -1
            out[i] = up if up >= 0 else i if i in roots else -1
        return out

    def holds(self, marked: set[int]) -> list[bool]:
        """Which boxes have a marked one somewhere inside."""
        out = [False] * len(self.parent)
        for i in range(len(out) - 1, 0, -1):
            if out[i] or i in marked:
                out[self.parent[i]] = True
        return out


def content_lines(page: LineReader) -> list[Line]:
    """The lines of the content region, in page order."""
    boxes = _Boxes(page)
    lines = [x for x in page.lines if x.hidden not in page.closed]
    bars = boxes.bars
    sure = boxes.inside({i for i, b in enumerate(bars) if b & _SURE})
    comments = boxes.inside({i for i, b in enumerate(bars) if b & _COMMENT})
    mains = {i for i, name in enumerate(boxes.name) if name in ("article", "main") and sure[i] < 0 and comments[i] < 0 and not bars[i] & _WEAK}
    in_main, in_article = boxes.inside(mains), boxes.inside({i for i in mains if boxes.name[i] == "article"})
    around = boxes.holds(mains)
    weak = {i for i, b in enumerate(bars) if b & _COMMENT or b & _WEAK and not around[i] or b & _HEADER and in_article[i] < 0 and not around[i]}

    def free() -> list[Line]:
        under = boxes.inside(weak)
        titles = lambda x: x.heading and bars[under[x.box]] == _HEADER and in_main[under[x.box]] >= 0  # noqa: E731  the header of a main
        return [x for x in lines if sure[x.box] < 0 and (under[x.box] < 0 or titles(x))]

    left = free()
    # names must not empty the article, or a page without one: what holds half of its text stays
    scope = [x for x in lines if sure[x.box] < 0 and (not mains or in_main[x.box] >= 0)]
    whole = sum(len(x.text) for x in scope)
    mass = boxes.mass(scope)
    for spared in (_COMMENT, 0):
        kept = sum(len(x.text) for x in left if not mains or in_main[x.box] >= 0)
        if kept < 0.25 * whole and (spared or not kept):
            weak = {i for i in weak if bars[i] & spared or 2 * mass[i] < whole}
            left = free()
    if not left:
        return []

    own = {id(x) for x in left}
    ratio = smooth([len(x.text) / x.tags if id(x) in own else 0.0 for x in lines])
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratio) / len(ratio))
    cluster = {id(x) for x, r in zip(lines, ratio, strict=True) if id(x) in own and r >= min(spread, mean)} or own
    chosen = [x for x in left if id(x) in cluster]
    total = sum(len(x.text) for x in chosen)
    mass = boxes.mass(chosen)
    barred = boxes.inside(weak)
    roots = {i for i in mains if barred[i] < 0 and mass[i]}
    outer = boxes.inside(roots)
    tops = {outer[i] for i in roots}
    if tops and sum(mass[i] for i in tops) >= 0.3 * total:
        most = max(mass[i] for i in tops)
        tops = {i for i in tops if 3 * mass[i] >= most}
        within = [x for x in left if outer[x.box] in tops]
        article = boxes.inside({i for i in roots if boxes.name[i] == "article"})
        if 2 * sum(len(x.text) for x in within if article[x.box] >= 0) >= sum(len(x.text) for x in within):
            return [x for x in within if article[x.box] >= 0 or x.heading == "h1"]  # a main around its article: of the rest only the title
        return within
    holders = [i for i, m in enumerate(mass) if m >= 0.8 * total]  # they are nested, the innermost last
    region = boxes.inside({max(holders)} if holders else {0})
    rest = [x for x in left if region[x.box] >= 0 or x.heading == "h1"]  # a title may stand before the container
    at = [k for k, x in enumerate(rest) if id(x) in cluster]
    first, last = (at[0], at[-1]) if at else (0, len(rest) - 1)
    while first and rest[first - 1].heading:
        first -= 1
    menu = lambda x: id(x) not in cluster and not x.heading and 10 * x.linked >= 9 * len(x.text)
    return [x for k, x in enumerate(rest) if x.heading == "h1" or first <= k <= last and not menu(x)]


def extract_text(html: str | None) -> str:
    """The main text of one page, blocks joined by a blank line; empty if there is none."""
    if not html:
        return ""
    # a tag that never ends is none; the parser would look for its end again and again
    end = html.rfind(">") + 1
    broken = _TAG.search(html, end)
    page = LineReader()
    page.feed(html[: broken.start()] if broken else html)
    page.close()
    return "\n\n".join(x.text for x in content_lines(page))


def html_extract(pages: DataFrame, html_col: str = "html", id_cols: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``id_cols``, ``text`` string and ``n_chars`` long (code points) of every page.

    Null html counts as empty and gives an empty text. Repeated rows and null ids come back
    as they are; an empty table gives an empty result; other columns are not read.
    """
    ids = list(id_cols)
    source = pages.select(*ids, html_col)
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in ids) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [extract_text(x) for x in batch.column(len(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*ids, "text", "n_chars"])

    return source.mapInArrow(released(run), schema)
