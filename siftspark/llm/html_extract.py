"""Main-text extraction from HTML by text-to-tag ratios.

The standard library's parser streams events; block tags end a line. Each line has its text,
its tags, its link text and the container it stands in. The ratio of characters to tags,
smoothed by a Gaussian over neighbouring lines, is clustered by a threshold: lines above it are
the content clusters, and they choose the regions. A container is content if most of its own
text is in clusters (of an article or main element: most of all text in it); then the short
lines in it are content too, and lists of links are not. A heading before a region, and short
lines between two regions of one container, go with them.

Elements that are menus, footers, sidebars, forms, scripts or styles by their name are never
content. Class names, ids and roles are negative evidence only: a name counts if all its words
are words for boilerplate or for layout ("site-footer", not "no-sidebar"), and an element that
holds most of the clustered text isn't boilerplate, whatever its names say, unless they say it
holds reader comments beside other clustered text.

Defined results: null, empty and tagless input give an empty text or the text itself; broken
nesting closes at the next fitting tag; a tag cut off at the end of the page is dropped; each
row gives one result row. Other columns are neither read nor returned, unless named in ``also``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5

# HTML's element names by role, and words that class, id and role use for boilerplate and for layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details div dl fieldset figure footer form header html main menu nav ol section table tbody td th thead tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head header iframe math menu nav noscript object script select style svg template textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline consent contentinfo complementary cookie cookies copyright footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommendations search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
LAYOUT = frozenset("a an the all area article bar block body bottom box btn button buttons center col column container content entry form global group icons inner item items left links list main media message news outer page panel post posts primary region right row secondary section site slot space sticky story text top unit wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT_OFF = re.compile(r"<(?:[/!?a-zA-Z][^<>]*)?\Z")
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class _Line:
    text: str
    tags: int
    links: int  # characters of link text
    container: int
    scope: int  # the innermost element that its names mark as boilerplate, -1 if there is none
    heading: bool


@dataclass
class _Open:
    tag: str
    never: bool
    container: int
    scope: int


class _Lines(HTMLParser):
    """The lines of a page that may be content, its containers and its marked elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Open("", False, -1, -1)
        self.open: list[_Open] = []
        self.count: Counter[str] = Counter()  # open elements by name
        self.parents: list[int] = []  # of containers
        self.kinds: list[str] = []
        self.outer: list[int] = []  # of marked elements: the marked one around it
        self.comments: list[bool] = []
        self.text: list[str] = []
        self.tags = self.links = 0
        self.lines: list[_Line] = []

    def _top(self) -> _Open:
        return self.open[-1] if self.open else self.root

    def _line(self) -> None:
        top = self._top()
        text = " ".join("".join(self.text).split())
        if text and not top.never:
            heading = any(x.tag in HEADINGS for x in self.open[-3:])
            self.lines.append(_Line(text, self.tags, self.links, top.container, top.scope, heading))
        if text:
            self.tags = 0
        self.text, self.links = [], 0

    def _pop_to(self, k: int) -> None:
        if any(x.tag in BLOCKS for x in self.open[k:]):
            self._line()
        for x in self.open[k:]:
            self.count[x.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            closes = _CLOSES.get(tag, {"p"})
            if any(self.count[x] for x in closes):
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k].tag in closes:
                        self._pop_to(k)
                        break
                    if self.open[k].tag in CONTAINERS:
                        break
            self._line()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        top = self._top()
        never, container, scope = top.never or tag in NEVER or _hidden(attrs), top.container, top.scope
        if attrs and not never and tag not in ("html", "body") and (marks := _marks(attrs)):
            self.outer.append(scope)
            self.comments.append("comment" in marks)
            scope = len(self.outer) - 1
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.parents) - 1
        if tag in BLOCKS or (never, scope) != (top.never, top.scope):
            self._line()
        self.open.append(_Open(tag, never, container, scope))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.count[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == tag:
                    around = self.open[k - 1] if k else self.root
                    if (self.open[k].never, self.open[k].scope) != (around.never, around.scope):
                        self._line()
                    self._pop_to(k)
                    return
                if tag not in CONTAINERS and self.open[k].tag in CONTAINERS:
                    break
        if tag in BLOCKS:
            self._line()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.count["a"]:
            self.links += len(data.strip())

    def close(self) -> None:
        super().close()
        self._line()


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


def _marks(attrs: list[tuple[str, str | None]]) -> set[str]:
    """What the names of an element call it: boilerplate, comment, or nothing. A name is taken whole."""
    found = set()
    for key, value in attrs:
        if key in ("class", "id", "role"):
            for name in (value or "").split():
                words = {w.lower() for w in _WORD.findall(name)}
                own = words - LAYOUT
                if own and own <= BOILERPLATE | COMMENTS:
                    found.add("comment" if own & COMMENTS else "boilerplate")
    return found


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that remain are scaled up."""
    if len(ratios) < 2 or sigma <= 0:
        return ratios
    r = min(math.ceil(3 * sigma), len(ratios) - 1)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(ratios)), weights)[r : r + len(ratios)]
    return np.convolve(ratios, weights)[r : r + len(ratios)] / total


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of a page; blocks are joined by one space."""
    if not html:
        return ""
    page = _Lines()
    page.feed(_CUT_OFF.sub("", html))
    page.close()
    lines = page.lines
    if not lines:
        return ""
    marked = _boilerplate(page, _clusters(lines, sigma)[0])
    lines = [x for x in lines if x.scope < 0 or not marked[x.scope]]
    return " ".join(x.text for x, ok in zip(lines, _grown(page, lines, *_clusters(lines, sigma)), strict=True) if ok)


def _clusters(lines: list[_Line], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the lines above the threshold: by the smoothed ratio, and by their own."""
    if not lines:
        return np.zeros(0, bool), np.zeros(0, bool)
    raw = np.array([len(x.text) / max(1, x.tags) for x in lines])
    ratio = smoothed(raw, sigma)
    least = min(ratio.std(), ratio.max())
    return ratio >= least, raw >= least


def _boilerplate(page: _Lines, good: np.ndarray) -> list[bool]:
    """Which marked elements are boilerplate, with all in them: not one that holds the page's clustered text.

    That is one with nearly all of it, or with most of it in several lines where no article or
    main element has any. Reader comments are content only where nothing else is clustered.
    """
    n = len(page.outer)
    mass, several, total, declared = [0] * n, [0] * n, 0, False
    inside = _declared(page)
    for x, ok in zip(page.lines, good.tolist(), strict=True):
        if ok:
            total += len(x.text)
            if x.scope >= 0:
                mass[x.scope] += len(x.text)
                several[x.scope] += 1
            declared |= x.scope < 0 and inside[x.container]
    for k in range(n - 1, -1, -1):  # an element comes after the one around it
        if page.outer[k] >= 0:
            mass[page.outer[k]] += mass[k]
            several[page.outer[k]] += several[k]
    out: list[bool] = []
    for k, around in enumerate(page.outer):
        if page.comments[k]:
            most = mass[k] == total
        else:
            most = mass[k] > 0.9 * total or (2 * mass[k] > total and several[k] > 2 and not declared)
        out.append((around >= 0 and out[around]) or not (most and total > 0))
    return out


def _declared(page: _Lines) -> list[bool]:
    """Which containers stand in an article or main element; the last flag is that of the page itself."""
    out = [False] * (len(page.parents) + 1)
    for k, kind in enumerate(page.kinds):
        out[k] = kind in ("article", "main") or out[page.parents[k]]
    return out


def _grown(page: _Lines, lines: list[_Line], good: np.ndarray, high: np.ndarray) -> list[bool]:
    """The lines of the regions to which the clusters grow. high: a line is above the threshold by itself."""
    n = len(page.parents)
    whole = [kind in ("article", "main") for kind in page.kinds]
    text, clustered, seed = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # the last is the page itself
    for x, ok, top in zip(lines, good.tolist(), high.tolist(), strict=True):
        text[x.container] += len(x.text)
        clustered[x.container] += len(x.text) * ok
        seed[x.container] |= ok and top
    own = [s and 2 * c >= t for t, c, s in zip(text, clustered, seed, strict=True)]
    for k in range(n - 1, -1, -1):  # a container comes after the one around it
        text[page.parents[k]] += text[k]
        clustered[page.parents[k]] += clustered[k]
    content, within = [False] * (n + 1), [False] * (n + 1)
    content[n] = own[n]
    for k in range(n):
        up = page.parents[k]
        # what stands in a region belongs to it; of the page as a whole only its own lines do
        within[k] = within[up] or (content[up] and up < n and up >= 0 and page.kinds[up] not in ("html", "body"))
        content[k] = 2 * clustered[k] >= text[k] > 0 if whole[k] else own[k]
    ok = [content[x.container] or (within[x.container] and 2 * x.links <= len(x.text)) for x in lines]
    return _bridged(page, lines, ok) if any(ok) else good.tolist()


def _bridged(page: _Lines, lines: list[_Line], ok: list[bool]) -> list[bool]:
    """With headings that stand before a region, and short lines between two regions, in a container around them."""
    out = list(ok)
    around: dict[int, set[int]] = {}

    def chain(c: int) -> set[int]:
        if c not in around:
            up, k = set(), c
            while k >= 0:
                up.add(k)
                k = page.parents[k]
            around[c] = up
        return around[c]

    chosen = [k for k, x in enumerate(ok) if x]
    for a, b in zip([None, *chosen], chosen, strict=False):
        for k in range(b - 1, a if a is not None else -1, -1):
            x = lines[k]
            if 2 * x.links > len(x.text) or x.container not in chain(lines[b].container):
                break
            if a is not None and x.container in chain(lines[a].container):
                out[k] = True
            elif x.heading:
                out[k] = True
            else:
                break
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA, also: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page, and the columns named in ``also``."""
    rest = pages.select(*also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [main_text(x.as_py(), sigma) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *map(part.column, also)], names=["page_id", "url", "text", "n_chars", *also])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *also)
    return rows.mapInArrow(run, ", ".join(["page_id long, url string, text string, n_chars long", *(f"`{c}` {t}" for c, t in rest.dtypes)]))
