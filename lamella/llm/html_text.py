"""HTML extraction (operator 12): parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser is fed a page in chunks. Its events cut the page into lines, one for each block of text,
with the number of tags since the line before, the share of it inside links, and the open elements around it. Elements
that can't hold an article (menus, forms, adverts, comments of readers, ...) take their lines out. The ratios of the
others are smoothed along the page; lines above a multiple of their deviation form clusters. The smallest element that
holds most of the clustered text is the content region; all its lines are kept, however short. Where no element is the
article's own, the region goes from the first cluster to the last, without lists of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.arrow import byte_values, sub_batches
from lamella.plans.session import small_batches

CHUNK, SLICE = 1 << 16, 8 << 20
#: Width of the smoothing in lines, deviations above which a line is content, share of clustered text that a region holds.
SIGMA, LEVEL, MOST = 1.0, 0.5, 0.8
LINKED = 0.5
#: Elements of HTML that end a line, that are empty, whose content isn't text of the page, and that aren't article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("applet audio button canvas datalist head iframe map math noembed noframes noscript object option script select style svg template textarea title video".split())
ASIDE = frozenset("aside dialog fieldset footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class names and ids of what surrounds articles.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha consent cookie cookies dialog disclaimer footer gdpr masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promos promotion recommended related rail share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
READERS = frozenset("comment commentlist comments discussion disqus replies reply respond responses".split())
_WORD, _PARTS = re.compile(r"[A-Za-z]+"), re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_HOLDS_ALL = frozenset("html body main".split())
#: An open element is closed by a new one: a paragraph by any block, items by their like.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


def _around(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """2 for an element that surrounds articles, 1 where only its name says so (a wrapper may be named for its sidebar), else 0."""
    if tag in ASIDE:
        return 2
    named = 0
    for name, value in attrs:
        if name == "hidden" or value and (name == "aria-hidden" and value.lower() == "true" or name == "role" and value.strip().lower() in ROLES):
            return 2
        if value and name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
        if value and name in ("class", "id") and tag not in _HOLDS_ALL:
            words = {p.lower() for w in _WORD.findall(value) for p in [w, *_PARTS.findall(w)]}
            if words & READERS:
                return 2
            named = named or int(tag != "article" and bool(words & AROUND))
    return named


class Lines(HTMLParser):
    """Lines of a page: ``text``, ``tags`` before it, ``linked`` characters, ``path`` of open elements (number, tag, how it surrounds articles)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple]] = []
        self.path: list[tuple[int, str, int]] = []
        self.silent: list[str] = []
        self.pieces: list[str] = []
        self.links = self.linked = self.tags = self.count = 0

    def end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append((text, self.tags, self.linked, tuple(self.path)))
                self.tags = 0
            self.pieces, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        if any(tag in BLOCKS for _, tag, _ in self.path[k:]):
            self.end_line()
        self.links -= sum(tag == "a" for _, tag, _ in self.path[k:])
        del self.path[k:]

    def close_open(self, tags: str, within: tuple[str, ...]) -> None:
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k][1] in within:
                return
            if self.path[k][1] in tags.split():
                return self.pop_to(k)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        if tag in SILENT:
            if tag != "head" or not self.path or self.path[-1][1] == "html":
                self.silent.append(tag)
            return
        if tag == "body":
            self.silent.clear()
        if tag in BLOCKS:
            self.end_line()
            self.close_open("p", ("td", "th", "div", "section", "article", "li", "blockquote", "button", "body"))
        if tag in _CLOSES:
            self.close_open(*_CLOSES[tag])
        if tag in EMPTY:
            if tag == "br":
                self.pieces.append("\n")
            return
        self.count += 1
        self.links += tag == "a"
        header = tag == "header" and not any(t in ("article", "main") for _, t, _ in self.path)
        self.path.append((self.count, tag, 2 if header else _around(tag, attrs)))

    def handle_startendtag(self, tag, attrs):
        if tag in SILENT:
            self.tags += 1
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in ("head", "body", "html"):
                self.silent.clear()
            return
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.path) - 1, -1, -1):
            open_tag = self.path[k][1]
            if open_tag == tag:
                return self.pop_to(k)
            if open_tag in BLOCKS and tag not in BLOCKS:
                return None
        return None

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian weights over the lines around each line; past the ends the weights are shared by those that exist."""
    reach = max(1, int(np.ceil(3 * sigma)))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    part = slice(reach, reach + len(ratio))
    return np.convolve(ratio, weight)[part] / np.convolve(np.ones(len(ratio)), weight)[part]


def content_lines(lines: list[tuple[str, int, int, tuple]], sigma: float = SIGMA, level: float = LEVEL) -> list[int]:
    """The lines of the content region, in page order."""
    size = np.array([len(text) for text, *_ in lines], float)
    whole = sum(len(text) for text, *_, path in lines if not any(around == 2 for *_, around in path))
    named: dict[int, int] = {}
    for text, *_, path in lines:
        for number, _, around in path:
            if around == 1 and not any(x == 2 for *_, x in path):
                named[number] = named.get(number, 0) + len(text)
    wrappers = {number for number, n in named.items() if n >= MOST * whole}
    free = np.array([not any(around == 2 or around == 1 and number not in wrappers for number, _, around in path) for *_, path in lines], bool)
    if not free.any():
        return []
    linked = np.array([min(1.0, links / len(text)) for text, _, links, _ in lines])
    ratio = np.where(free, size * (1 - linked) / np.maximum(1, [tags for _, tags, _, _ in lines]), 0.0)
    level_line = smoothed(ratio, sigma)
    high = free & (level_line >= level * level_line.std()) & (ratio > 0)
    if not high.any():
        high = free & (linked <= LINKED)
    weight = np.where(high, size, 0.0)
    held: dict[int, float] = {}
    for i in np.flatnonzero(high):
        for number, *_ in lines[i][3]:
            held[number] = held.get(number, 0.0) + weight[i]
    chosen, depth, kind = None, -1, ""
    for i in np.flatnonzero(high):
        for d, (number, tag, _) in enumerate(lines[i][3]):
            best = tag in ("article", "main")
            if held[number] >= MOST * weight.sum() and (d > depth and tag in BLOCKS and (kind not in ("article", "main") or best)):
                chosen, depth, kind = number, d, tag
    if kind in ("p", "h1", "h2", "h3", "li", "td", "tr", "body", "html", ""):  # no element is the article's own
        keep = np.flatnonzero(high)
        inside = np.arange(len(lines))
        region = free & (inside >= keep[0]) & (inside <= keep[-1]) & (high | (linked <= LINKED))
        first = int(keep[0])
        while first > 0 and free[first - 1] and any(t in ("h1", "h2", "h3") for _, t, _ in lines[first - 1][3]):
            first -= 1
            region[first] = True
        return np.flatnonzero(region).tolist()
    return [i for i in range(len(lines)) if free[i] and any(number == chosen for number, *_ in lines[i][3])]


def main_text(page: str) -> str:
    """The blocks of a page's main text, joined by an empty line."""
    parser = Lines()
    k = 0
    while k < len(page):
        step = max(CHUNK, len(parser.rawdata))  # what is still open is scanned again, so it must double
        parser.feed(page[k : k + step])
        k += step
    if re.match(r"<[!/?A-Za-z]", parser.rawdata):  # a tag or comment in which the page breaks off
        parser.rawdata = ""
    parser.close()
    parser.end_line()
    return "\n\n".join(parser.lines[i][0] for i in content_lines(parser.lines))


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages``.

    Null or empty html, and html without an article's text, gives an empty text. Repeated rows are read alike; an empty
    table gives no rows; null ids and urls stay null. Other columns, whatever their names, aren't read. White space of any kind
    inside a block is one space. A page that breaks off or leaves elements open is read as far as it goes.
    """
    small_batches(pages.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sub_batches(b, "html", SLICE):
                texts = [main_text(page.decode("utf-8", "replace")) for page in byte_values(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    rows = pages.select("page_id", "url", "html")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = pa.schema([("page_id", _arrow(fields["page_id"])), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return rows.mapInArrow(extract, f"page_id {fields['page_id']}, url string, text string, n_chars long")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
