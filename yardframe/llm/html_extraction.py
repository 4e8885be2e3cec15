"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text that no block tag interrupts, each with its root-to-leaf path of
block tags. For every path the text length, punctuation and link text of all its blocks are summed; a path's
ratio is its text outside links, raised by punctuation, per block. The ratios are smoothed over neighbouring
blocks in page order and fused with the path's own ratio; paths whose score is below a share of the page's
level (the mean score by text) go. This decides on every page. What a page says about its parts weighs in:

* Paths inside an element marked as article or main part score RAISE times as much, paths outside
  less by the share of the text that such elements hold. A short main part does not outweigh a page of text.
* Parts whose class, id or tag (form, fieldset) speaks of adverts, notices, sidebars, menus and the like score
  LOWER times as much. Such a mark is void where its element holds more than half of the text (of the article
  text, if there is any) and that is all of it or VOID_CHARS characters at least, as for a form around a whole page.
* Navigation, header, footer, aside, dialog and button elements, reader comments, scripts, styles and hidden
  parts are not read. A header inside the article is read.

A heading stays where the block behind it does, as a short line has a low ratio.

Each page is read for itself inside Arrow batches: there is no shuffle, and a task holds one batch.
A null or empty page gives an empty text. Broken markup is read as browsers do: unknown or unclosed tags
never fail, unfinished references stay as text, text after a cut counts as far as it goes. A tag that the page's end
cuts is dropped if it is a name or carries attributes; otherwise it is text ("a <b then").
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# HTML elements by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title script style noscript template svg math iframe object canvas audio video select textarea option".split())
STRONG = frozenset("nav header footer aside button menu dialog".split())
WEAK = frozenset("form fieldset".split())
CLOSED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
BOILER_NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|breadcrumbs?|cookies?|consent|gdpr|"
    r"footer|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|notices?|notification|alert|popup|modal|overlay|pagination|pager|related|"
    r"recommend\w*|share|sharing|social|side|sidebar|widgets?|toolbar|topbar|login|signup|search|skip|toc|copyright|legal|disclaimer)(?:$|[_-]|\d)", re.I)
COMMENT_NAMES = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[_-]|\d)", re.I)
#: Names that tell a state or a topic of an element, not what it is.
STATES = re.compile(r"^(?:has|no|with|without|is|tag|category|format|page|single)[_-]|[_-](?:open|opened|closed|enabled|disabled|on|off|left|right)$", re.I)
STRONG_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog menu menubar toolbar".split())
WEAK_ROLES = frozenset("search form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡]")
TAG_BEGINS = re.compile(r"<[a-zA-Z/!?]")
CUT_WORDS = re.compile(r"<[a-zA-Z][^\s/=]*\s+[^\s=][^=]*$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
THRESHOLD = 0.25
SPREAD = 2
RAISE = 200.0
LOWER = 0.0005
VOID_CHARS = 160


@dataclass
class Block:
    path: int
    tag: str
    text: str
    link_chars: int
    article: bool
    marks: tuple[int, ...]  # elements around it that their names lower


@dataclass
class Element:
    """An open element and what it hands to its inside."""

    tag: str
    block: str  # the nearest block tag
    path: int
    unread: bool
    article: bool
    marks: tuple[int, ...]
    linked: bool


class PageReader(HTMLParser):
    """Blocks of one page in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.root = Element("", "", 0, False, False, (), False)
        self.open: list[Element] = []
        self.paths: dict[tuple, int] = {}
        self.marked = 0
        self.article_seen = False
        self.parts: list[str] = []
        self.linked = 0

    def _top(self) -> Element:
        return self.open[-1] if self.open else self.root

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            at = self._top()
            self.blocks.append(Block(at.path, at.block, text, self.linked, at.article, at.marks))
        self.parts, self.linked = [], 0

    def _close(self, upto: int) -> None:
        if any(e.tag in BLOCKS for e in self.open[upto:]):
            self._end_block()
        del self.open[upto:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in CLOSED_BY.get(self._top().block, ()):
            self._close(max(i for i, e in enumerate(self.open) if e.tag in BLOCKS))
        if tag in BLOCKS:
            self._end_block()
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        role = given.get("role")
        up = self._top()
        names = [] if tag in ("html", "body") else [n for n in f"{given.get('class', '')} {given.get('id', '')}".split() if not STATES.search(n)]
        main = tag in ("article", "main") or role in ("main", "article") or given.get("itemprop") == "articleBody"
        unread = up.unread or tag in SILENT or tag in STRONG and not (tag == "header" and up.article) or role in STRONG_ROLES \
            or "hidden" in given or given.get("aria-hidden") == "true" or any(map(COMMENT_NAMES.search, names))
        weak = tag in WEAK or role in WEAK_ROLES or tag not in ("article", "main") and any(map(BOILER_NAMES.search, names))
        marks = up.marks
        if weak:
            self.marked += 1
            marks = (*marks, self.marked)
        self.article_seen |= main and not unread
        path, block = up.path, up.block
        if tag in BLOCKS:
            path, block = self.paths.setdefault((path, tag, weak, main), len(self.paths) + 1), tag
        self.open.append(Element(tag, block, path, unread, up.article or main, marks, up.linked or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
        if tag == "p":
            self._end_block()

    def handle_data(self, data: str) -> None:
        at = self._top()
        if at.unread:
            return
        self.parts.append(data)
        if at.linked:
            self.linked += len(data.strip())

    def read(self, page: str) -> list[Block]:
        cut = TAG_BEGINS.search(page, page.rfind(">") + 1)
        if cut:
            rest = page[cut.start() :]
            page = page[: cut.start()] + ("&lt;" + rest[1:].replace("<", "&lt;") if CUT_WORDS.match(rest) else "")
        self.feed(page)
        self.close()
        self._end_block()
        if self.article_seen and not any(b.article for b in self.blocks):  # an empty article is no reason to take adverts for it
            return [b for b in self.blocks if not b.marks]
        return self.blocks


def void_marks(blocks: list[Block]) -> set[int]:
    """Marked elements that hold most of the text, so their names say nothing about it."""
    article = any(b.article for b in blocks)
    held: Counter[int] = Counter()
    total = 0
    for b in blocks:
        if b.article or not article:
            chars = len(b.text) - min(b.link_chars, len(b.text))
            total += chars
            for mark in b.marks:
                held[mark] += chars
    return {m for m, chars in held.items() if 2 * chars > total and (chars == total or chars >= VOID_CHARS)}


def scores(blocks: list[Block], spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each block the score of its path, its text outside links, its path's share of link text, and its marks' factor."""
    void = void_marks(blocks)
    lowered = [LOWER ** sum(m not in void for m in b.marks) for b in blocks]
    _, at, path = np.unique(list(zip([b.path for b in blocks], lowered, strict=True)), axis=0, return_index=True, return_inverse=True)
    path = path.ravel()
    factor = np.array(lowered)
    sums = lambda values: np.bincount(path, values, len(at))
    count, length = sums(np.ones(len(blocks))), sums([len(b.text) for b in blocks])
    linked = np.array([min(b.link_chars, len(b.text)) for b in blocks])
    links = sums(linked)
    marks = sums([len(PUNCTUATION.findall(b.text)) for b in blocks])
    own = (length - links) * (1.0 + marks / (1.0 + length / 100.0)) / count
    row = own[path] * factor
    row = np.concatenate([np.full(spread, row[0]), row, np.full(spread, row[-1])])
    smooth = sums(np.convolve(row, np.ones(2 * spread + 1) / (2 * spread + 1), "valid")) / count
    fused = np.sqrt(own * smooth)[path] * factor
    return fused, (np.array([len(b.text) for b in blocks]) - linked) * factor, (links / length)[path], factor


def choose(blocks: list[Block], threshold: float = THRESHOLD, spread: int = SPREAD) -> list[Block]:
    """The content blocks of a page by the ratios of their tag paths."""
    if not blocks:
        return []
    score, weight, links, factor = scores(blocks, spread)
    inside = np.array([b.article for b in blocks])
    total = weight.sum()
    if total <= 0:
        return []
    level = (score * weight).sum() / total
    share = weight[inside].sum() / total
    raised = score * np.where(inside, RAISE, 1.0 - share)
    keep = (raised >= threshold * level) & (raised > 0) & (inside | (links <= 0.5))
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i].tag in HEADINGS and factor[i] == 1.0 and (links[i] <= 0.5 or inside[i]):
            keep[i] |= keep[i + 1] and inside[i] == inside[i + 1]
    return [b for b, k in zip(blocks, keep, strict=True) if k]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in choose(PageReader().read(page or "")))


def extract_main_text(pages: DataFrame, *, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with columns text (empty if none) and n_chars (its code points); other columns stay, columns
    of those two names are replaced."""
    kept = [c for c in pages.columns if c not in (html, text, n_chars)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(html)]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*kept, text, n_chars])

    schema = pages.select(*kept).schema.add(text, StringType()).add(n_chars, LongType())
    return pages.select(*kept, F.col(html).alias(html)).mapInArrow(run, schema)
