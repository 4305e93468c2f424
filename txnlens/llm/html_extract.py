"""HTML extraction by tag-path ratios: the main text of a page without its furniture.

A page is parsed into text blocks, each with the path of tags from the root to it; inline
markup does not count as a tag, classes and roles do.

1. Per path the text length, the punctuation, the text inside links and the number of blocks
   are summed. Two ratios follow, length and punctuation per block, both up to a bound from
   which text is simply long (``FULL``); they are smoothed over the page order with a Gaussian
   window, fused by their geometric mean, and lowered by the share of links and where a path
   is not repeated.
2. Markup is a prior: what stands below a navigation, footer, aside, page header or form, or
   below an element whose class, id or role names a menu, an advert, a notice, a share bar, a
   sidebar or comments (a whole token: ``site-footer``, not ``has-sidebar``), has its score times
   ``PRIOR``, unless that element wraps others and holds most of the page's text. Text that
   stands in a container itself, not in a paragraph or the like, has it times ``BARE``.
3. Paths whose mean score reaches ``SHARE`` of the highest are content paths.
4. A block of a content path weighs its length times the square of its score's share. From the root
   the region goes down to the deepest element with most of the weight, and up again from a
   block to its parent, to any element that has another branch of ``JOIN`` of its weight or
   more, and to a marked article or main part.
5. Main text is, inside the region, every block of a content path; and every other block that
   is neither furniture nor mostly links, if it stands between two content blocks, in a branch
   that carries weight, or anywhere in a region without furniture; and before the first
   content block the headings beside it or beside an element that holds it.

Scripts, styles, form controls and hidden parts have no text. White space inside a block becomes
one space, blocks are trimmed and joined in page order by one space. Nothing else is
dropped or capped.

Results for odd input: null, empty and blank pages, and pages without main text, give an
empty text of zero characters; markup that is cut off or never closed is closed at its
end; repeated rows and null ids or urls are kept as they are; an empty table gives an
empty result; other columns of the input are ignored.
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

from txnlens.llm import common

SIGMA = 0.5
SHARE, JOIN, PRIOR, BARE, ALONE = 0.5, 0.04, 0.1, 0.4, 0.4
#: ``ALONE`` is what a path with one block loses, and one with more in proportion.
#: Characters and punctuation marks of a block beyond which it counts no more.
FULL = (400.0, 10.0)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Part of the text around them, no blocks of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title select textarea input iframe object embed svg canvas option datalist audio video map".split())
FURNITURE = frozenset("nav footer aside form button menu dialog".split())
MARKED = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section center fieldset figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of which a token of class, id or role that names furniture is made.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar "
    "header masthead footer sidebar aside complementary contentinfo widget related recommended newsletter subscribe subscription signup share sharing social "
    "comment comments comentarios kommentare commentaires disqus reply replies respond cookie cookies consent notice popup modal overlay alert hidden search pagination pager form login".split()
)
#: May stand in such a token beside them.
BESIDE_NAMES = frozenset("site global list links box bar buttons posts".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Opening a tag closes an open one of these, up to the nearest boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PUNCTUATION = re.compile(r"[.,;:!?…。，、؟।]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


class _Block(NamedTuple):
    path: tuple[str, ...]  #: tags with classes, from the root
    chain: tuple[int, ...]  #: numbers of the elements around it, from the root (0)
    text: str
    links: int  #: characters inside links
    around: tuple[int, ...]  #: numbers of the elements around it that are furniture by tag or name


class _Element(NamedTuple):
    tag: str
    step: str
    number: int
    hidden: bool
    around: tuple[int, ...]


class _Blocks(HTMLParser):
    """Text blocks of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.blocks: list[_Block] = []
        self.tags: list[str] = [""]  # by element number
        self.text: list[str] = []
        self.links = 0
        self.link_depth: int | None = None

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            chain = (0, *(x.number for x in self.open))
            self.blocks.append(_Block(tuple(x.step for x in self.open), chain, text, min(self.links, len(text)), self.open[-1].around if self.open else ()))
        self.text, self.links = [], 0

    def _hides(self, tag: str, attrs: list) -> bool:
        if tag in SILENT:
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                return True
        return False

    def _is_furniture(self, tag: str, attrs: list) -> bool:
        if tag in FURNITURE or (tag == "header" and not any(x.tag in MARKED for x in self.open)):
            return True
        if tag in ("html", "body", *MARKED):
            return False
        tokens = (x for name, value in attrs if name in ("class", "id", "role") for x in (value or "").lower().split())
        return any(not NAMES.isdisjoint(words) and words <= NAMES | BESIDE_NAMES for words in (set(_WORD.findall(x)) for x in tokens))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "a":
            self.link_depth = len(self.open)
        furniture, hides = self._is_furniture(tag, attrs), self._hides(tag, attrs)
        if tag in INLINE and not furniture and not hides:
            return
        self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close({"p"}, set())
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        hidden, around = (self.open[-1].hidden, self.open[-1].around) if self.open else (False, ())
        number = len(self.tags)
        self.tags.append(tag)
        named = " ".join(v or "" for k, v in attrs if k in ("class", "role"))
        self.open.append(_Element(tag, f"{tag}.{named}" if named else tag, number, hidden or hides, (*around, number) if furniture else around))

    def _shut(self, k: int) -> None:
        del self.open[k:]
        if self.link_depth is not None and self.link_depth > k:
            self.link_depth = None

    def _close(self, tags: set, bounds: set) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k].tag
            if tag in tags:
                self._shut(k)
                return
            if tag in bounds or (not bounds and tag not in INLINE):
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = None
        if tag in VOID or not any(x.tag == tag for x in self.open):
            return
        self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self._shut(k)
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1].hidden):
            self.text.append(data)
            if self.link_depth is not None:
                self.links += len(data.strip())


def _smooth(x: np.ndarray) -> np.ndarray:
    width = max(1, int(3 * SIGMA))
    weights = np.exp(-0.5 * (np.arange(-width, width + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(x, width, mode="edge"), weights / weights.sum(), mode="valid")


def _furniture(blocks: list[_Block]) -> list[bool]:
    """Which blocks stand below furniture by markup; a wrapper of other elements with most of the text is none."""
    held: dict[int, int] = {}
    wraps = set()
    for x in blocks:
        for n in x.around:
            held[n] = held.get(n, 0) + len(x.text)
            if x.chain[-1] != n:
                wraps.add(n)
    total = sum(len(x.text) for x in blocks)
    return [any(n not in wraps or 2 * held[n] <= total for n in x.around) for x in blocks]


def scores(blocks: list[_Block], furniture: list[bool]) -> dict[tuple, float]:
    """The fused ratio of each path, as a share of the highest."""
    sums: dict[tuple, list] = {}
    for x in blocks:
        held = sums.setdefault(x.path, [0, 0, 0, 0])
        for k, n in enumerate((len(x.text), len(_PUNCTUATION.findall(x.text)), x.links, 1)):
            held[k] += n
    each = [sums[x.path] for x in blocks]
    length = _smooth(np.array([min(h[0] / h[3], FULL[0]) for h in each]))
    points = _smooth(np.array([min((h[1] + 1) / h[3], FULL[1]) for h in each]))
    prose = np.array([(1 - h[2] / h[0]) * (1 - ALONE / h[3]) for h in each])
    prior = np.array([PRIOR if f else BARE if not x.path or x.path[-1].split(".")[0] in CONTAINERS else 1.0 for x, f in zip(blocks, furniture, strict=True)])
    fused = np.sqrt(length * points) * prose * prior
    mean: dict[tuple, list] = {}
    for x, value in zip(blocks, fused.tolist(), strict=True):
        mean.setdefault(x.path, []).append(value)
    top = max(fused.max(), 1e-9)
    return {path: sum(xs) / len(xs) / top for path, xs in mean.items()}


def _region(blocks: list[_Block], weights: list[float], tags: list[str]) -> tuple[int, dict[int, float]]:
    """The element that holds the main text, and the weight of each branch: by element, and of single blocks by ``-1 - place``."""
    below: dict[int, float] = {}
    branches: dict[int, dict[int, float]] = {}  # element -> its child elements and own blocks
    for k, (x, w) in enumerate(zip(blocks, weights, strict=True)):
        for n in x.chain:
            below[n] = below.get(n, 0.0) + w
        for parent, child in zip(x.chain, (*x.chain[1:], -1 - k), strict=True):
            held = branches.setdefault(parent, {})
            held[child] = held.get(child, 0.0) + w
    way = [0]
    while (heaviest := max(branches.get(way[-1], {}).items(), key=lambda b: b[1], default=(-1, 0.0))) and heaviest[0] > 0 and 2 * heaviest[1] > below[0]:
        way.append(heaviest[0])
    if len(way) > 1 and all(b < 0 for b in branches[way[-1]]):
        way.pop()  # a block
    region = way[-1]
    for parent, child in zip(way[-2::-1], way[:0:-1], strict=True):
        if tags[parent] in MARKED or any(b != child and w >= JOIN * below[region] for b, w in branches[parent].items()):
            region = parent
    return region, branches.get(region, {})


def extract(html: str) -> str:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    if not blocks:
        return ""
    furniture = _furniture(blocks)
    score = scores(blocks, furniture)
    content = [score[x.path] >= SHARE and not f for x, f in zip(blocks, furniture, strict=True)]
    weights = [len(x.text) * score[x.path] ** 2 if c else 0.0 for x, c in zip(blocks, content, strict=True)]
    region, branches = _region(blocks, weights, parser.tags)
    inside = [region in x.chain for x in blocks]
    at = [k for k, c in enumerate(content) if c and inside[k]]
    if not at:
        return ""
    tag = parser.tags[region]
    aside = [f or 2 * x.links > len(x.text) for x, f in zip(blocks, furniture, strict=True)]
    clean = tag in MARKED or (tag not in ("", "html", "body") and not any(a for a, i in zip(aside, inside, strict=True) if i))
    heavy = {b for b, w in branches.items() if w >= JOIN * sum(branches.values())}

    way = blocks[at[0]].chain

    def belongs(k: int, x: _Block) -> bool:
        if content[k] or aside[k]:
            return content[k] and inside[k]
        if inside[k] and (clean or at[0] < k < at[-1] or not heavy.isdisjoint(x.chain)):
            return True
        last = parser.tags[x.chain[-1]]
        return k < at[0] and last in HEADINGS and (x.chain[-2] in way or (last == "h1" and inside[k]))

    return " ".join(x.text for k, x in enumerate(blocks) if belongs(k, x))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.sliced(batches):
        texts = [extract(x) if x else "" for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    common.bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
