"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root (names in class, id and role included).

1. For every path the lengths of its texts and their punctuation are summed and divided by the number of its nodes; both
   sequences, laid out in page order, are smoothed over neighbouring blocks and fused into one value per block.
2. What else is known of a path only shifts its score: whether it holds nothing but links, the tags, roles and names of
   menus and page headers (PLACED: what is as dense as the article is still content), of footers, sidebars, adverts,
   notices, forms and comments, which ratios alone can't tell from prose (HEARD), and names that have such a word among
   others (MIXED: hardly anything).
3. Blocks whose score reaches SHARE of the root mean square of the page's unmarked paths are content. The region of the
   article is the lowest container around all content and the title before it, up to the outermost article or main.
4. In the region a block that isn't content itself inherits the region's score: so headings, captions, list items and
   cells stay, however short. A marked part passes nothing on, unless content makes up most of its own text.

Time and memory grow with the length of the page, whatever its depth: paths are numbers, and regions and factors pass
from parents to children.

Cases: a null html counts as empty, and gives the empty text; broken markup (open tags, ends of file within a tag, open
quotes) is read as browsers do as far as it matters for blocks; a page of marked parts only has no main text; repeated
rows give repeated results; a null url or page_id is kept; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.textkernel import string_column

#: Fixed values of the HTML standard: tags without content, of raw text, that open a block, that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags, roles and names (words of class and id) of page parts around an article.
PLACED_TAGS = frozenset("nav menu search".split())
PLACED_ROLES = frozenset("navigation banner menu menubar".split())
PLACED_WORDS = frozenset("breadcrumb breadcrumbs masthead menu nav navbar navigation pagination toolbar topbar".split())
#: The same of page footers, sidebars, adverts, notices, forms and readers' comments.
HEARD_TAGS = frozenset("footer aside form button select option optgroup dialog head".split())
HEARD_ROLES = frozenset("contentinfo complementary search form alert dialog toolbar".split())
HEARD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements alert alerts comment comments commentlist consent cookie cookies copyright disqus feedback footer modal newsletter notice notices opinions overlay popup promo promoted reactions"
    " replies reply respond sharing sidebar sidebars signup social sponsor sponsored subscribe talkback".split()
)
#: Words that may stand beside them in a name without changing what it is.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box buttons center col column container content footer form global group header holder inner item items left link links list main outer page panel primary reader readers region right"
    " row secondary section site slot sub text thread title top unit user users widget widgets wrap wrapper zone".split()
)
#: Names that parts of articles have as well.
MIXED_WORDS = frozenset("banner discussion related responses share thread widget".split())
#: Words beside "header" in a class or id that make it the page's, not the article's.
PAGE_WORDS = frozenset("site page global top main".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("# html body div section center article main".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
PUNCTUATION = ".,;:!?。，"
SMOOTH = np.array([1, 2, 4, 2, 1]) / 10
#: Factors of a path's score for each mark, and for a path of so many nodes that are only links.
PLACED, HEARD, MIXED, LINKS = 0.45, 0.05, 0.8, 0.02
LINK_SHARE, LINK_NODES = 0.9, 3
#: A block is content if its score reaches this share of the root mean square of unmarked paths; inherited scores are at
#: most so many times this threshold.
SHARE = 0.4
INHERITED = 4.0


def _named(words: list[str]) -> float:
    """The factor of a class or id: that of its telling word if all others are plain, and hardly any if it says more than that."""
    for known, factor in ((HEARD_WORDS, HEARD), (PLACED_WORDS, PLACED)):
        if not known.isdisjoint(words):
            return factor if all(w in HEARD_WORDS or w in PLACED_WORDS or w in PLAIN_WORDS for w in words) else MIXED
    return 1.0 if MIXED_WORDS.isdisjoint(words) else MIXED


class _Element:
    __slots__ = ("tag", "path", "parent", "weight", "own", "in_main", "place", "inline")

    def __init__(self, tag: str, parent: _Element | None, attributes: str, paths: dict[tuple[int, str], int], place: int) -> None:
        self.tag, self.parent, self.place = tag, parent, place
        marks = {k.lower(): unescape(a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        tokens = [WORD.findall(t) for t in f"{marks.get('class', '')} {marks.get('id', '')}".split()]
        words = [w for t in tokens for w in t]
        role = marks.get("role", "")
        label = f"{tag}.{'-'.join(words)}" if words else tag
        self.path = paths.setdefault((parent.path if parent else -1, label), len(paths))
        # A header inside an article is that article's own heading; elsewhere it is the page's.
        header = tag == "header" or (tag in BLOCK and "header" in words and (len(words) == 1 or not PAGE_WORDS.isdisjoint(words)))
        named = tag not in ("html", "body", *MAIN)
        self.own = 1.0
        if "hidden" in marks:
            self.own = 0.0
        elif tag in HEARD_TAGS or (named and role in HEARD_ROLES):
            self.own = HEARD
        elif tag in PLACED_TAGS or (header and not (parent and parent.in_main)) or (named and role in PLACED_ROLES):
            self.own = PLACED
        #: the factor of this element alone, and of its path
        self.own = min([self.own, *(map(_named, tokens) if named else ())])
        self.weight = self.own * (parent.weight if parent else 1.0)
        self.in_main = tag in MAIN or bool(parent and parent.in_main)
        #: how many inline elements of each tag are open within this block
        self.inline: dict[str, int] = {}


class Block(NamedTuple):
    text: str
    element: _Element
    links: int  # characters within links, before white space is joined


def _closes(open_tag: str, new: str) -> bool:
    """Whether an open element ends where a new one starts."""
    if open_tag == "p":
        return new in BLOCK and new not in ("html", "body", "head")
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "tbody", "tfoot"), "td": ("td", "th", "tr", "tbody", "tfoot"), "th": ("td", "th", "tr", "tbody", "tfoot")}
    return new in same.get(open_tag, ()) or (open_tag == "head" and new == "body")


def blocks(html: str) -> tuple[list[Block], list[_Element]]:
    """The blocks of text of a page in order, and all its elements, parents first."""
    paths: dict[tuple[int, str], int] = {}
    top = _Element("#", None, "", paths, 0)
    elements, stack, holders = [top], [top], [top]  # holders: the open blocks of the stack
    opened: dict[str, int] = {}
    out: list[Block] = []
    text: list[str] = []
    links = at = 0

    def add(piece: str) -> None:
        nonlocal links
        # What an inline element of its own kind holds (a button, an advert) is no part of the block around it.
        if stack[-1].weight == holders[-1].weight:
            text.append(piece)
            if holders[-1].inline.get("a") or holders[-1].tag == "a":
                links += len(piece.strip())

    def flush() -> None:
        nonlocal text, links
        joined = SPACE.sub(" ", unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, holders[-1], links))
        text, links = [], 0

    def pop() -> _Element:
        gone = stack.pop()
        opened[gone.tag] -= 1
        if gone is holders[-1]:
            holders.pop()
        else:
            holders[-1].inline[gone.tag] -= 1
        return gone

    while at < len(html):
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            # The end of a block closes what is open in it; that of an inline element doesn't close blocks.
            if tag in BLOCK:
                flush()
            if opened.get(tag) if tag in BLOCK else holders[-1].inline.get(tag):
                while pop().tag != tag:
                    pass
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCK:
            flush()
            while len(holders) > 1 and _closes(holders[-1].tag, tag):
                last = holders[-1]
                while pop() is not last:
                    pass
        element = _Element(tag, stack[-1], m[3] or "", paths, len(elements))
        elements.append(element)
        stack.append(element)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BLOCK:
            holders.append(element)
        else:
            holders[-1].inline[tag] = holders[-1].inline.get(tag, 0) + 1
    flush()
    return out, elements


def _paths(found: list[Block]) -> tuple[np.ndarray, ...]:
    """For each block the nodes, characters, characters within links and punctuation marks of its path."""
    path = np.unique([b.element.path for b in found], return_inverse=True)[1]
    count = lambda values: np.bincount(path, values)[path]
    return count(np.ones(len(found))), count([len(b.text) for b in found]), count([b.links for b in found]), count([sum(map(b.text.count, PUNCTUATION)) for b in found])


def _links(found: list[Block]) -> np.ndarray:
    """The factor for paths of links alone."""
    nodes, length, links, points = _paths(found)
    return np.where((nodes >= LINK_NODES) & (links >= LINK_SHARE * length) & (points < nodes), LINKS, 1.0)


def _ratios(found: list[Block]) -> np.ndarray:
    """For each block its path's fused ratio of text and punctuation to nodes, smoothed; little where all is links."""
    nodes, length, _, points = _paths(found)
    ratio, points = length / nodes, points / nodes
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), SMOOTH, "valid")
    return (smooth(ratio) * (1 + smooth(points)) * ratio * (1 + points)) ** 0.25 * _links(found)


def _scores(found: list[Block]) -> tuple[np.ndarray, float]:
    """The score of each block, and the threshold of content."""
    fused = _ratios(found)
    weight = np.array([b.element.weight for b in found])
    plain = fused[(weight == 1) & (_links(found) == 1)]
    # A page of marked parts only has no content.
    return fused * weight, SHARE * float(np.sqrt((plain**2).mean())) if len(plain) else float("inf")


def main_text(html: str) -> str:
    """The article of a page: its blocks joined by line feeds."""
    found, elements = blocks(html)
    if not found:
        return ""
    scores, least = _scores(found)
    content = np.flatnonzero(scores >= least).tolist()
    if not content:
        return ""
    # The article's title: the last h1 before the content, or a heading that stands directly before it.
    before = [k for k in range(content[0]) if found[k].element.tag == "h1"] or [k for k in range(max(content[0] - 1, 0), content[0]) if found[k].element.tag in HEADINGS]
    before = [k for k in before if found[k].element.weight == 1]
    region = _common([found[k].element for k in (*content, *before[-1:])], elements)
    factor = _inherited(region, elements, found, scores >= least) * min(float(scores[content].mean()), INHERITED * least)
    links = _links(found)
    kept = [b.text for b, own, alone in zip(found, scores, links) if factor[b.element.place] > 0 and max(own, factor[b.element.place] * alone) >= least]
    return "\n".join(kept)


def _common(chosen: list[_Element], elements: list[_Element]) -> _Element:
    """The lowest container around all of the blocks that these elements open, or the outermost article-like element around that."""
    held = np.zeros(len(elements), np.int64)
    for e in chosen:
        # A block with text of its own is a paragraph, whatever its tag: what stands beside it belongs to it.
        held[(e if e.tag in MAIN or not e.parent else e.parent).place] += 1
    for e in reversed(elements):
        if e.parent:
            held[e.parent.place] += held[e.place]
    at: _Element | None = elements[int(np.flatnonzero(held == len(chosen))[-1])]
    line = []
    while at:
        line.append(at)
        at = at.parent
    articles = [x for x in line if x.tag in MAIN]
    return articles[-1] if articles else next(x for x in line if x.tag in CONTAINERS)


def _inherited(region: _Element, elements: list[_Element], found: list[Block], content: np.ndarray) -> np.ndarray:
    """1 for elements that inherit the region's score: not those in a marked part, unless content makes up most of its text; 0 outside of the region."""
    held = np.zeros((len(elements), 2))
    for b, own in zip(found, content.tolist()):
        held[b.element.place] += (len(b.text), len(b.text) * own)
    for e in reversed(elements):
        if e.parent:
            held[e.parent.place] += held[e.place]
    out = np.zeros(len(elements))
    out[region.place] = 1
    for e in elements[region.place + 1 :]:
        out[e.place] = out[e.parent.place] * (e.own == 1 or held[e.place, 1] > held[e.place, 0] / 2)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h) for h in string_column(part, "html").to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op2_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
