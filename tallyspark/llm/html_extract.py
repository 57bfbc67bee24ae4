"""HTML extraction (9): flat text blocks, classified by a decision tree on their and their neighbours' shape.

A page is cut into flat blocks at block-level tags. Each block has its number of words and its link density
(share of words inside links), those of the blocks before and after it, and three hints: how strongly the
containers it stands in are marked as furniture (2: by their tag, as navigation, footers and forms are, or by a
name of nothing but words of furniture; 1: by a name that articles use too, such as ``notice`` or ``related-work``), whether they are marked as
the article, and whether it is a heading. A decision tree, grown by Gini impurity from the small labelled
table PAGES, tells article text from the rest. Names and tags are inputs to it like the others: runs of links inside
an article are a menu, long text without links in a container of a doubtful name is text, and pages that mark
nothing are told by words and link density of a block and its neighbours alone.

The scanner reads tags with quoted attributes, comments, and raw-text elements (scripts, styles), adds the
end tags that HTML lets authors leave out (list items, paragraphs, cells, rows), and closes what is left
open when an outer element ends, however deep it lies. Character references are decoded, white space in
a block becomes one blank, and the blocks of the article are joined in page order by a line feed.

Edge cases: null counts as an empty page and gives an empty text; text outside any tag is a block of its
own; unclosed comments and scripts run to the end of the page; very long pages are scanned in linear time;
repeated rows each get a row; an empty table gives an empty result; extra columns are passed over.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table

#: Element names by what the scanner does with them.
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav footer aside form head title menu dialog button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Implied end tags, as in HTML's rules for building trees: a start tag closes the innermost element of a scope
#: if that has one of the names given. Scopes are the names at which a look outwards stops: for list items, for
#: paragraphs, for parts of a table, and for the end tags of INLINE (which close nothing outside of them).
ITEM, PARAGRAPH, PART, WALL = range(4)
SCOPES = (
    BLOCK - {"address", "div", "p"},
    frozenset("p button caption html table td th".split()),
    frozenset("table caption colgroup tbody thead tfoot tr td th".split()),
    frozenset("article main body table".split()),
)
SCOPED = frozenset().union(*SCOPES)
INLINE = frozenset("p li b i a span em strong".split())
CELLS = frozenset("td th caption colgroup".split())
IMPLIED = {
    "li": [(ITEM, {"li"})], "dt": [(ITEM, {"dt", "dd"})], "dd": [(ITEM, {"dt", "dd"})], "option": [(ITEM, {"option"})],
    **dict.fromkeys(("td", "th"), [(PART, CELLS)]), "tr": [(PART, CELLS | {"tr"})],
    **dict.fromkeys("caption colgroup tbody thead tfoot".split(), [(PART, CELLS | {"tr", "tbody", "thead", "tfoot"})]),
}
for _name in "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split():
    IMPLIED[_name] = [*IMPLIED.get(_name, []), (PARAGRAPH, {"p"})]
#: Words in class, id or role that mark furniture, those that articles use too, and those of articles.
_NAME = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
FURNITURE_WORD = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|sidebar|menu|nav\w*|breadcrumbs?"
    r"|footer|masthead|topbar|toolbar|comments?|respond|replies|disqus|share|social|related|recommend\w*"
    r"|subscribe|newsletter|signup|login|search|popup|modal|pagination|pager|complementary|contentinfo|dialog"
)
#: Words that say nothing of what stands in an element, beside a word of furniture.
PLAIN_WORD = (
    r"site|page|main|global|top|bottom|left|right|upper|lower|inner|outer|primary|secondary|box|block|boxes|section|list|area|wrap|wrapper|container"
    r"|group|grid|row|col|column|bar|panel|slot|unit|zone|links?|posts?|articles?|stories|items?|widget|header|body|form|field|btn|button|icons?|overlay|text|\w*\d\w*"
)
FURNITURE_NAMES = re.compile(_NAME.format(FURNITURE_WORD), re.I)
#: A name made of such words alone is sure; beside any other word ("related-work", "comments-policy") it is doubtful.
SURE_NAME = re.compile(rf"(?:(?:{FURNITURE_WORD}|{PLAIN_WORD})(?:[_-]+|$))+", re.I)
DOUBTFUL_NAMES = re.compile(_NAME.format(r"notice|alert|side|header|widget|skip|tags"), re.I)
ARTICLE_NAMES = re.compile(_NAME.format(r"article\w*|story\w*|post|entry|content|prose|bodytext"), re.I)
#: Elements too small to be a container of furniture by a doubtful name.
PHRASES = frozenset("p li b i a span em strong q cite small h1 h2 h3 h4 h5 h6 td th".split())
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: An <a> that only names a place, without a target, is no link, and is often left open.
PLACE, TARGET = (re.compile(rf"(?:^|\s)(?:{names})(?=\s|$|=)", re.I) for names in ("name|id", "href"))
COMMENT = re.compile("comment|reply", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
MARK = re.compile(
    r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|([!?/][^>]*+)>)"
)
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "mark", "article", "heading")
#: The labelled table: pages of blocks (words, link density, mark, article, heading, 1 for article text) in page order.
PAGES = (
    # menu, advert, article with short and long paragraphs, footer
    ((1, 1, 2, 0, 0, 0), (1, 1, 2, 0, 0, 0), (1, 1, 2, 0, 0, 0), (8, 0, 2, 0, 0, 0), (7, 0, 0, 1, 1, 1), (3, 0, 0, 1, 0, 1),
     (45, 0, 0, 1, 0, 1), (1, 0, 0, 1, 0, 1), (90, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (14, 0, 2, 0, 0, 0)),
    # an article with one paragraph, then comments, long and without links, and a form
    ((2, 1, 2, 0, 0, 0), (2, 1, 2, 0, 0, 0), (5, 0, 0, 1, 1, 1), (60, 0.1, 0, 1, 0, 1), (2, 0, 2, 0, 1, 0), (35, 0, 2, 0, 0, 0),
     (120, 0, 2, 0, 0, 0), (28, 0.05, 2, 0, 0, 0), (4, 0, 2, 0, 0, 0), (1, 0, 2, 0, 0, 0)),
    # adverts and a box of related links within the article
    ((9, 0, 0, 1, 1, 1), (70, 0.05, 0, 1, 0, 1), (6, 0, 2, 1, 0, 0), (55, 0, 0, 1, 0, 1), (25, 0, 2, 1, 0, 0), (4, 0, 2, 1, 1, 0),
     (5, 1, 2, 1, 0, 0), (6, 1, 2, 1, 0, 0), (40, 0, 0, 1, 0, 1), (2, 0.5, 0, 1, 0, 1)),
    # comments within the main element, as long as its text
    ((7, 0, 0, 1, 1, 1), (33, 0, 0, 1, 0, 1), (70, 0.1, 0, 1, 0, 1), (2, 0, 2, 1, 1, 0), (45, 0, 2, 1, 0, 0), (80, 0.1, 2, 1, 0, 0), (28, 0, 2, 1, 0, 0),
     (130, 0, 2, 1, 0, 0), (31, 0, 2, 1, 0, 0), (40, 0, 2, 1, 0, 0)),
    # short lines before a link in the article
    ((4, 0, 0, 1, 0, 1), (3, 1, 0, 1, 0, 1), (22, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (5, 1, 0, 1, 0, 1), (60, 0, 0, 1, 0, 1), (3, 0, 0, 1, 1, 1),
     (1, 1, 0, 1, 0, 1), (12, 0.1, 0, 1, 0, 1)),
    # a menu within the article that nothing marks, and links in its text
    ((6, 0, 0, 1, 1, 1), (2, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (3, 1, 0, 1, 0, 0), (2, 1, 0, 1, 0, 0), (50, 0.2, 0, 1, 0, 1),
     (12, 0.4, 0, 1, 0, 1), (3, 1, 0, 1, 0, 1), (30, 0.1, 0, 1, 0, 1), (7, 0.6, 0, 1, 0, 1), (41, 0, 0, 1, 0, 1)),
    ((80, 0, 0, 1, 0, 1), (4, 0, 0, 1, 1, 1), (9, 0.2, 0, 1, 0, 1), (5, 0.4, 0, 1, 0, 1), (6, 0.3, 0, 1, 0, 1), (3, 1, 0, 1, 0, 0),
     (4, 1, 0, 1, 0, 0), (3, 1, 0, 1, 0, 0), (2, 1, 0, 1, 0, 0)),
    # doubtful names: long text among text is text, short or linked blocks are not, nor is any outside of the article
    ((30, 0, 0, 1, 0, 1), (34, 0, 1, 1, 0, 1), (52, 0.1, 1, 1, 0, 1), (40, 0, 0, 1, 0, 1), (5, 0, 1, 1, 0, 0), (28, 0, 0, 1, 0, 1),
     (12, 0.5, 1, 1, 0, 0), (9, 0.9, 1, 1, 0, 0), (60, 0, 0, 1, 0, 1), (25, 0.8, 1, 1, 0, 0), (26, 0, 1, 1, 0, 1)),
    ((12, 0, 1, 0, 0, 0), (3, 0, 1, 0, 0, 0), (2, 1, 1, 0, 0, 0), (50, 0, 0, 0, 0, 1), (45, 0, 0, 0, 0, 1), (20, 0, 1, 0, 0, 0),
     (15, 0.2, 1, 0, 0, 0), (4, 0, 1, 0, 1, 0), (30, 0, 1, 0, 0, 0)),
    # pages that mark nothing: menus are links among links, text is words among words
    ((2, 1, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (8, 0, 0, 0, 1, 1), (45, 0, 0, 0, 0, 1), (70, 0.05, 0, 0, 0, 1),
     (6, 0, 0, 0, 0, 1), (30, 0.1, 0, 0, 0, 1), (3, 1, 0, 0, 0, 0), (5, 0.8, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0)),
    ((5, 0.8, 0, 0, 0, 0), (12, 0.9, 0, 0, 0, 0), (11, 0.8, 0, 0, 0, 0), (6, 0.2, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (30, 0.7, 0, 0, 0, 0),
     (8, 1, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (4, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)),
    ((4, 0, 0, 0, 1, 1), (7, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1)),
    ((6, 0, 0, 0, 0, 1), (8, 0, 0, 0, 0, 1)),
    ((18, 0, 0, 0, 0, 1),),
    (
        (2, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (11, 0, 0, 0, 0, 1), (7, 0, 0, 0, 0, 1), (60, 0, 0, 0, 0, 1),
        (4, 0, 0, 0, 0, 1), (33, 0.1, 0, 0, 0, 1),
    ),
    ((3, 1, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (3, 1, 0, 0, 0, 0), (3, 1, 0, 0, 1, 0), (25, 0.2, 0, 0, 0, 1),
     (20, 0, 0, 0, 0, 1), (40, 0, 0, 0, 0, 1), (6, 0.9, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)),
    # headings of articles stand before text, those of menus before links
    ((2, 1, 0, 0, 0, 0), (3, 0, 0, 0, 1, 0), (2, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (50, 0, 0, 0, 0, 1), (3, 0, 0, 0, 1, 1),
     (22, 0, 0, 0, 0, 1), (4, 0.2, 0, 0, 1, 0), (3, 1, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0)),
    ((9, 0, 0, 1, 1, 1), (1, 0, 0, 1, 0, 1), (5, 0, 0, 1, 1, 1), (2, 0, 0, 1, 0, 1), (12, 0, 2, 0, 0, 0), (1, 1, 2, 0, 0, 0)),
    # marked links between paragraphs of the article: adverts, share boxes, buttons, menus and related boxes
    ((60, 0, 0, 1, 0, 1), (3, 1, 2, 1, 0, 0), (55, 0, 0, 1, 0, 1)),
    ((9, 0, 0, 1, 1, 1), (70, 0.05, 0, 1, 0, 1), (5, 1, 2, 1, 0, 0), (40, 0, 0, 1, 0, 1), (2, 1, 2, 1, 0, 0), (33, 0, 0, 1, 0, 1), (12, 0.9, 2, 1, 0, 0),
     (25, 0, 0, 1, 0, 1), (4, 0.7, 2, 1, 0, 0), (3, 0.5, 2, 1, 0, 0)),
    ((45, 0, 0, 1, 0, 1), (1, 1, 2, 1, 0, 0), (1, 1, 2, 1, 0, 0), (38, 0, 0, 1, 0, 1), (30, 1, 2, 1, 0, 0), (50, 0.1, 0, 1, 0, 1), (8, 1, 1, 1, 0, 0), (41, 0, 0, 1, 0, 1)),
    ((28, 0, 0, 0, 0, 1), (4, 1, 2, 0, 0, 0), (36, 0, 0, 0, 0, 1), (7, 0.8, 2, 0, 0, 0), (20, 0, 0, 0, 0, 1)),
    # paragraphs of the article that are links throughout: one between texts, or the last after text
    ((50, 0, 0, 1, 0, 1), (14, 1, 0, 1, 0, 1), (44, 0, 0, 1, 0, 1), (8, 1, 0, 1, 0, 1), (30, 0.1, 0, 1, 0, 1), (4, 1, 0, 1, 0, 1), (5, 0, 2, 0, 0, 0)),
    ((8, 0, 0, 1, 1, 1), (20, 0, 0, 1, 0, 1), (6, 0, 0, 1, 0, 1), (5, 1, 0, 1, 0, 1)),
    ((8, 0, 0, 1, 1, 1), (25, 0, 0, 1, 0, 1), (3, 0, 0, 1, 0, 1), (2, 1, 0, 1, 0, 1), (2, 1, 2, 0, 0, 0)),
    # while the first and the last of several links are a menu's
    ((1, 0, 0, 1, 1, 1), (2, 1, 0, 1, 0, 0), (2, 1, 0, 1, 0, 0), (2, 1, 0, 1, 0, 0), (22, 0, 0, 1, 0, 1), (35, 0, 0, 1, 0, 1), (4, 1, 0, 1, 0, 0), (5, 1, 0, 1, 0, 0),
     (2, 1, 0, 1, 0, 0), (40, 0, 0, 1, 0, 1)),
    ((3, 0, 0, 1, 1, 1), (6, 1, 0, 1, 0, 0), (7, 1, 0, 1, 0, 0), (18, 0, 0, 1, 0, 1), (1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (9, 0, 0, 1, 0, 1)),
    # names that only hold a word of furniture over long text of the article
    ((31, 0, 0, 1, 0, 1), (45, 0, 1, 1, 0, 1), (60, 0.05, 1, 1, 0, 1), (22, 0, 0, 1, 0, 1), (48, 0, 1, 1, 0, 1)),
)


def grow(rows: np.ndarray, depth: int = 8):
    """A decision tree: (feature, threshold, tree up to it, tree above it) or the share of ones in a leaf."""
    x, y = rows[:, :-1], rows[:, -1]
    if not depth or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= (low + high) / 2
            loss = sum(y[s].size * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left))
            if best is None or loss < best[0] - 1e-12:
                best = loss, f, (low + high) / 2, left
    if best is None:
        return float(y.mean())
    _, f, at, left = best
    return f, at, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    f, at, low, high = tree
    out, left = np.empty(len(x), bool), x[:, f] <= at
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


class Open(NamedTuple):
    """An open element with what holds inside it."""

    name: str
    mark: int  # how strongly it is marked as furniture, 0 to 2
    article: bool
    heading: bool
    link: int  # number of the link it stands in, 0 for none
    outermost: str  # name of the outermost open element that is surely furniture
    scopes: tuple[int, ...]  # where the innermost open element of each of SCOPES stands, -1 for none


OUTSIDE = Open("", 0, False, False, 0, "", (-1,) * len(SCOPES))


def _names(attributes: str) -> str:
    """What class, id and role say."""
    return " ".join(next(filter(None, m.groups()), "") for m in NAMED.finditer(attributes)) if attributes else ""


class Scanner:
    """Flat blocks of one page: text, words inside links, mark, article, heading."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, bool, bool]] = []
        self.pieces: list[str] = []
        self.link_words = 0
        self.links = 0  # number of the last link
        self.link = 0  # the link that is not yet ended: a new <a> ends the one before
        self.open: list[Open] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of each name stand

    def flush(self, heading: bool = False) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            inside = self.open[-1] if self.open else OUTSIDE
            self.blocks.append((text, self.link_words, inside.mark, inside.article, heading or inside.heading))
        self.pieces, self.link_words = [], 0

    def text(self, raw: str) -> None:
        if raw:
            t = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(t)
            if self.link and self.open and self.open[-1].link == self.link:
                self.link_words += len(t.split())

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        for o in self.open[k:]:
            self.places[o.name].pop()
        del self.open[k:]

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.flush()
        for scope, names in IMPLIED.get(name, ()):
            while self.open and (k := self.open[-1].scopes[scope]) >= 0 and self.open[k].name in names:
                self.cut(k)
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self.cut(len(self.open) - 1)
        if name in VOID:
            return
        _, mark, article, heading, link, outermost, scopes = self.open[-1] if self.open else OUTSIDE
        own = self._mark(name, attributes, article)
        if own < 2 and (
            name in ("article", "main") or (not mark and name in ("div", "section", "td") and ARTICLE_NAMES.search(_names(attributes)))
        ):
            mark = 0 if outermost in FURNITURE else mark  # an element that was left open does not swallow the article
            article = True
        mark = max(mark, own)
        at = len(self.open)
        if name in SCOPED:
            scopes = tuple(at if name in names else k for names, k in zip(SCOPES, scopes, strict=True))
        if name == "a":
            self.links += 1
            self.link = link = 0 if PLACE.search(attributes) and not TARGET.search(attributes) else self.links
        self.open.append(Open(name, mark, article, heading or name in HEADINGS, link, outermost or (name if mark == 2 else ""), scopes))
        self.places[name].append(at)

    @staticmethod
    def _mark(name: str, attributes: str, article: bool) -> int:
        """How strongly an element marks what it holds as furniture."""
        names = _names(attributes)
        if name in FURNITURE or (attributes and HIDDEN.search(attributes)) or (name == "article" and COMMENT.search(names)):
            return 2
        if name in ("html", "body", "main", "article", "h1"):
            return 0
        if name == "header":
            return 0 if article else 2
        if named := [n for n in names.split() if FURNITURE_NAMES.search(n)]:
            return 2 if any(map(SURE_NAME.fullmatch, named)) else 1
        return int(name not in PHRASES and bool(DOUBTFUL_NAMES.search(names)))

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if name == "a":
            self.link = 0
        elif name in HEADINGS:  # the end tag of one heading ends any other
            name = max(HEADINGS, key=lambda h: self.places[h][-1] if self.places[h] else -1)
        if self.places.get(name):
            k = self.places[name][-1]
            if name not in INLINE or k > self.open[-1].scopes[WALL]:
                self.cut(k)

    def scan(self, page: str) -> list[tuple[str, int, int, bool, bool]]:
        at, last = 0, page.rfind(">")
        while True:
            low = page.find("<", at)
            if low < 0:
                self.text(page[at:])
                break
            if low > last:  # no tag can end behind here
                self.text(page[at:])
                break
            m = MARK.match(page, low)
            if m is None:
                self.text(page[at : low + 1])
                at = low + 1
                continue
            self.text(page[at:low])
            at = m.end()
            if m[1]:
                end = page.find("-->", at)
                at = len(page) if end < 0 else end + 3
                continue
            name = (m[3] or m[6] or "").lower()
            if not name:
                continue
            if m[2] or m[5]:
                self.end(name)
            elif name in RAW:
                self.flush() if name in BLOCK else None
                closer = CLOSERS[name].search(page, at)
                at = closer.end() if closer else len(page)
            else:
                self.start(name, m[4] or m[7] or "")
        self.flush()
        return self.blocks


def features(words: np.ndarray, links: np.ndarray, hints: np.ndarray) -> np.ndarray:
    """FEATURES of the blocks of a page: words and link density of each, of those beside it, and its hints."""
    out = np.zeros((len(words), len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 6:] = words, links, hints
    out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], links[:-1], words[1:], links[1:]
    return out


def labelled(pages=PAGES) -> np.ndarray:
    """Rows of features and label of a labelled table."""
    parts = []
    for page in pages:
        rows = np.array(page, float)
        parts.append(np.column_stack([features(rows[:, 0], rows[:, 1], rows[:, 2:5]), rows[:, 5]]))
    return np.concatenate(parts)


def described(blocks: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    words = np.array([len(b[0].split()) for b in blocks], float)
    return features(words, np.minimum(np.array([b[1] for b in blocks]) / np.maximum(words, 1), 1), np.array([b[2:] for b in blocks], float))


def main_text(page: str, tree) -> str:
    blocks = Scanner().scan(page)
    if not blocks:
        return ""
    return "\n".join(b[0] for b, keep in zip(blocks, decide(tree, described(blocks)), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", examples=PAGES) -> DataFrame:
    """id, url, text, n_chars of each page."""
    tree = grow(labelled(examples))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["id", "page_url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("page_url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(extract, f"id {rows.schema['id'].dataType.simpleString()}, page_url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "page_url": url_col})


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
