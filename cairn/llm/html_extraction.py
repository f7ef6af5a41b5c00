"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, ids_of

#: Markup: comments, elements whose content isn't text, tags, declarations; the last may be cut off by the page's end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|canvas|audio|video)(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements that stay inside a line of text; all others end a block.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mfenced mstyle mspace semantics""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening sibling closes.
CLOSED_BY_LIKE = frozenset("p li dt dd tr td th option".split())
BOILERPLATE = frozenset("head title nav header footer aside form menu button dialog fieldset".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li dt dd td th option".split())
#: Parts of the names of classes, ids and roles. A name is cut at hyphens, underscores and inner capitals. It tells
#: boilerplate if no part says anything else, and may do so if its last part does, which says what the thing is (a
#: menu-review is a review).
BOILER = frozenset(
    """nav navs navbar navigation navlinks topnav sidenav subnav menu menus submenu dropdown hamburger header masthead footer sidebar sidebars aside ad ads adsbygoogle advert adverts
    advertisement advertisements advertising banner banners promo promos promotion promotions sponsor sponsors sponsored cookie cookies notice notices notification notifications consent gdpr
    alert alerts share shares sharing social socials recommend recommended recommendation recommendations breadcrumb breadcrumbs crumbs subscribe subscription newsletter newsletters popup
    popups modal widget widgets toolbar topbar login signin signup copyright disclaimer pagination contentinfo complementary related""".split()
)
READERS = frozenset("comment comments commentlist commenter commenters commentform commenttext commentbody disqus reply replies".split())
HINTS = frozenset("side foot pager skip skiplink tag tags search".split())
CONTENT_NAMES = frozenset("article content post entry story main body text".split())
NEUTRAL = CONTENT_NAMES | frozenset(
    """articles posts stories entries news topic topics site page blog web top bottom left right center global primary secondary tertiary inner outer mobile desktop sticky fixed floating
    container wrapper wrap box bar block blocks link links list lists item items button buttons icon icons slot unit area section panel group col column row form inline small large big new
    js region module component template part holder zone print media policy toggle""".split()
)
#: Names that say what a layout has or lacks, not what it is; and those of boxes around a whole layout: if they hold an
#: article, or content that is most of the page's text, their hints don't count.
STATES = frozenset("has with no is not without".split())
WRAPPERS = frozenset("wrap wrapper container layout site".split())
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
NAMED = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LINK = "a"
#: Log-odds of content that the elements around a block give, each kind once: one kind of strong boilerplate outweighs
#: all hints at content, whichever is inside the other. Those of FITTED are where fit() starts from.
EVIDENCE = {"strong": -7.0, "header": -7.0, "readers": -7.0, "named": -3.5, "weak": -1.5, "article": 3.0, "content": 1.5}
FITTED = ("named", "weak", "content")
#: Log-odds of content by a block's own text, for the features of text_features(); fit() starts from these.
WEIGHTS = np.array([-0.9, 2.0, -3.0, 0.6, -0.4, 0.3])
#: Cost of parting neighbours that share a parent, less for each step between them in the tree; of parting siblings; and
#: the share of it where one of both is boilerplate by markup, as the page parts them itself.
NEXT, STEP, SIBLING, MARKED = 1.2, 0.5, 0.8, 0.2
STRONG = frozenset({"strong", "header", "readers"})
#: The weights are fitted on so many blocks at most, of so many pages at most, taken by hashes; RIDGE holds them near WEIGHTS,
#: HINT_RIDGE those of names near EVIDENCE, as markup that labels blocks says less of pages that only have names.
SAMPLE_PAGES, SAMPLE_BLOCKS, RIDGE, HINT_RIDGE = 500, 20_000, 5.0, 50.0
SPACES = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?;:,](?:\s|$)|[。！？]")


def name_kinds(names: str) -> tuple[set[str], bool]:
    """The kinds of evidence in the names of an element, and whether it may be a box around a layout."""
    kinds: set[str] = set()
    wraps = False
    for name in names.split():
        parts = [x.lower() for x in NAME_PART.findall(name)]
        if not parts or parts[0] in STATES:
            continue
        wraps |= any(x in WRAPPERS or x.endswith(("wrap", "wrapper")) for x in parts)
        boiler, readers = [x for x in parts if x in BOILER], [x for x in parts if x in READERS]
        said = [x for x in parts if x not in BOILER and x not in READERS and x not in NEUTRAL and len(x) > 2]
        content = any(x in CONTENT_NAMES for x in parts)
        if readers and not said:
            kinds.add("readers")
        elif boiler == ["header"] and content:
            kinds.add("content")
        elif boiler and not said:
            kinds.add("header" if set(boiler) == {"header"} else "strong")
        elif boiler and parts[-1] in BOILER:
            kinds.add("named")
        elif not boiler and any(x in HINTS for x in parts) and not any(x not in HINTS and x not in NEUTRAL for x in parts):
            kinds.add("weak")
        if not boiler and not readers and content:
            kinds.add("content")
    if kinds & STRONG:
        kinds -= {"named", "weak", "content"}
    return kinds, wraps


@dataclass(eq=False)
class Element:
    """An element; two of the same look are not equal. around: the evidence of all elements from the top down to it,
    whether one is a header, and whether a heading stands in that header."""

    tag: str
    parent: Element | None
    depth: int
    kinds: frozenset[str] = frozenset()
    wraps: bool = False
    holds_article: bool = False
    holds_content: bool = False
    words: int = 0
    around: tuple[frozenset[str], bool, bool] = (frozenset(), False, False)


@dataclass(eq=False)
class Block:
    """A run of text with no block markup inside."""

    element: Element | None
    text: str
    words: int
    linked: int
    kinds: frozenset[str] = field(default=frozenset())


class Page:
    """The text blocks of a page in order, with the elements around them; in time linear in the page."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.opened: Counter = Counter()
        self.links = self.linked = 0
        self.parts: list[str] = []
        at = 0
        for m in MARKUP.finditer(page):
            if m.start() > at:
                self.add(page[at : m.start()])
            at = m.end()
            if m["tag"]:
                self.element(m["tag"].lower(), bool(m["end"]), m["attrs"])
            elif m["raw"]:
                self.close()
        if at < len(page):
            self.add(page[at:])
        self.close()
        self.weigh()

    def add(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked += len(text.split())

    def close(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(self.open[-1] if self.open else None, text, len(text.split()), self.linked))
            self.parts, self.linked = [], 0

    def pop(self, n: int) -> None:
        for x in self.open[n:]:
            self.opened[x.tag] -= 1
        del self.open[n:]

    def element(self, tag: str, end: bool, attrs: str) -> None:
        if tag in INLINE:
            self.links = max(0, self.links + (-1 if end else 1)) if tag == LINK else self.links
            return
        self.close()
        if tag in VOID:
            return
        if end:
            if self.opened[tag]:
                n = len(self.open) - 1
                while self.open[n].tag != tag:
                    n -= 1
                self.pop(n)
                self.links = 0
            return
        if tag in CLOSED_BY_LIKE and self.open and self.open[-1].tag == tag:
            self.pop(len(self.open) - 1)
        kinds, wraps = set(), False
        if attrs and tag not in ("html", "body"):
            kinds, wraps = name_kinds(" ".join(a or b or c for a, b, c in NAMED.findall(attrs)))
        wraps = tag == "form" or (wraps and tag not in BOILERPLATE)
        if tag in BOILERPLATE:
            kinds.add("header" if tag == "header" else "strong")
        if tag in CONTENT and not kinds & STRONG:
            kinds.add("article")
            self.mark("holds_article")
        if kinds & {"article", "content"} and not kinds & STRONG:
            self.mark("holds_content")
        self.opened[tag] += 1
        self.open.append(Element(tag, self.open[-1] if self.open else None, len(self.open), frozenset(kinds), wraps))
        self.elements.append(self.open[-1])

    def mark(self, what: str) -> None:
        """Marks all open elements; those around a marked one are marked already."""
        for x in reversed(self.open):
            if getattr(x, what):
                break
            setattr(x, what, True)

    def weigh(self) -> None:
        """The kinds of evidence around each block, from the outermost element down.

        A heading in an article's header is the article's. A form or a box of layout isn't boilerplate for the article
        in it, nor for content that makes up most of the page; reader comments stay what they are.
        """
        for block in self.blocks:
            if block.element:
                block.element.words += block.words
        for x in reversed(self.elements):
            if x.parent:
                x.parent.words += x.words
        total = sum(block.words for block in self.blocks)
        for x in self.elements:
            found, header, heading = x.parent.around if x.parent else (frozenset(), False, False)
            kinds = x.kinds
            if x.wraps and (x.holds_article or (x.holds_content and 2 * x.words > total)):
                kinds = kinds - {"strong", "header", "named", "weak"}
            heading |= header and x.tag in HEADINGS
            if "header" in kinds:
                header, heading = True, False
            x.around = (found | kinds - {"header"} if kinds - {"header"} - found else found, header, heading)
        for block in self.blocks:
            found, header, heading = block.element.around if block.element else (frozenset(), False, False)
            block.kinds = found | {"header"} if header and not (heading and "article" in found) else found


def text_features(block: Block) -> list[float]:
    """1, length, share of words in links, has a sentence's punctuation, stands in a list or table, is a heading."""
    tag = block.element.tag if block.element else ""
    return [1.0, min(math.log1p(block.words), 4.0) / 4.0, min(1.0, block.linked / max(1, block.words)), float(bool(SENTENCE.search(block.text))), float(tag in LISTED), float(tag in HEADINGS)]


START = np.concatenate([WEIGHTS, [EVIDENCE[k] for k in FITTED]])


def features(block: Block) -> list[float]:
    return [*text_features(block), *(float(k in block.kinds) for k in FITTED)]


def fit(features: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on labelled blocks, held near START, by Newton steps; either label weighs the same."""
    share = content.mean() if len(content) else 0.0
    if not 0 < share < 1:
        return START
    each = np.where(content > 0, 0.5 / share, 0.5 / (1 - share))
    w = START.copy()
    ridge = np.array([RIDGE] * len(WEIGHTS) + [HINT_RIDGE] * len(FITTED))
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (each * p * (1 - p))[:, None]).T @ features + np.diag(ridge)
        w = w + np.linalg.solve(hessian, features.T @ (each * (content - p)) - ridge * (w - START))
    return w


def costs(block: Block, weights: np.ndarray) -> float:
    """Log-odds of content: the capacity to the source if above 0, to the sink if below. weights: of features()."""
    marked = sum(EVIDENCE[k] for k in block.kinds if k not in FITTED)
    return marked + float(np.dot(features(block), weights))


class Network:
    """A flow network; max_flow() by shortest augmenting levels, source_side() of the least cut."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in self.out[v]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    queue.append(self.to[e])
        return level

    def max_flow(self, source: int, sink: int) -> float:
        total = 0.0
        while (level := self.levels(source))[sink] >= 0:
            tried = [0] * len(self.out)
            path: list[int] = []
            v = source
            while True:
                if v == sink:
                    pushed = min(self.room[e] for e in path)
                    total += pushed
                    for e in path:
                        self.room[e] -= pushed
                        self.room[e ^ 1] += pushed
                    path, v = [], source
                while tried[v] < len(self.out[v]):
                    e = self.out[v][tried[v]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[v] + 1:
                        path.append(e)
                        v = self.to[e]
                        break
                    tried[v] += 1
                else:
                    if v == source:
                        break
                    e = path.pop()
                    v = self.to[e ^ 1]
                    tried[v] += 1
        return total

    def source_side(self, source: int) -> list[bool]:
        return [x >= 0 for x in self.levels(source)]


def distance(a: Element | None, b: Element | None) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def label_blocks(blocks: list[Block], weights: np.ndarray = START) -> list[bool]:
    """Content or not, for each block, by a minimum cut.

    Neighbouring blocks of one parent and evidence are one node, whose capacities add up. Edges join neighbours, the
    more the nearer they are in the tree, and the nodes of one parent; so a block that its own text doesn't decide, or
    that a weak hint speaks against, goes with what is around it.
    """
    capacity: list[float] = []
    node: list[tuple[Element | None, frozenset[str]]] = []
    of: list[int] = []
    for block in blocks:
        around = block.element.parent if block.element and block.element.tag in CLOSED_BY_LIKE | HEADINGS else block.element
        if not node or node[-1][0] is not around or node[-1][1] != block.kinds:
            node.append((around, block.kinds))
            capacity.append(0.0)
        capacity[-1] += costs(block, weights)
        of.append(len(node) - 1)
    n = len(node)
    net = Network(n + 2)

    def join(a: int, b: int, cost: float) -> None:
        cost *= MARKED if bool(node[a][1] & STRONG) != bool(node[b][1] & STRONG) else 1.0
        net.edge(a, b, cost, cost)

    last: dict[int, int] = {}
    for i, c in enumerate(capacity):
        net.edge(n, i, max(c, 0.0), 0.0)
        net.edge(i, n + 1, max(-c, 0.0), 0.0)
        if i:
            join(i - 1, i, NEXT / (1.0 + STEP * distance(node[i - 1][0], node[i][0])))
        before = last.get(id(node[i][0]))
        if before is not None and before < i - 1:
            join(before, i, SIBLING)
        last[id(node[i][0])] = i
    net.max_flow(n, n + 1)
    side = net.source_side(n)
    return [side[i] for i in of]


def main_text(page: str | None, weights: np.ndarray = START) -> str:
    blocks = Page(page or "").blocks
    return " ".join(x.text for x, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def fitted_weights(pages: DataFrame, page: str = "page_id", html: str = "html") -> np.ndarray:
    """Weights of text_features() alone."""
    return fitted_costs(pages, page, html)[: len(WEIGHTS)]


def fitted_costs(pages: DataFrame, page: str = "page_id", html: str = "html") -> np.ndarray:
    """Weights of features() from blocks that markup alone labels: inside an article, or in strong boilerplate.

    The sample is bounded by SAMPLE_PAGES and SAMPLE_BLOCKS, taken in order of hashes, so it doesn't grow with the
    table; its pages are read whole, and the driver gets a few numbers for each block.
    """
    ids = pages.select(F.col(page).cast("long").alias("p")).filter("p is not null").distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PAGES)
    chosen = pages.select(F.col(page).cast("long").alias("p"), F.col(html).alias("h")).join(F.broadcast(ids), "p")
    schema = "p long, n int, x array<double>, y int"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, h in zip(batch["p"], batch["h"], strict=True):
                for n, block in enumerate(Page(h or "").blocks):
                    strong = bool(block.kinds & STRONG)
                    if strong or "article" in block.kinds:
                        rows.append((p, n, features(block), int(not strong)))
            yield pd.DataFrame(rows, columns=["p", "n", "x", "y"]).astype({"p": "int64", "n": "int32", "y": "int32"})

    rows = chosen.mapInPandas(scan, schema).orderBy(F.xxhash64("p", "n"), "p", "n").limit(SAMPLE_BLOCKS).select("x", "y").collect()
    if not rows:
        return START
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def extract_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages, over the whole html; no shuffle.

    Null and empty pages, and pages of boilerplate alone, give an empty text; repeated rows are treated alike; an empty
    table gives no rows; other columns are not read. What is broadcast is the weights of fitted_costs().
    """
    weights = fitted_costs(pages, page, html)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch["h"]]
            yield pd.DataFrame({"page_id": ids_of(batch), "url": batch["u"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select(*id_columns(F.col(page)), F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(scan, "page_id long, url string, text string, n_chars long")
