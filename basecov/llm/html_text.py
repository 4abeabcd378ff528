"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. Two costs stand against each other: a classifier's cost of calling a block content or
boilerplate (capacities from and to the terminals), and a cost for every pair of neighbouring blocks that get different
labels (edges between adjacent blocks, and between blocks of one parent, weaker the further apart they are in the tree).
The minimum cut, found by maximum flow, is the cheapest labelling.

What a page names as boilerplate (navigation, headers, footers, asides, forms, adverts, notices, readers' comments: element
names, and parts of the words in classes, ids and roles) has no finite cost of being content: it and all that it holds is
tied to that terminal, and what is left is cut. There the classifier has two parts. A container that calls itself
content gives a fixed cost of the size of the edges. How a block reads (length, links, punctuation, ..) gives a learned
one: a logistic regression fitted on a bounded sample of the given pages, whose named blocks serve as labels and whose
features know nothing of containers. So the flow decides between what a container says, how a block reads, and what
stands next to it.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.llm.frames import mapped, with_batch_columns
from basecov.llm.toxicity import fit
from basecov.llm.words import cuts, text_buffers

SAMPLE_PAGES = 2_000
CONTENT_COST, LEARNED_LIMIT = 1.5, 2.5
ADJACENT, SIBLING = 0.6, 0.3
#: Of a table that shows only one label: blocks of which nothing is known are content.
UNKNOWN_BIAS = 0.5

#: Element names and words in classes, ids and roles. Fixed values.
BOILERPLATE_ELEMENTS = frozenset("nav footer aside form menu button select dialog fieldset label".split())
CONTENT_ELEMENTS = frozenset("article main".split())
UNSEEN_ELEMENTS = frozenset("script style head noscript template iframe svg math object canvas audio video textarea title".split())
BLOCK_ELEMENTS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_ELEMENTS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of the second set begins.
IMPLIED_ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul dd dt td th tr".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Where the search for an element with an implied end stops.
SCOPES = frozenset("article aside body div footer header html main nav ol section table td th ul dl form".split())
#: Elements whose articles are not the page's own either.
CLOSED_ELEMENTS = frozenset("nav footer aside menu dialog select button".split())
#: Parts of words (between anything but letters) that name boilerplate, and beginnings of such parts.
BOILERPLATE_PARTS = frozenset(
    "ad ads adbox banner breadcrumb breadcrumbs consent contentinfo cookie cookies copyright disclaimer footer gdpr header login masthead menu metadata modal nav navbar navigation newsletter notice notices overlay pager pagination popup related respond search share sharing sidebar signup siteheader sitefooter skip social subscribe tags teaser toolbar widget".split()
)
BOILERPLATE_BEGINNINGS = ("advert", "promo", "sponsor")
#: Parts that name readers' comments.
COMMENT_PARTS = frozenset("comment comments commentlist commentbox usercomments disqus replies reply".split())
#: Parts that say how a page is laid out or what is allowed on it, not what an element holds.
STATE_PARTS = frozenset("no not has with without is are can show shown hide open opened close closed enabled disabled allow allowed on off free fixed sticky layout left right top bottom count".split())
CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|article-?body|content|entry|entry-?content|main|post|post-?content|story|story-?body|text)(?:$|[^a-z])")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_ENDS = {e: re.compile(rf"</{e}(?=[\s/>]|\Z)", re.I) for e in UNSEEN_ELEMENTS}


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # numbers of the open elements, outermost first
    says: int  # 1: content, 0: nothing, below 0: named boilerplate
    element: str
    linked: int  # characters in links


#: What an element says: its text is content; it is boilerplate, but for an article inside; it is, with all inside.
CONTENT, BOILERPLATE, CLOSED = 1, -1, -2


def _named(words: str) -> int | None:
    """What the words of classes, ids and roles name, word by word."""
    found = None
    for word in words.split():
        parts = re.findall("[a-z]+", word)
        if STATE_PARTS.isdisjoint(parts):
            if not COMMENT_PARTS.isdisjoint(parts):
                return CLOSED
            if not BOILERPLATE_PARTS.isdisjoint(parts) or any(p.startswith(BOILERPLATE_BEGINNINGS) for p in parts):
                found = BOILERPLATE
    return found


def says(name: str, attributes: str, inside_content: bool) -> int | None:
    """What an element tells about its text, None if nothing."""
    own = None
    if name in BOILERPLATE_ELEMENTS or name == "header" and not inside_content:
        own = CLOSED if name in CLOSED_ELEMENTS else BOILERPLATE
    words = ""
    if attributes:
        found = []
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            if key.lower() == "hidden" or (key.lower() == "aria-hidden" and (a or b or c) == "true"):
                return CLOSED
            found.append((a or b or c).lower())
        words = " ".join(found)
    if words and name not in ("body", "html"):
        named = _named(words)
        if named == CLOSED or named and own is None and name not in CONTENT_ELEMENTS:
            return named
    if own is not None:
        return own
    return CONTENT if name in CONTENT_ELEMENTS or words and CONTENT_WORDS.search(words) else None


@dataclass
class _Reader:
    """One pass over the tags of a page."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int, int]] = field(default_factory=list)  # element, number, what it says
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    count: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                element = next((e for e, _, _ in reversed(self.stack) if e in BLOCK_ELEMENTS), "")
                self.blocks.append(Block(text, tuple(n for e, n, _ in self.stack if e in BLOCK_ELEMENTS), self.stack[-1][2] if self.stack else 0, element, self.linked))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        self.links -= sum(e == "a" for e, _, _ in self.stack[to:])
        del self.stack[to:]

    def begin(self, name: str, attributes: str) -> None:
        if name in BLOCK_ELEMENTS:
            self.flush()
            for at in range(len(self.stack) - 1, -1, -1):
                open_name = self.stack[at][0]
                if name in IMPLIED_ENDS.get(open_name, ()):
                    self.pop(at)
                    break
                if open_name in SCOPES:
                    break
        elif name == "br":
            self.parts.append(" ")
        if name in VOID_ELEMENTS:
            return
        above = self.stack[-1][2] if self.stack else 0
        own = says(name, attributes, any(e in CONTENT_ELEMENTS for e, _, _ in self.stack))
        self.count += 1
        # What boilerplate holds is boilerplate, unless it is an article in a container that may hold a page's own one.
        if above == CLOSED or above == BOILERPLATE and own != CLOSED and not (own == CONTENT and name in CONTENT_ELEMENTS):
            own = above
        self.stack.append((name, self.count, above if own is None else own))
        self.links += name == "a"

    def end(self, name: str) -> None:
        if name in BLOCK_ELEMENTS:
            self.flush()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                self.pop(at)
                return
            if name not in BLOCK_ELEMENTS and self.stack[at][0] in BLOCK_ELEMENTS:
                return


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in page order, without scripts, styles, heads and comments."""
    reader, at = _Reader(), 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            reader.text(page[at:])
            break
        reader.text(page[at : tag.start()])
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name = name.lower()
        if tag[1] or tag[4]:
            reader.end(name)
        elif name in UNSEEN_ELEMENTS:
            attributes = tag[3] or tag[6] or ""
            if name == "head":
                # A head without its end goes on to the body.
                end = _ENDS["head"].search(page, at) or re.compile(r"(?=<body[\s>])", re.I).search(page, at)
            else:
                end = _ENDS[name].search(page, at)
            if name in BLOCK_ELEMENTS:
                reader.flush()
            if not (attributes.endswith("/") and name in ("svg", "math")):
                at = len(page) if end is None else end.end()
                close = page.find(">", at) if end is not None and end.end() > end.start() else at - 1
                at = len(page) if close < 0 else close + 1
        else:
            reader.begin(name, tag[3] or tag[6] or "")
    reader.flush()
    return reader.blocks


def features(block: Block) -> list[int]:
    """Numbers of the yes-or-no features a block has; see ``N_FEATURES``."""
    words = block.text.count(" ") + 1
    share = block.linked / max(1, len(block.text))
    out = [min(5, words.bit_length() - 1), 6 + (0 if share < 0.1 else 1 if share < 0.5 else 2)]
    out += [9] if block.text[-1] in ".!?…:\"”»" else [10]
    out += [11] if block.element in ("h1", "h2", "h3", "h4", "h5", "h6") else []
    out += [12] if re.search(r"[©®]|\ball rights\b|copyright", block.text, re.I) else []
    return out


N_FEATURES = 13


def min_cut(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels with the least cost: node i pays its gain (positive) for False or its loss (negative) for True, and an edge
    pays its weight if its ends differ. Nodes whose gain outweighs all their edges are settled first; the rest is cut."""
    n = len(gain)
    weight = [0.0] * n
    for (i, j), c in edges.items():
        weight[i] += c
        weight[j] += c
    label: list[bool | None] = [g > 0 if abs(g) > w else None for g, w in zip(gain, weight)]
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    number = {node: k for k, node in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    terminal = [gain[i] for i in rest]
    pairs = []
    for (i, j), c in edges.items():
        if label[i] is None and label[j] is None:
            pairs.append((number[i], number[j], c, c))
        elif label[i] is None:
            terminal[number[i]] += c if label[j] else -c
        elif label[j] is None:
            terminal[number[j]] += c if label[i] else -c
    pairs += [(source, k, g, 0.0) if g > 0 else (k, sink, -g, 0.0) for k, g in enumerate(terminal) if g]
    for k, side in enumerate(_source_side(len(rest) + 2, source, sink, pairs)[: len(rest)]):
        label[rest[k]] = side
    return label


def _source_side(n: int, source: int, sink: int, pairs: list[tuple[int, int, float, float]]) -> list[bool]:
    """Nodes that still reach from the source after a maximum flow (blocking flows along shortest paths)."""
    to, room, out = [], [], [[] for _ in range(n)]
    for a, b, forth, back in pairs:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)
    while True:
        level, queue = [-1] * n, deque([source])
        level[source] = 0
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        tried, path, u = [0] * n, [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, u = [], source
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    path.append(e)
                    u = to[e]
                    break
                tried[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                tried[u] += 1


def closeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """1 for blocks of one element, less with each element between them and the one they share."""
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return 2.0 ** -min(10, max(len(a), len(b)) - shared)


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = 2 * ADJACENT * closeness(blocks[i - 1].path, block.path)
        parent = block.path[:-1]
        before = last.get(parent)
        if before is not None:
            edges[before, i] = edges.get((before, i), 0.0) + SIBLING
        last[parent] = i
    return edges


def undecided(page: str, weights: np.ndarray, bias: float) -> tuple[list[Block], list[float], dict[tuple[int, int], float]]:
    """The blocks that nothing names as boilerplate, what they gain by being content, and the edges between them."""
    blocks = [b for b in blocks_of(page) if b.says >= 0]
    learned = [float(np.clip(weights[features(b)].sum() + bias, -LEARNED_LIMIT, LEARNED_LIMIT)) for b in blocks]
    return blocks, [CONTENT_COST * b.says + z for b, z in zip(blocks, learned)], smoothness(blocks)


def flow_counts(page: str, weights: np.ndarray, bias: float) -> tuple[int, int, int]:
    """Blocks of a page that are not named boilerplate, those whose edges outweigh their own gain, so that the flow
    labels them, and those that the cut labels against their own gain."""
    blocks, gain, edges = undecided(page, weights, bias)
    weight = [0.0] * len(blocks)
    for (i, j), c in edges.items():
        weight[i] += c
        weight[j] += c
    return len(blocks), sum(abs(g) <= w for g, w in zip(gain, weight)), sum((g > 0) != x for g, x in zip(gain, min_cut(gain, edges)))


def main_text(page: str, weights: np.ndarray, bias: float) -> str:
    """The content blocks of a page, one per line."""
    blocks, gain, edges = undecided(page, weights, bias)
    return "\n".join(b.text for b, content in zip(blocks, min_cut(gain, edges)) if content)


def _pages(column: pa.Array):
    data, offsets = text_buffers(column)
    for low, high in cuts(offsets):
        part = data[offsets[low] : offsets[high]].tobytes()
        at = (offsets[low : high + 1] - offsets[low]).tolist()
        yield low, [part[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def learn(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> tuple[np.ndarray, float]:
    """Weights and bias of the learned part.

    The sample is the ``sample_pages`` pages with the smallest hashes of their ids; identical blocks are counted. Only
    counts per combination of features and label come to the driver, whose number does not depend on the pages. If the
    sample does not show both labels, nothing is learned, and blocks outside telling containers count as content.
    """
    chosen = pages.select(F.col(f"`{page_id}`").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(sample_pages).distinct()
    sample = pages.join(F.broadcast(chosen), F.col(f"`{page_id}`") == F.col("__id")).select(F.col(f"`{html}`").alias("html"))

    def compute(batch):
        for _, texts in _pages(batch.column(0)):
            found = [(",".join(map(str, features(b))), b.says) for t in texts for b in blocks_of(t) if b.says]
            yield [pa.array([f for f, _ in found], pa.string()), pa.array([s for _, s in found], pa.int32())]

    counted = mapped(sample, [("html", "string")], [("features", "string"), ("says", "int")], compute).groupBy("features", "says").count().collect()
    if len({r["says"] for r in counted}) < 2:
        return np.zeros(N_FEATURES), UNKNOWN_BIAS
    # Large counts are scaled down, so that the fit has at most a few thousand rows.
    scale = max(1.0, sum(r["count"] for r in counted) / 5000)
    rows = [(np.array(list(map(int, r["features"].split(",")))), r["says"]) for r in sorted(counted) for _ in range(max(1, round(r["count"] / scale)))]
    return fit([f for f, _ in rows], [None] * len(rows), np.array([s > 0 for _, s in rows]), N_FEATURES, ridge=1.0)


def extract(pages: DataFrame, weights: np.ndarray, bias: float, *, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of every whole page, and ``n_chars``, its code points.

    Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed in page
    order. A missing or empty page, and one without content, has the text "". Broken markup is read as browsers do where
    that matters for blocks: paragraphs and items may lack their ends, unknown ends are skipped, an unfinished comment or
    script reaches to the end. Columns with the names of the new ones are replaced, all others are kept.
    """

    def compute(column):
        for _, texts in _pages(column):
            found = [main_text(t, weights, bias) for t in texts]
            yield [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return with_batch_columns(pages, html, [("text", "string"), ("n_chars", "bigint")], compute)
