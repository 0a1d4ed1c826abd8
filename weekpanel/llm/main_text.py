"""Operator 7: the main text of a page, by a minimum cut between content and boilerplate.

A page is cut into blocks of text at its block-level tags. A classifier gives each block the cost of either label:
these are the capacities of its edges to the two terminals. Edges between neighbouring blocks, and between successive
blocks of one parent, cost the more the closer the blocks are in the document tree when their labels differ. The
maximum flow separates the blocks into content and boilerplate at the least cost; the content's text is joined.

The classifier is a logistic regression over what a block is (its tag, length, links, punctuation) and where it is
(names of the elements around it and words of their class, id and role). It is fitted on the blocks of at most
``SAMPLE`` pages (the first by a hash of page_id, a parameter) that stand in elements whose name says what they hold,
and drawn towards fixed weights, which also serve alone where no page has such elements.

Pages are read once, each is settled in the task that reads it, and nothing is shuffled.

Defined results: null and empty html, and pages without content, give the empty text; broken markup is read as far as
it goes; repeated rows are all returned; an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
STEPS = 20

# -- pages into blocks ------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style textarea title noscript iframe template xmp plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img".split()
)
#: Start tags that end an open element of the same group, up to an element that holds the group.
_ENDS = {
    "p": ({"p"}, frozenset("article aside blockquote body button div footer form header html li main nav section td th".split())),
    "li": ({"li"}, frozenset(("ul", "ol", "menu"))),
    "dt": ({"dt", "dd"}, frozenset(("dl",))),
    "dd": ({"dt", "dd"}, frozenset(("dl",))),
    "tr": ({"tr", "td", "th"}, frozenset(("table",))),
    "td": ({"td", "th"}, frozenset(("tr", "table"))),
    "th": ({"td", "th"}, frozenset(("tr", "table"))),
    "option": ({"option"}, frozenset(("select",))),
}
#: Block-level start tags end an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu"
    " nav ol pre section table ul".split()
)

CONTENT = ("article", "main")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "head")
HINTS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb"
    " breadcrumbs footer header masthead cookie cookies consent notice popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended comment comments disqus reply replies respond"
    " pagination pager toolbar widget copyright disclaimer skip".split()
)
GOOD = frozenset("article content main post entry story body text".split())


@dataclass
class Element:
    name: str
    parent: int
    depth: int
    content: bool
    boilerplate: bool
    hinted: bool
    good: bool
    hidden: bool


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    element: int


def _element(name: str, attributes: str, parent: int, around: Element) -> Element:
    hinted = good = hidden = False
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                words = set(_WORD.findall(value))
                hinted |= bool(words & HINTS)
                good |= bool(words & GOOD)
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    # A header inside an article is the article's own.
    boilerplate = name in BOILERPLATE and not (name == "header" and around.content)
    return Element(
        name,
        parent,
        around.depth + 1,
        around.content or name in CONTENT,
        around.boilerplate or boilerplate,
        around.hinted or (hinted and name not in ("body", "html") and name not in CONTENT),
        good or (around.good and not hinted),
        around.hidden or hidden,
    )


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks of text of a page in its order, and its elements."""
    elements = [Element("", -1, 0, False, False, False, False, False)]
    stack, blocks = [0], []
    pieces: list[str] = []
    linked = links = 0
    owner = 0

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, min(linked, len(text)), owner))
            pieces = []
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if not text:
            return
        if not pieces:
            k = len(stack) - 1
            while k and elements[stack[k]].name in INLINE:
                k -= 1
            owner = stack[k]
        pieces.append(text)
        if links:
            linked += len(text)

    def close(names: set[str], limits: frozenset[str]) -> None:
        nonlocal links
        for k in range(len(stack) - 1, 0, -1):
            name = elements[stack[k]].name
            if name in names:
                links -= sum(elements[e].name == "a" for e in stack[k:])
                del stack[k:]
                return
            if name in limits:
                return

    at, raw = 0, None
    for match in _TOKEN.finditer(page):
        if match.start() < at:
            continue
        add(page[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if name is None:
            if match[0].startswith("<![CDATA["):
                add(html.escape(match[0][9:-3]))
            continue
        name, ending = name.lower(), bool(match[1] or match[4])
        if name not in INLINE:
            flush()
        if ending:
            close({name}, frozenset(("table",)) if name not in ("table", "body", "html") else frozenset())
            continue
        if name in RAW:
            raw = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
            continue
        if name in VOID:
            continue
        if name in _ENDS:
            close(*_ENDS[name])
        elif name in _ENDS_P:
            close(*_ENDS["p"])
        attributes = match[3] if match[2] else match[6]
        elements.append(_element(name, attributes or "", stack[-1], elements[stack[-1]]))
        if not (attributes or "").rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(len(elements) - 1)
            links += name == "a"
    add(page[at:])
    flush()
    return blocks, elements


# -- costs ------------------------------------------------------------------------------------------------------------

NAMES = (
    "constant", "content", "boilerplate", "hinted", "good", "hidden", "link_share", "log_length", "short", "stops",
    "paragraph", "heading", "item",
)
#: The weights towards which the fit is drawn.
PRIOR = np.array([-1.0, 3.5, -6.0, -5.0, 1.0, -8.0, -3.0, 0.4, -0.5, 0.5, 0.8, 0.3, -0.3])


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    out = np.zeros((len(blocks), len(NAMES)))
    for k, block in enumerate(blocks):
        e = elements[block.element]
        n = len(block.text)
        stops = block.text.count(".") + block.text.count("?") + block.text.count("!")
        out[k] = (
            1, e.content, e.boilerplate, e.hinted, e.good, e.hidden, block.linked / n, np.log1p(n) / 2, n < 40,
            min(stops, 5) / 5, e.name == "p", len(e.name) == 2 and e.name[0] == "h" and e.name[1].isdigit(),
            e.name == "li",
        )
    return out


def _told(x: np.ndarray) -> np.ndarray:
    """1 for blocks that stand in an element for content alone, 0 for boilerplate alone, else -1."""
    content, boilerplate, hinted = x[:, 1] > 0, x[:, 2] > 0, x[:, 3] > 0
    return np.where(content & ~boilerplate & ~hinted, 1, np.where(~content & (boilerplate | hinted), 0, -1))


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (rounded) features of told blocks and their number: few rows for many blocks."""
    for batch in batches:
        counted: dict[tuple, int] = {}
        for page in batch.column("html").to_pylist():
            x = np.round(features(*blocks_of(page or "")), 1)
            for row, y in zip(x.tolist(), _told(x).tolist(), strict=True):
                if y >= 0:
                    counted[(y, *row)] = counted.get((y, *row), 0) + 1
        rows = list(counted.items())
        columns = [
            pa.array([list(k[1:]) for k, _ in rows], pa.list_(pa.float64())),
            pa.array([k[0] for k, _ in rows], pa.int64()),
            pa.array([n for _, n in rows], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["x", "y", "n"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier, from at most ``sample`` pages."""
    place = F.xxhash64("page_id").alias("_h")
    chosen = pages.select(place).distinct().orderBy("_h").limit(sample)  # numbers alone: no page goes through one task
    first = pages.select("html", place).join(F.broadcast(chosen), "_h", "left_semi").select("html")
    rows = first.mapInArrow(_training, "x array<double>, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    rows = rows.collect()  # blocks of the sample, equal ones counted
    weights = PRIOR.copy()
    if not rows:
        return weights
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], dtype=np.float64)
    w = np.array([r["n"] for r in rows], dtype=np.float64)
    w *= 200 / w.sum()  # a prior of a definite strength, however many blocks there are
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (w * (y - p)) - (weights - PRIOR)
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return weights


# -- the cut ----------------------------------------------------------------------------------------------------------

NEXT, SIBLING, LIMIT = 1.0, 0.5, 8.0
#: Flow below this is none.
LEAST = 1e-9


def edges_of(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours the weaker the more steps lie between their elements, and between a block
    and the next one of the same parent that is not its neighbour."""
    out, last = [], {}
    for k, block in enumerate(blocks):
        if k:
            a, b, steps = blocks[k - 1].element, block.element, 0
            while a != b and steps < 12:
                if elements[a].depth >= elements[b].depth:
                    a = elements[a].parent
                else:
                    b = elements[b].parent
                steps += 1
            out.append((k - 1, k, NEXT * 0.5**steps))
        parent = elements[block.element].parent
        if parent in last and last[parent] < k - 1:
            out.append((last[parent], k, SIBLING))
        last[parent] = k
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of the minimum cut.

    ``gain`` is a node's capacity from the source less that to the sink (what both have in common flows through at
    once); edges carry their capacity either way. Nodes are levelled by their distance from a source with something left,
    and flow is sent from level to level, no edge being looked at twice in vain, until no sink can be reached.
    """
    n = len(gain)
    arcs: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, c in edges:  # an arc and the one back are numbered 2k and 2k + 1
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head += [b, a]
        room += [c, c]
    left = list(gain)
    while True:
        sources = [k for k in range(n) if left[k] > LEAST]
        level, reached = _levels(sources, left, arcs, head, room)
        if not reached:
            return [k >= 0 for k in level]
        tried = [0] * n
        for source in sources:
            while left[source] > LEAST:
                path = _path(source, level, tried, left, arcs, head, room)
                if path is None:
                    break
                sink = head[path[-1]]
                flow = min(left[source], -left[sink], min(room[e] for e in path))
                left[source] -= flow
                left[sink] += flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def _levels(sources: list[int], left, arcs, head, room) -> tuple[list[int], bool]:
    """Distances from the sources, up to that of the first sink, and whether there is one; -1 for what is beyond."""
    level = [-1] * len(left)
    for k in sources:
        level[k] = 0
    layer, depth, reached = sources, 0, False
    while layer and not reached:
        depth, after = depth + 1, []
        for a in layer:
            for e in arcs[a]:
                b = head[e]
                if level[b] < 0 and room[e] > LEAST:
                    level[b] = depth
                    after.append(b)
                    reached = reached or left[b] < -LEAST
        layer = after
    return level, reached


def _path(source: int, level, tried, left, arcs, head, room) -> list[int] | None:
    """Arcs from the source to a sink, each to the next level; ``tried`` counts the arcs of a node that lead nowhere."""
    path: list[int] = []
    a = source
    while left[a] >= -LEAST:
        for k in range(tried[a], len(arcs[a])):
            e = arcs[a][k]
            if room[e] > LEAST and level[head[e]] == level[a] + 1:
                tried[a] = k
                path.append(e)
                a = head[e]
                break
        else:
            tried[a] = len(arcs[a])
            if not path:
                return None
            a = head[path.pop() ^ 1]
            tried[a] += 1
    return path


def main_text(page: str, weights: np.ndarray) -> str:
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    # log(p / (1 - p)) is the difference of the costs -log(1 - p) and -log(p) of the two labels.
    gain = np.clip(features(blocks, elements) @ weights, -LIMIT, LIMIT)
    if (gain > 0).all() or (gain <= 0).all():
        content = (gain > 0).tolist()
    else:
        content = minimum_cut(gain.tolist(), edges_of(blocks, elements))
    return " ".join(b.text for b, kept in zip(blocks, content, strict=True) if kept)


def _extract(batches: Iterable[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        columns.append(pa.array([len(t) for t in texts], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, sample)
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(lambda it: _extract(it, weights), "page_id long, url string, text string, n_chars long")
