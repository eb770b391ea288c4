"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier's costs for calling a block content or boilerplate become its
capacities to the two terminals; blocks next to each other and blocks near in the DOM are tied by smoothness edges. The minimum cut is the
cheapest labelling, the blocks on the content side are the text. Blocks whose own costs outweigh all their
edges are decided beforehand, which leaves the cut as it is and most pages without a flow to compute.

Pages are independent rows; a task holds one batch of them.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role, words in class and id names.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|title"
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside form button select option textarea label fieldset menu dialog head".split())
_MAIN = frozenset(("article", "main"))
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager"
    " sidebar widget widgets related recommended share sharing social toolbar topbar masthead footer copyright comment comments"
    " disqus reply replies respond discussion skip".split()
)
_GOOD_NAMES = frozenset("article content main post story entry body text".split())

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_LAYOUT = re.compile(r"(?:has|no|with|without|hide|show)[-_]")
_SPACE = re.compile(r"\s+")
SURE = 1_000.0


class _Open:
    """An element: its place in the tree, whether it is banned by what it is or by a name, whether it is favoured."""

    __slots__ = ("tag", "parent", "depth", "banned", "named", "favoured")

    def __init__(self, tag: str, parent: _Open | None, banned: bool, named: bool, favoured: bool):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.banned, self.named, self.favoured = banned, named, favoured


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    tag: str
    node: _Open  # the element it stands in
    banned: bool
    favoured: bool


def blocks_of(html: str) -> list[Block]:
    out: list[Block] = []
    stack = [_Open("", None, False, False, False)]
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.tag, top, top.banned or top.named, top.favoured))
        parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], until: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until or stack[i].tag not in tags and stack[i].tag in _BLOCKS_CLOSE_P:
                return

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            linked += len(piece.strip()) if links else 0
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        ends = m[2] == "/"
        if tag in _INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else links + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        links = 0
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES:
            close(_CLOSES[tag], frozenset(("ul", "ol", "table", "dl")))
        elif tag in _BLOCKS_CLOSE_P:
            close(("p",))
        top = stack[-1]
        names = [n for found in _NAMES.finditer(m[4]) for n in "".join(g or "" for g in found.groups()).lower().split()]
        # "has-sidebar" and the like describe what a wrapper has elsewhere
        words = {w for n in names if not _LAYOUT.match(n) for w in _WORD.findall(n)}
        favoured = top.favoured or tag in _MAIN or bool(words & _GOOD_NAMES)
        site_header = (tag == "header" or "header" in words) and not top.favoured
        banned = top.banned or tag in _NEVER or site_header
        # a page has one <main>: it is content whatever the wrappers around it are called
        named = tag != "main" and (top.named or bool(words & _BAD_NAMES) and tag not in ("html", "body", "article"))
        stack.append(_Open(tag, top, banned, named, favoured))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out


def costs(block: Block) -> tuple[float, float]:
    """(capacity from the content terminal, capacity to the boilerplate terminal)."""
    if block.banned:
        return 0.0, SURE
    size = len(block.text)
    content = 0.5 + min(3.0, size / 80)
    boilerplate = 0.5
    if block.favoured:
        content += 4.0
    prose = block.tag in _PROSE
    if prose:
        content += 0.5
    boilerplate += 4.0 * (block.linked / size if size else 0.0)
    if size < 25 and not (block.favoured or prose):
        boilerplate += 1.0
    if block.text[0] in "©|»›" or not any(c.isalnum() for c in block.text):
        boilerplate += 1.5
    return content, boilerplate


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and the nearest earlier block under the same parent; closer in the DOM ties stronger."""

    def tie(a: Block, b: Block) -> float:
        x, y = a.node, b.node
        deepest = max(x.depth, y.depth)
        while x is not y:  # up to the common element; page order makes the way short on the whole
            if x.depth >= y.depth:
                x = x.parent
            else:
                y = y.parent
        return 1.0 / (1 + deepest - x.depth)

    out, last_under = [], {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, tie(blocks[i - 1], block)))
        parent = id(block.node.parent)
        before = last_under.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, tie(blocks[before], block)))
        last_under[parent] = i
    return out


def minimum_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for each node on the content side of a minimum cut; of equal cuts, the one with least content beside sure nodes."""
    n = len(content)
    c, b = list(content), list(boilerplate)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node whose own costs outweigh its edges is on that side in a minimum cut
        i = todo.popleft()
        if side[i] is not None:
            continue
        pull = sum(near[i].values())
        if c[i] - b[i] > pull or b[i] - c[i] >= pull:
            side[i] = c[i] - b[i] > pull
            for j, w in near[i].items():
                (c if side[i] else b)[j] += w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    open_nodes = [i for i in range(n) if side[i] is None]
    if open_nodes:
        reached = _source_side(open_nodes, c, b, near)
        for i in open_nodes:
            side[i] = i in reached
    return [bool(s) for s in side]


def _source_side(nodes: list[int], c: list[float], b: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow by shortest augmenting paths; the nodes still reachable from the content terminal."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        low = min(c[i], b[i])  # flows straight through
        room[source][i], room[i][source] = c[i] - low, 0.0
        room[i][sink], room[sink][i] = b[i] - low, 0.0
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            i = queue.popleft()
            for j, left in room[i].items():
                if left > 1e-9 and j not in parent:
                    parent[j] = i
                    queue.append(j)
        if sink not in parent:
            return set(parent)
        path, j = [], sink
        while j != source:
            path.append((parent[j], j))
            j = parent[j]
        flow = min(room[i][j] for i, j in path)
        for i, j in path:
            room[i][j] -= flow
            room[j][i] += flow


def main_text(html: str) -> str:
    """Content blocks in page order, joined by a space."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    priced = [costs(block) for block in blocks]
    chosen = minimum_cut([p[0] for p in priced], [p[1] for p in priced], edges_of(blocks))
    return " ".join(block.text for block, keep in zip(blocks, chosen, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars.

    Null and empty html give an empty text. Rows that repeat an id are read one by one. An empty table gives an empty
    table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "") for html in batch.column(2)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("id", "url")]
    found = narrow.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
