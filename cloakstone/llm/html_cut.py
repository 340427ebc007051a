"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier over each block (its words, links,
punctuation, and the elements it stands in) gives two terminal capacities: what it costs to call
the block content, and what it costs to call it boilerplate.  Neighbouring blocks, and consecutive
blocks of one section of the DOM, are joined by smoothness edges, so a short paragraph inside an article
stays with it.  A maximum flow separates the two labels at least cost; the source side is content.

A ``header`` outside an article, and elements with the role of a menu, banner, side or foot of the page,
speak against their blocks like the elements of those names.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one ``\\n`` in page order.

Cases: null or empty html, or a page without content, gives an empty text.  Unclosed and
stray tags are tolerated: a block-level tag ends the open block, an end tag closes up to its element
if that is open.  Scripts, styles, head and comments never become blocks, also when left open.
Repeated pages give repeated rows.  One row is worked off at a time; nothing is shared between rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg select".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset(
    "article aside body div dialog fieldset footer form header main menu nav ol section table td ul dl".split()
)
NEVER = frozenset("head nav footer aside form menu button dialog".split())
MAIN = frozenset("article main".split())
# Landmark roles of ARIA.
NEVER_ROLES = frozenset("banner complementary contentinfo navigation search form menu menubar toolbar dialog alertdialog".split())
MAIN_ROLES = frozenset("article main".split())
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|newsletter|"
    r"subscri\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side|widget\w*|related|recommend\w*|share|social|"
    r"comment\w*|repl(?:y|ies)|disqus|footer|foot|header|masthead|toolbar|pager|pagination|login|signup|search|"
    r"copyright|legal|alert)(?:$|[\s_-])",
    re.I,
)
MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article|post|entry|story|content|body|text|main)(?:$|[\s_-])", re.I
)
# Weights of the block classifier; a positive sum speaks for content.
WEIGHTS = {
    "bias": -0.6, "in_main": 3.0, "in_never": -9.0, "side_name": -8.0, "main_name": 1.5, "heading": 0.8,
    "paragraph": 1.0, "list_item": -0.8, "long": 2.0, "link_share": -4.0, "sentences": 1.0,
}
NEIGHBOUR, SAME_SECTION = 0.4, 2.5
TINY = 1e-9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Element:
    __slots__ = ("name", "section", "never", "main", "side", "named", "link")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        named = [(kind.lower(), a or b or c) for kind, a, b, c in NAMES.findall(attributes)] if attributes else []
        words, roles = " ".join(value for _, value in named), {r for kind, value in named if kind == "role" for r in value.lower().split()}
        inside = parent is not None and parent.main
        own_side = bool(words) and bool(SIDE_WORDS.search(words)) and name not in MAIN and name not in ("body", "html")
        own_main = bool(words) and bool(MAIN_WORDS.search(words)) and not own_side
        self.name = name
        # The head of an article belongs to it, that of a page does not.
        out = name in NEVER or (name == "header" and not inside) or not NEVER_ROLES.isdisjoint(roles)
        self.never = out or (parent is not None and parent.never)
        self.side = own_side or (parent is not None and parent.side)
        self.main = name in MAIN or inside or not MAIN_ROLES.isdisjoint(roles)
        self.named = own_main or (parent is not None and parent.named)
        self.link = name == "a" or (parent is not None and parent.link)
        self.section = self if name in SECTIONS or parent is None else parent.section


class Block:
    __slots__ = ("parts", "link_chars", "element", "text")

    def __init__(self, element: Element):
        self.parts, self.link_chars, self.element, self.text = [], 0, element, ""


class Tree:
    """The open elements while a page is read."""

    def __init__(self):
        self.stack = [Element("html", "", None)]
        self.open: Counter = Counter()

    def top(self) -> Element:
        return self.stack[-1]

    def start(self, name: str, attributes: str) -> None:
        if name in ("body", "article", "main"):  # these end a head or menu that was left open
            for left_open in ("head", "nav", "menu"):
                self.end(left_open)
        if name in ("p", "li", "dt", "dd", "tr", "td", "th"):  # these end an open one of their section
            for element in reversed(self.stack):
                if element.name == name:
                    self.end(name)
                    break
                if element.name in SECTIONS:
                    break
        self.stack.append(Element(name, attributes, self.top()))
        self.open[name] += 1

    def end(self, name: str) -> None:
        """Close up to the innermost open element of that name, if there is one."""
        while self.open[name]:
            closed = self.stack.pop()
            self.open[closed.name] -= 1
            if closed.name == name:
                return


def blocks_of(page: str) -> list[Block]:
    """Blocks of visible text in page order; those without text are left out."""
    tree, found = Tree(), []
    block: Block | None = None
    at, size = 0, len(page)
    while at < size:
        match = TOKEN.search(page, at)
        chunk = page[at : match.start()] if match else page[at:]
        at = match.end() if match else size
        name = match.group(2).lower() if match and match.group(2) else ""
        if name == "br":
            chunk += " "
        if chunk and (block or not chunk.isspace()):
            if block is None:
                block = Block(tree.top())
                found.append(block)
            block.parts.append(chunk)
            block.link_chars += len(chunk.strip()) if tree.top().link else 0
        if not name:
            continue
        if name in BLOCKS:
            block = None
        if match.group(1):
            tree.end(name)
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif name not in VOID:
            tree.start(name, match.group(3))
    for piece in found:
        piece.text = " ".join(entities.unescape("".join(piece.parts)).split())
    return [piece for piece in found if piece.text]


def leaning(block: Block) -> float:
    """The classifier: how strongly the block looks like content."""
    element, words = block.element, block.text.count(" ") + 1
    w = WEIGHTS
    score = w["bias"] + w["long"] * min(words, 20) / 20
    score += w["in_main"] * element.main + w["in_never"] * element.never + w["side_name"] * element.side
    score += w["main_name"] * element.named
    score += w["heading"] * (element.name in ("h1", "h2", "h3"))
    score += w["paragraph"] * (element.name == "p") + w["list_item"] * (element.name == "li")
    score += w["link_share"] * min(1.0, block.link_chars / len(block.text))
    return score + w["sentences"] * (block.text[-1] in ".!?\"”»")


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True on the source side.

    ``lean`` is the terminal capacity of a node, to the source if positive, to the sink if
    negative; ``edges`` bind two nodes both ways.  In phases, flow goes down the levels of a
    breadth-first search from nodes with capacity left at the source to those with capacity left at the sink.
    """
    supply = list(lean)
    near: list[list[int]] = [[] for _ in lean]
    to, room = [], []
    for a, b, capacity in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, capacity]
    while True:
        level = {i: 0 for i, s in enumerate(supply) if s > TINY}
        sources, queue, reached = list(level), deque(level), False
        while queue:
            node = queue.popleft()
            reached |= supply[node] < -TINY
            for edge in near[node]:
                if room[edge] > TINY and to[edge] not in level:
                    level[to[edge]] = level[node] + 1
                    queue.append(to[edge])
        if not reached:
            return [i in level for i in range(len(lean))]
        tried = [0] * len(lean)  # edges of a node that lead nowhere in this phase
        for source in sources:
            _push(source, supply, near, to, room, level, tried)


def _push(source: int, supply, near, to, room, level, tried) -> None:
    """Send what the source has left down the levels until every way is full."""
    path: list[int] = []
    node = source
    while supply[source] > TINY:
        if supply[node] < -TINY:
            amount = min([supply[source], -supply[node], *(room[e] for e in path)])
            for edge in path:
                room[edge] -= amount
                room[edge ^ 1] += amount
            supply[source] -= amount
            supply[node] += amount
            path, node = [], source
            continue
        while tried[node] < len(near[node]):
            edge = near[node][tried[node]]
            if room[edge] > TINY and level.get(to[edge], -1) == level[node] + 1:
                break
            tried[node] += 1
        else:
            if not path:
                return
            node = to[path.pop() ^ 1]
            tried[node] += 1
            continue
        path.append(edge)
        node = to[edge]


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    if not found:
        return ""
    lean = [leaning(b) for b in found]
    edges = [(i, i + 1, NEIGHBOUR) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        section = id(block.element.section)
        if section in last:
            edges.append((last[section], i, SAME_SECTION))
        last[section] = i
    labels = minimum_cut(lean, edges)
    return "\n".join(b.text for b, content in zip(found, labels, strict=True) if content)


@F.arrow_udf(T.StringType())
def extracted(column: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in column], pa.string())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, ``text`` and ``n_chars`` (code points) of every row."""
    texts = pages.select(*keep, extracted(F.col(html)).alias("__text"))
    return texts.select(*keep, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
