"""Main text of web pages by minimum-cut labelling (operator 3).

A page is cut into blocks of text. What a block's ancestors, links and length say becomes the capacities between
the block and the two terminals, content and boilerplate. Neighbours in page order and in the same DOM parent are
tied by smoothness edges. The minimum cut labels all blocks at once, so that a short paragraph in the middle of an
article stays and a long teaser among links goes. Every page is one row, so the work is a map over the pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe object svg canvas head title textarea select option button audio video".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark math meter mfrac mi mn mo mover mroot "
    "mrow ms msqrt mstyle msub msubsup msup mtext munder output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag ends these, if one of them is the innermost open element of its group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table tbody thead tfoot body html div section article aside nav main".split())

#: Log odds for content that an ancestor element gives.
TAG_ODDS = {
    "article": 6.0, "main": 4.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "header": -6.0, "form": -12.0, "menu": -12.0,
    "dialog": -12.0, "fieldset": -8.0, "h1": 1.0, "p": 0.5, "blockquote": 0.5, "pre": 0.5,
}
def _named(words: str) -> re.Pattern:
    """Whether a class or id has one of the words between its separators."""
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?=$|[\s_-]|\d)", re.I)


HEADERS = "header|head|masthead"
READERS = "comments?|disqus|replies|respond"
CLUTTER = (
    r"nav\w*|menu\w*|footer|side-?bar|ads?|adverts?|advertisement|advertising|sponsor\w*|promo\w*|banner|"
    r"cookies?|consent|gdpr|notice|disclaimer|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"share|sharing|social|related|recommend\w*|teaser|breadcrumbs?|pagination|pager|tags?|widget|toolbar|copyright|legal|search|skip"
)
BAD_NAME, BAD_INSIDE, BAD_ID = _named(f"{CLUTTER}|{HEADERS}|{READERS}"), _named(f"{CLUTTER}|{READERS}"), _named(READERS)
#: Parts of an article whose ids are anchors: a section about search has the id search.
PROSE = frozenset("p section h1 h2 h3 h4 h5 h6 header hgroup blockquote pre table ul ol dl li figure figcaption".split())
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main|body|text|prose)(?=$|[\s_-]|\d)", re.I)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    text: str
    odds: float  # log odds for content
    depth: int  # of the DOM element that directly holds the block
    shared: int  # how many of its elements also hold the block before
    above: int  # the element around that element


@dataclass(slots=True)
class Open:
    """An open element: what it and those around it say."""

    tag: str
    odds: float
    silent: bool
    number: int
    holder: int  # depth of the innermost element around its text that isn't inline
    above: int  # number of the element around that one


def next_tag(page: str, at: int, unclosed: set[str]) -> tuple[int, int, str, bool, str] | None:
    """(start, end, tag or "", whether it closes, attributes) of what comes next that isn't text.

    A quote that is never closed is an ordinary sign, so a broken attribute can't swallow the page; `unclosed` holds
    such quotes, for which no later tag needs to look to the end of the page again.
    """
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return at, len(page) if end < 0 else end + 3, "", False, ""
        if match := TAG.match(page, at):
            end = UNQUOTED.match(page, match.end()).end()
            while end < len(page) and (quote := page[end]) != ">":
                close = page.find(quote, end + 1) if quote not in unclosed else -1
                if close < 0:
                    unclosed.add(quote)
                    close = end
                end = UNQUOTED.match(page, close + 1).end()
            if end == len(page):  # a closed pair of quotes may hide the end as well
                end = page.find(">", match.end())
                if end < 0:
                    return None
            return at, end + 1, match[2].lower(), bool(match[1]), page[match.end() : end]
        if page[at + 1 : at + 2] in ("!", "?") and (end := page.find(">", at)) >= 0:
            return at, end + 1, "", False, ""
        at += 1
    return None


def _element_odds(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """(log odds, whether the element is hidden)."""
    odds = TAG_ODDS.get(tag, 0.0)
    if tag == "header" and in_article:
        odds = 0.0
    if not attributes.strip():
        return odds, False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if not in_article:
        bad = BAD_NAME.search(names)
    elif tag in PROSE:
        bad = BAD_INSIDE.search(found.get("class", "")) or BAD_ID.search(found.get("id", ""))
    else:
        bad = BAD_INSIDE.search(names)
    if bad and tag not in ("body", "html", "article", "main"):
        odds -= 12.0
    elif GOOD_NAME.search(names):
        odds += 2.0
    role = found.get("role", "").lower()
    odds += -12.0 if role in BAD_ROLES else 4.0 if role in ("main", "article") else 0.0
    hidden = "aria-hidden" in found and found["aria-hidden"] == "true" or bool(HIDDEN.search(found.get("style", "")))
    return odds, hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in page order; never raises, whatever the markup."""
    out: list[Block] = []
    stack = [Open("", 0.0, False, 0, 0, -1)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    count = in_links = linked = at = 0
    low = 1  # the least depth of the stack since the last block

    def flush() -> None:
        nonlocal linked, low
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            top = stack[-1]
            words = text.count(" ") + 1
            share = min(1.0, linked / len(text))
            odds = top.odds + min(words, 40) / 20 - 0.5 - 4.0 * share * (words < 40)
            depth = top.holder + 1
            out.append(Block(text, odds, depth, min(depth, low, out[-1].depth) if out else 0, top.above))
            low = len(stack)
        linked = 0

    def close(tag: str) -> None:
        nonlocal in_links, low
        while True:
            gone = stack.pop()
            opened[gone.tag] -= 1
            in_links -= gone.tag == "a"
            if gone.tag == tag:
                break
        low = min(low, len(stack))

    def add(text: str) -> None:
        nonlocal linked
        if text and not stack[-1].silent:
            pieces.append(text)
            if in_links:
                linked += len(text)

    unclosed: set[str] = set()
    while token := next_tag(page, at, unclosed):
        start, end, tag, closes, attributes = token
        add(page[at:start])
        at = end
        if tag and tag not in INLINE:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closes:
            if opened[tag] > 0:
                close(tag)
        elif tag and tag not in VOID:
            if tag not in INLINE and opened["p"] > 0:  # a paragraph holds no block
                close("p")
            if any(opened[t] > 0 for t in CLOSES.get(tag, ())):
                for s in reversed(stack):
                    if s.tag in CLOSES[tag]:
                        close(s.tag)
                        break
                    if s.tag in SCOPE:
                        break
            top = stack[-1]
            odds, hidden = _element_odds(tag, attributes, opened["article"] + opened["main"] > 0)
            silent = top.silent or hidden or tag in SILENT and not (tag == "button" and opened["p"] > 0)
            count += 1
            holder, above = (top.holder, top.above) if tag in INLINE else (len(stack), stack[top.holder].number)
            stack.append(Open(tag, top.odds + odds, silent, count, holder, above))
            opened[tag] += 1
            in_links += tag == "a"
            if tag in RAW:
                end_tag = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end_tag.end() if end_tag else len(page)
                close(tag)
    add(page[at:])
    flush()
    if not count:  # no element at all: nothing speaks against the text
        for block in out:
            block.odds = max(block.odds, 1.0)
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node falls on the content side of the minimum cut.

    A node's odds are its capacity from the content terminal if positive, else to the boilerplate terminal. Nodes
    whose own capacity outweighs all their edges are settled first, which only changes their neighbours'
    capacities; what is left goes through augmenting paths. A tie counts as boilerplate.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    odds, side = list(odds), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(odds[i]) >= sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, c in near[i].items():
                odds[j] += c if side[i] else -c
                del near[j][i]
                todo.append(j)
            near[i].clear()
    left = [i for i in range(n) if side[i] is None]
    if left:
        reached = _max_flow(left, odds, near)
        for i in left:
            side[i] = i in reached
    return side


def _max_flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the content terminal still reaches after a maximum flow, by Dinic's algorithm: every round sends a
    blocking flow along shortest paths, each arc being tried once a round."""
    number = {node: i for i, node in enumerate(nodes)}
    n, source, sink = len(nodes), len(nodes), len(nodes) + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    left: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head.extend((b, a))
        left.extend((there, back))

    for i, node in enumerate(nodes):
        if odds[node] > 0:
            join(source, i, odds[node], 0.0)
        elif odds[node] < 0:
            join(i, sink, -odds[node], 0.0)
        for other, c in near[node].items():
            if i < number[other]:
                join(i, number[other], c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in arcs[i]:
                if left[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[i] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return {node for i, node in enumerate(nodes) if level[i] >= 0}
        turn, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if left[e] <= tiny)
                at = head[path[full] ^ 1]
                del path[full:]
                continue
            while turn[at] < len(arcs[at]):
                e = arcs[at][turn[at]]
                if left[e] > tiny and level[head[e]] == level[at] + 1:
                    path.append(e)
                    at = head[e]
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                level[at] = -1  # a dead end in this round
                at = head[path.pop() ^ 1]


def main_text(page: str | None, adjacent: float = 0.6, sibling: float = 0.8) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page or "")
    edges, last_child = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, adjacent * block.shared / max(block.depth, blocks[i - 1].depth)))
        if block.above in last_child:
            edges.append((last_child[block.above], i, sibling))
        last_child[block.above] = i
    side = min_cut([b.odds for b in blocks], edges)
    return "\n".join(b.text for b, kept in zip(blocks, side, strict=True) if kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of every row.

    Null and empty pages have an empty text. Ids and urls may be null and are returned as they are; repeated rows are
    each returned; other columns are not read. An empty table gives no rows. Text without any markup is content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                lengths = pa.array(list(map(len, texts)), pa.int64())
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), lengths]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
