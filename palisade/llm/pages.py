"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at its block elements. Each block gets a cost of being called
boilerplate and a cost of being called content from a linear classifier over its markup and its text;
these are the capacities of its edges to the two terminals. Neighbouring blocks, and the
nearest blocks under one parent, are joined by edges that cost more the closer they are in the
document tree. The minimum cut, found by maximum flow, is the labelling with the least total cost: blocks on
the content side make up the text.

No mark decides alone. An element whose name speaks of boilerplate weighs less the larger the
share of the page's text below it, since what holds the page is its frame and not a part of it; a name
that tells a state (``has-sidebar``) or calls the element a frame (``sidebar-layout``) says nothing. Text, links and neighbours decide
blocks without marks: there the edges outweigh a doubtful block.
"""

from __future__ import annotations

import html
import re
from collections import deque
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import over_batches

# Element names of HTML by their role.
SKIPPED = frozenset("script style noscript template textarea select button iframe object svg math canvas audio video title datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var").split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset((
    "ad ads adv advert advertisement advertisements adverts adsense sponsor sponsored promo promotion promotions sidebar nav "
    "navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond widget widgets toolbar pagination pager copyright disclaimer skip search form "
    "hidden banner").split())
GOOD_WORDS = frozenset("article content main post entry story body text prose".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Words of a class that are about readers' comments wherever they stand in it.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
STATE_WORDS = frozenset("has no with without is not".split())
FRAME_WORDS = frozenset("page layout wrapper wrap container site frame grid row columns".split())

# The classifier: positive weights speak for content. They are set so that, with all edges of a
# block, a long sentence stays inside a good element and goes inside a bad one, that a
# paragraph of three lines stays without any mark, and that a block of one word goes with its neighbours.
BIAS, IN_GOOD, GOOD_NAME, HEADER, LINKS, LENGTH, SENTENCE, HEADING = -1.0, 4.0, 2.0, -1.5, -4.0, 0.6, 0.8, 0.5
BAD_TAG, BAD_NAME = -14.0, -12.0
SAME_PARENT, APART, SIBLING = 1.0, 0.4, 0.5
ACROSS = 0.3  # of an edge that leaves or enters a marked element

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Block(NamedTuple):
    text: str
    linked: int          # characters inside links
    path: tuple          # open elements, outermost first, as _Open
    heading: bool


class _Open(NamedTuple):
    tag: str
    number: int
    good: bool
    bad: float  # the weight against content, 0 for none
    named: bool


def _name_says(value: str) -> tuple[bool, bool]:
    """Whether a class or id speaks for boilerplate, and whether for content.

    The last word that says anything is the head of a compound: an ``alert-story`` is a story,
    a ``post-footer`` a footer.
    """
    bad = good = False
    for token in value.split():
        words = list(takewhile(lambda w: w not in STATE_WORDS, (w.lower() for w in _WORD.findall(token))))
        if not words or words[-1] in FRAME_WORDS:
            continue
        if COMMENT_WORDS.intersection(words):
            bad = True
            continue
        head = next((w for w in reversed(words) if w in BAD_WORDS or w in GOOD_WORDS), None)
        bad |= head in BAD_WORDS
        good |= head in GOOD_WORDS
    return bad, good


def _element(tag: str, attributes: str, number: int) -> _Open:
    good, bad, named = tag in GOOD_TAGS, BAD_TAG if tag in BAD_TAGS else 0.0, False
    if attributes.strip() and tag not in ("html", "body"):
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                against, speaks = _name_says(value)
                named |= speaks and not against
                if against:
                    bad = min(bad, BAD_NAME)
            elif key == "role":
                if value.lower() in BAD_ROLES:
                    bad = BAD_TAG
                good |= value.lower() in ("main", "article")
            elif key == "itemprop":
                good |= value == "articleBody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or (
                    key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                bad = BAD_TAG
    return _Open(tag, number, good, bad, named)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles and comments are gone."""
    found: list[Block] = []
    path: list[_Open] = []
    parts: list[str] = []
    linked = links = number = 0
    heading = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, linked, tuple(path), heading))
        parts, linked = [], 0

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        text = page[at:match.start()] if match else page[at:]
        if text:
            parts.append(text)
            linked += len(text) * (links > 0)
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            close()
            heading = heading and not _is_heading(tag)
            links = 0
            for depth in range(len(path) - 1, -1, -1):
                if path[depth].tag == tag:
                    del path[depth:]
                    break
        elif tag in SKIPPED:
            # Raw content up to the element's end; without one it reaches the end of the page.
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = over.start() if over else end
        elif tag in INLINE:
            links += tag == "a"
        else:
            close()
            if path and path[-1].tag == "p":  # a new block ends an open paragraph
                path.pop()
            if path and path[-1].tag == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                path.pop()
            if tag not in VOID:
                number += 1
                heading = _is_heading(tag)
                path.append(_element(tag, match[3], number))
    close()
    return found


def _is_heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"


def scores(page: list[Block]) -> list[float]:
    """The classifier: above zero for content."""
    below: dict[int, int] = {}
    for block in page:
        for x in block.path:
            if x.bad:
                below[x.number] = below.get(x.number, 0) + len(block.text)
    total = sum(len(b.text) for b in page)
    against = {n: 1 - (k / total) ** 4 for n, k in below.items()}
    return [_score(block, against) for block in page]


def _score(block: Block, against: dict[int, float]) -> float:
    inside = any(x.good for x in block.path)
    value = BIAS + IN_GOOD * inside + GOOD_NAME * any(x.named for x in block.path)
    value += min((x.bad * against[x.number] for x in block.path if x.bad), default=0.0)
    value += HEADER * any(x.tag == "header" for x in block.path) * (1 if inside else 4)
    value += LINKS * min(1.0, block.linked / len(block.text))
    words = block.text.count(" ") + 1
    value += LENGTH * min(4, words.bit_length() - 2)
    value += SENTENCE * (block.text[-1] in ".!?…。\"”") + HEADING * block.heading
    return value


def _marked(block: Block) -> list[int]:
    return [x.number for x in block.path if x.bad or x.good]


def _edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Capacities between blocks: neighbours by their distance in the tree, and siblings of one parent."""
    made: dict[tuple[int, int], float] = {}
    latest: dict[int, int] = {}
    marks = [_marked(b) for b in page]
    for k, block in enumerate(page):
        # A block's own element, then the element around it.
        parent = block.path[-2].number if len(block.path) > 1 else 0
        if k:
            before = page[k - 1].path
            shared = 0
            for a, b in zip(before, block.path):
                if a.number != b.number:
                    break
                shared += 1
            steps = len(before) + len(block.path) - 2 * shared
            made[k - 1, k] = SAME_PARENT if steps <= 2 else APART / (steps - 1)
        if parent in latest:
            pair = (latest[parent], k)
            made[pair] = made.get(pair, 0.0) + SIBLING
        latest[parent] = k
    return {(a, b): c if marks[a] == marks[b] else c * ACROSS for (a, b), c in made.items()}


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the content side of the least cut.

    A node's capacity from the source is its score where positive, to the sink its negated
    score where negative; edges count in both directions. Maximum flow by level graphs and
    blocking flows. Nodes that neither side claims are not content.
    """
    n = len(scores)
    excess = [max(0.0, x) for x in scores]
    room = [max(0.0, -x) for x in scores]
    residual: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), capacity in edges.items():
        residual[a][b] = residual[a].get(b, 0.0) + capacity
        residual[b][a] = residual[b].get(a, 0.0) + capacity
    least = 1e-9
    while True:
        level = {k: 0 for k in range(n) if excess[k] > least}
        queue, reached = deque(level), False
        while queue:
            a = queue.popleft()
            reached = reached or room[a] > least
            for b, capacity in residual[a].items():
                if capacity > least and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if not reached:
            return [k in level for k in range(n)]
        arcs = [iter(list(residual[k])) if k in level else iter(()) for k in range(n)]
        for source in [k for k in range(n) if excess[k] > least]:
            way = [source]
            while way and excess[source] > least:
                a = way[-1]
                if room[a] > least:
                    flow = min([excess[source], room[a]] + [residual[u][v] for u, v in zip(way, way[1:])])
                    excess[source] -= flow
                    room[a] -= flow
                    for u, v in zip(way, way[1:]):
                        residual[u][v] -= flow
                        residual[v][u] += flow
                    # Go on from the first edge that is full now.
                    for k, (u, v) in enumerate(zip(way, way[1:])):
                        if residual[u][v] <= least:
                            del way[k + 1:]
                            break
                    continue
                for b in arcs[a]:
                    if residual[a][b] > least and level.get(b, -1) == level[a] + 1:
                        way.append(b)
                        break
                else:
                    way.pop()
                    level[a] = -1


def main_text(page: str | None) -> str:
    """The text of a page's content blocks, joined by single spaces; empty for a null page."""
    found = blocks(page or "")
    content = minimum_cut(scores(found), _edges(found))
    return " ".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per row of ``pages``.

    A null or empty page has the empty text; a very long page takes time and memory in proportion to its
    length and to the depth of its elements. Null ids and addresses stay null; repeated rows get a row
    each. An empty table gives no rows; other columns are ignored.
    """
    def task(batch: pa.RecordBatch) -> dict:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": list(map(len, texts))}

    return over_batches(
        pages.select(F.col("page_id").cast("long"), "url", "html"), "page_id long, url string, text string, n_chars long", task)
