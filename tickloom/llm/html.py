"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that aren't part of an article (a header only outside one), and words of a class, id or role that say so: NOTICES anywhere in a
#: token (comment-list, cookie-bar), DROPPED_MARKS as its last word.  A token with a word of NOT_MARKS says nothing of its element.
DROPPED = frozenset("nav header footer aside form button select dialog menu svg canvas object audio video map head".split())
NOTICES = frozenset("comment comments disqus replies cookie cookies consent gdpr newsletter advert adverts advertisement sponsored breadcrumb breadcrumbs".split())
DROPPED_MARKS = frozenset(
    "ad ads adv sponsor promo promotion banner notice popup modal overlay nav navbar navigation menu sidebar header masthead footer related recommended share "
    "sharing social subscribe subscription widget contentinfo complementary search".split()
)
NOT_MARKS = frozenset("no not has have with without open closed off enabled disabled count".split())
#: What records of readers don't hold, and the characters of the line that names one, at most.
_NOT_RECORDS, BYLINE = frozenset("h1 h2 h3 h4 h5 h6 table pre figure img ul ol dl".split()), 40
#: What a start tag closes if it is open: the innermost of these, unless a bound is opened after it.
_ENDS = (("p", "td th button object"), ("li", "ul ol menu"), ("dt dd", "dl"), ("tr", "table"), ("td th", "tr table"), ("option", "select"))
_GROUP = {tag: g for g, (tags, _) in enumerate(_ENDS) for tag in tags.split() if g}
_OPENED = {tag: [(g, tag in tags.split()) for g, (tags, bounds) in enumerate(_ENDS) if tag in f"{tags} {bounds}".split()] for tags, bounds in _ENDS for tag in f"{tags} {bounds}".split()}
_INSIDE_P = frozenset("option td th caption".split())


class Node:
    __slots__ = ("chars", "density", "first", "items", "link_chars", "link_tags", "marked", "odd", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items, self.marked = tag, parent, [], 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.first, self.odd = "", False  # the first text; whether something below is no part of a record


def _mark(token: str) -> int:
    """2 for a token of a notice or of comments, 1 for another that isn't the article's, else 0."""
    words = [w for w in _SPLIT.split(token) if w]
    if not words or not NOT_MARKS.isdisjoint(words):
        return 0
    return 2 if not NOTICES.isdisjoint(words) else int(words[-1] in DROPPED_MARKS)


def _dropped(tag: str, attributes: str, inside: bool) -> int:
    """3 if an element goes, 2 or 1 if it goes by its marks, else 0.  inside: of an article, whose header is its own."""
    if tag in DROPPED and not (inside and tag == "header"):
        return 3
    marked = 0
    for name, value in _MARKS.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 3
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for token in value.split():
                found = _mark(token)
                if found == 2 or found == 1 and tag not in ("article", "main") and not (inside and token.endswith("header")):
                    marked = max(marked, found)
    return marked


def _unmark(root: Node) -> None:
    """Take marked elements out, but for those around an article or main element; if no text is left, only notices and comments go."""
    order = _order(root)
    if not any(n.marked for n in order):
        return
    text: dict[int, bool] = {}
    bodies: dict[int, bool] = {}  # whether a subtree has such an element with text
    for node in reversed(order):
        below = [x for x in node.items if isinstance(x, Node)]
        text[id(node)] = any(isinstance(x, str) and x.strip() for x in node.items) or any(text[id(x)] for x in below)
        bodies[id(node)] = any(bodies[id(x)] for x in below) or not node.marked and node.tag in ("article", "main") and text[id(node)]
    for least in (1, 2):
        goes = lambda x, least=least: x.marked >= least and not bodies[id(x)]
        left, todo = False, [root]
        while todo and not left:
            for x in todo.pop().items:
                if isinstance(x, str):
                    left = left or bool(x.strip())
                elif not goes(x):
                    todo.append(x)
        if left or least == 2:
            for node in order:
                node.items = [x for x in node.items if isinstance(x, str) or not goes(x)]
            return


class _Open:
    """The open elements.  Every entry knows the innermost open element of each group of _ENDS (or none) and the
    innermost block, so that a tag is placed without a look through the stack."""

    def __init__(self, root: Node):
        self.nodes: list[Node | None] = [root]  # no node: in a dropped element
        self.tags = ["html"]
        self.ends: list[tuple[int, ...]] = [(-1,) * len(_ENDS)]
        self.block = [0]
        self.places: dict[str, list[int]] = {"html": [0]}

    def push(self, tag: str, node: Node | None) -> None:
        at, ends = len(self.tags), self.ends[-1]
        if tag in _OPENED:
            now = list(ends)
            for g, is_end in _OPENED[tag]:
                now[g] = at if is_end else -1
            ends = tuple(now)
        self.nodes.append(node)
        self.tags.append(tag)
        self.ends.append(ends)
        self.block.append(at if tag in BLOCKS and tag != "p" else self.block[-1])
        self.places.setdefault(tag, []).append(at)

    def close(self, to: int) -> None:
        while len(self.tags) > max(1, to):
            self.places[self.tags.pop()].pop()
            self.nodes.pop()
            self.ends.pop()
            self.block.pop()

    def end(self, tag: str) -> None:
        """An end tag closes its innermost element; one that makes no block doesn't reach out of a block."""
        at = self.places.get(tag)
        if at and at[-1] > 0 and (tag in BLOCKS or at[-1] > self.block[-1]):
            self.close(at[-1])

    def before(self, tag: str) -> None:
        """What a start tag closes."""
        if tag in BLOCKS and tag not in _INSIDE_P and self.ends[-1][0] > 0:
            self.close(self.ends[-1][0])
        if tag in _GROUP and (at := self.ends[-1][_GROUP[tag]]) > 0:
            self.close(at)


def parse(page: str, lists: bool = True) -> Node:
    """A tree of the kept elements; dropped elements and raw text are read over.  Takes linear time for any markup.  Without lists only
    the head is dropped by name."""
    root = Node("html", None)
    stack = _Open(root)
    at, end = 0, page.rfind(">") + 1  # what stands after the last > is text

    def text(piece: str) -> None:
        if piece and stack.nodes[-1] is not None:
            stack.nodes[-1].items.append(piece)

    while at < end:
        m = _TOKEN.search(page, at, end)
        if m is None:
            break
        text(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if slash:
            stack.end(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and stack.places.get("head"):
                stack.close(stack.places["head"][0])
            continue
        stack.before(tag)
        parent = stack.nodes[-1]
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            at = found.end() if found else len(page)
            continue
        inside = bool(stack.places.get("article") or stack.places.get("main"))
        dropped = 3 if parent is None else _dropped(tag, attributes, inside) if lists else 3 * (tag == "head")
        node = None if dropped == 3 else Node(tag, parent)
        if node is not None:
            node.marked = dropped
            parent.items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            stack.push(tag, node)
    text(page[at:])
    _unmark(root)
    return root


def weigh(root: Node) -> list[Node]:
    """Fill in counts, densities and density sums; nodes in page order.

    Elements that make no block (b, span, br ...) count as tags and their text as their block's, but are no
    parts of the layout: a sum goes over the nearest blocks below, and no such element is chosen.
    """
    order = _order(root)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
                node.odd = node.odd or x.odd or x.tag in _NOT_RECORDS
                node.first = node.first or x.first
            else:
                node.chars += len(x.strip())
                node.first = node.first or x.strip()
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(order):
        if node.chars:
            tags, link_chars = max(1, node.tags), max(1, node.link_chars)
            # one more than the published base, which is 1 or nearly so for a node without links on a page with few: its logarithm then is no divisor
            base = 1 + math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
            adjusted = node.chars / link_chars * tags / max(1, node.link_tags)
            node.density = node.chars / tags * math.log(max(1.0, adjusted)) / math.log(base)
        node.sum = sum(x.density if x.tag in BLOCKS else x.sum for x in node.items if isinstance(x, Node))
    return order


def _largest(nodes: list[Node]) -> Node:
    """The block of the largest density sum, the innermost if equal; of the largest density if no sum is above 0."""
    nodes = [n for n in nodes if n.tag in BLOCKS]
    best = nodes[0]
    for n in nodes[1:]:
        if (n.sum, n.density if not best.sum else 0) >= (best.sum, best.density if not best.sum else 0):
            best = n
    return best


def content(root: Node) -> list[Node]:
    """Roots of the main text, in page order, as _content."""
    return _content(root)[0]


def _content(root: Node) -> tuple[list[Node], float]:
    """Roots of the main text, in page order, and the density of the sparsest node on the path to the body.

    The subtree of the largest density sum, and of whatever hangs on its path to the body and is as
    dense as the sparsest node of that path, its subtree of the largest sum (or itself, if that is no more
    than its own density).
    """
    order = weigh(root)
    if not root.chars:
        return [], 0.0
    best = _largest(order)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    path = [n for n in path if n.tag in BLOCKS]
    least = min(n.density for n in path)
    on_path, keep = set(map(id, path)), {id(best)}
    for up in path[1:]:
        for x in up.items:
            if isinstance(x, Node) and x.tag in BLOCKS and id(x) not in on_path and x.chars and x.density >= least:
                top = _largest(_order(x))
                keep.add(id(top if top.sum > x.density else x))
    return [n for n in order if id(n) in keep], least


def _without_links(roots: list[Node], least: float) -> None:
    """Take out blocks of links: three or more with most of the text, less dense than the sparsest node of the body's path."""
    todo = list(roots)
    while todo:
        node = todo.pop()
        node.items = [x for x in node.items if isinstance(x, str) or not (x.tag in BLOCKS and x.link_tags >= 3 and 2 * x.link_chars > x.chars and x.density < least)]
        todo += [x for x in node.items if isinstance(x, Node)]


def _byline(record: Node) -> bool:
    """Whether an element begins with a short part that is no sentence and goes on with more text."""
    first = record.first
    return 0 < len(first) <= BYLINE and first[-1] not in ".!?:;," and record.chars >= 2 * len(first)


def _shape(node: Node) -> tuple[str, frozenset[str]] | None:
    """Tags of an element that may be a record: one with parts, none of them a heading, a list or the like."""
    tags = frozenset(x.tag for x in node.items if isinstance(x, Node)) - {"br"}
    return None if node.odd or not tags or node.tag not in BLOCKS or node.tag == "p" else (node.tag, tags)


def _without_records(roots: list[Node]) -> None:
    """Take out runs of three or more sibling elements of one shape that all begin with a byline, after a paragraph of text: what
    readers wrote below an article."""
    prose = False
    todo: list[Node | str] = list(reversed(roots))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            prose = prose or len(node.strip()) > 2 * BYLINE
            continue
        if prose:
            parts = [x for x in node.items if isinstance(x, Node)]
            shapes = [_shape(x) for x in parts]
            gone, i = set(), 0
            while i < len(parts):
                j = i
                while j < len(parts) and shapes[i] is not None and shapes[j] == shapes[i] and _byline(parts[j]):
                    j += 1
                if j - i >= 3:
                    gone |= set(map(id, parts[i:j]))
                i = max(j, i + 1)
            if gone:
                node.items = [x for x in node.items if isinstance(x, str) or id(x) not in gone]
        todo += reversed(node.items)


def _order(top: Node) -> list[Node]:
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    return order


def blocks(top: Node) -> list[str]:
    """The texts of the blocks below a node, with single spaces and decoded references."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if joined:
            out.append(joined)

    todo: list[object] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        else:
            block = x.tag in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.items)
    flush()
    return out


def main_text(page: str | None, lists: bool = True) -> str:
    """The article of a page, its blocks joined by a newline; empty for null, blank or article-less pages.  Without lists no
    name of an element, class or id counts."""
    if not page:
        return ""
    roots, least = _content(parse(page, lists))
    _without_links(roots, least)
    _without_records(roots)
    return "\n".join(b for node in roots for b in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    One pass without a shuffle over whole pages; repeated rows stay, other columns are ignored, a null
    html gives an empty text.  Cut-off and unbalanced markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select("page_id", "url", "html")
    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
