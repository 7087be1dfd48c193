"""Main text of web pages by tree scoring.

A page is parsed into a tree by a tolerant tokeniser. Each paragraph-like block gives points, for its length and commas,
to its parent, half of them to its grandparent and a third of them to the next ancestor; a container's points are
discounted by its link density. Elements whose names tell boilerplate, and forms, are left out, unless they hold most of
the page's unlinked text and have a content name too, are forms, or else next to nothing would be left. The best container
is the article; siblings of it are kept where they score near it or are prose of few links. Nothing is recursive, so no
depth of nesting is too deep.

Defined cases: a null or empty page, or one without text, gives the empty string; scripts, styles, comments and other
markup are dropped; an unclosed element ends with its parent; white space inside a block becomes one space; blocks are
joined in page order by one newline; nothing is capped; rows that repeat a page give a row each; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea select title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption div section article main body".split())
#: Elements that hold no main text wherever they stand.
APART = frozenset("nav footer aside form button dialog menu label head".split())
CONTAINER = frozenset("article main section div body td blockquote html".split())
#: A new one of the first closes an open one of the second, up to a boundary.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
BOILERPLATE = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|promotion|nav|navbar|navigation|menu|sidebar|side-bar|footer|foot|masthead|header|site-header|breadcrumbs?|comments?|comment-\w+|disqus|discussion|respond|repl(?:y|ies)|notices?|cookies?\w*|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social\w*|related|recommend\w*|pagination|pager|widget|toolbar|hidden|alert|legal|copyright)(?:$|[-_\s])",
    re.I,
)
KEEP_NAME = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body|text)(?:$|[-_\s])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("apart", "content", "kids", "name", "named", "parent", "score", "shift")

    def __init__(self, name: str, parent: "Node | None", apart: bool = False, shift: float = 0.0, named: int = 0):
        self.name, self.parent, self.apart, self.shift, self.named = name, parent, apart, shift, named
        #: Whether it or an element around it is an article, a main part or one named as content.
        self.content: bool = parent is not None and (parent.content or shift > 0 or name in ("article", "main"))
        self.kids: list = []
        self.score = 0.0


def _described(name: str, attributes: str, inside: bool) -> tuple[bool, float, int]:
    """Whether an element is boilerplate by name, role or state, points for its name, and whether only a class, an id or being a form tells so (1; 2: it may be content as well)."""
    if name in APART and name != "form":
        return True, 0.0, 0
    if not attributes or attributes.isspace():
        return name == "form" or name == "header" and not inside, 0.0, 2 if name == "form" else 0
    told, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            told.append(value)
        elif key == "role":
            hidden |= value.lower() in ROLES
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    good = any(KEEP_NAME.search(x) for x in told)
    bad = any(BOILERPLATE.search(x) for x in told)
    if name in ("body", "html"):
        return False, 0.0, 0
    if name == "header" and not inside:
        return True, 0.0, 0
    apart = bad and not (good and name in ("article", "main"))
    named = 0 if hidden else 2 if name == "form" and not bad or apart and (good or name in ("article", "main")) else int(apart or name == "form")
    return hidden or apart or name == "form", 25.0 if good and not bad and name != "form" else 0.0, named


def parse(page: str) -> list[Node]:
    """The page's elements in page order, the root first; a node's ``kids`` are nodes and text (str), in page order."""
    root = Node("html", None)
    nodes = [root]
    open_: Counter[str] = Counter()
    at, end = root, 0

    def left(inner: Node, outer: Node) -> Node:
        """``outer``, once all from ``inner`` up to it are ended."""
        while inner is not outer:
            open_[inner.name] -= 1
            inner = inner.parent
        return outer

    n = len(page)
    pos = 0
    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        if m.start() > end:
            at.kids.append(page[end : m.start()])
        pos = end = m.end()
        ending, name, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if ending:
            if name == "br":
                at.kids.append(" ")
                continue
            if not open_[name]:
                continue
            node = at
            while node is not None and node.name != name:
                # An inline end tag doesn't close blocks around it.
                if name not in BLOCK and node.name in BLOCK:
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                at = left(at, node.parent)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            pos = end = close.end() if close else n
            continue
        if name in VOID:
            if name in ("br", "hr", "img", "wbr"):
                at.kids.append(Node("hr", at) if name == "hr" else "" if name == "wbr" else " ")
            continue
        if name in BLOCK:
            # A block ends an open paragraph, and the inline elements left open in it.
            node = at
            while node.name not in BLOCK and node.parent is not None:
                node = node.parent
            if node.name == "p" or node.name[0] == "h" and node.name[1:].isdigit() and name[0] == "h" and name[1:].isdigit():
                at = left(at, node.parent)
            elif node is not at:
                at = left(at, node)
        if name in CLOSES:
            ends, until = CLOSES[name]
            ends = ends.split()
            node, last = at if any(open_[x] for x in ends) else None, None
            while node is not None and node.name not in until:
                if node.name in ends:
                    last = node
                node = node.parent
            if last is not None:
                at = left(at, last.parent)
        if name in ("html", "body") and at is not root:
            continue
        apart, shift, named = _described(name, attributes, at.content)
        child = Node(name, at, apart, shift, named)
        at.kids.append(child)
        nodes.append(child)
        open_[name] += 1
        at = child
    if end < n:
        at.kids.append(page[end:])
    return nodes


def _visible(nodes: list[Node]) -> list[Node]:
    """Those that neither are boilerplate nor lie in it."""
    hidden: set[int] = set()
    out = []
    for node in nodes:
        if node.apart or node.parent is not None and id(node.parent) in hidden:
            hidden.add(id(node))
        else:
            out.append(node)
    return out


def _measure(visible: list[Node]) -> dict[int, tuple[int, int]]:
    """Text and link-text length of each visible element; paragraphs' points go to their ancestors."""
    linked: set[int] = set()
    for node in visible:
        node.score = 0.0
        if node.name == "a" or node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
    lengths: dict[int, tuple[int, int]] = {}
    commas: dict[int, int] = {}
    for node in reversed(visible):  # what is in an element comes after it
        text = link = own = comma = 0
        for kid in node.kids:
            if isinstance(kid, str):
                t = len(kid.strip())
                text += t
                own += t
                comma += kid.count(",")
                link += t if id(node) in linked else 0
            elif id(kid) in lengths:
                t, x = lengths[id(kid)]
                text += t
                link += x
                if kid.name not in BLOCK:
                    own += t
                    comma += commas[id(kid)]
        lengths[id(node)], commas[id(node)] = (text, link), comma
        if node.name in PARAGRAPH and own >= 1:
            density = min(1.0, link / max(1, text))
            points = (1 + comma + min(3.0, own / 100)) * (1 - density) * (0.2 if own < 25 else 1.0)
            above = node.parent if node.name not in ("div", "section", "article", "main", "body") else node
            for divisor in (1, 2, 3):
                if above is None:
                    break
                above.score += points / divisor
                above = above.parent
    return lengths


def _blocks(top: Node, out: list[str]) -> None:
    """Appends the text of each block below an element, in page order."""
    held: list[str] = []

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        if text:
            out.append(text)
        held.clear()

    walk = [(top, iter(top.kids))]
    while walk:
        node, kids = walk[-1]
        for kid in kids:
            if isinstance(kid, str):
                held.append(kid)
            elif kid.apart:
                flush()
            else:
                if kid.name in BLOCK:
                    flush()
                walk.append((kid, iter(kid.kids)))
                break
        else:
            walk.pop()
            if node.name in BLOCK:
                flush()
    flush()


def _unlinked(nodes: list[Node]) -> dict[int, int]:
    """By element: text in it that no link holds, with what is apart by its name only."""
    sizes: dict[int, int] = {}
    for node in reversed(nodes):
        sizes[id(node)] = sum(len(k.strip()) if isinstance(k, str) else 0 if k.name == "a" or k.apart and not k.named else sizes.get(id(k), 0) for k in node.kids)
    return sizes


def _spare(root: Node, sizes: dict[int, int], most: float, least: int) -> bool:
    """Takes in again what is apart by its name (rated ``least`` or more) and holds more than ``most`` of text; whether there was any."""
    some, todo = False, [root]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str) or sizes.get(id(kid), 0) <= most:
                continue
            if kid.apart and kid.named >= least:
                kid.apart, some = False, True
            if not kid.apart:
                todo.append(kid)
    return some


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    nodes = parse(page)
    sizes = _unlinked(nodes)
    whole = sizes[id(nodes[0])]
    _spare(nodes[0], sizes, whole / 2, 2)
    text = _article(nodes)
    if 10 * len(text) < whole and _spare(nodes[0], sizes, whole / 2, 1):
        text = _article(nodes)
    return text


def _article(nodes: list[Node]) -> str:
    """The text of the best container and of siblings like it."""
    visible = _visible(nodes)
    lengths = _measure(visible)

    def total(node: Node) -> float:
        text, link = lengths[id(node)]
        bonus = 25.0 if node.name in ("article", "main") and text else 0.0
        return (node.score + node.shift * (node.score > 0) + bonus) * (1 - min(1.0, link / max(1, text)))

    def prose(node: Node) -> bool:
        """Paragraphs and the like, whatever their length, and sections of such; short ones need a heading."""
        if node.name in ("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "table", "dl"):
            return lengths[id(node)][0] > 0
        if node.name not in ("div", "section", "article", "ul", "ol"):
            return False
        kinds = {k.name for k in node.kids if not isinstance(k, str) and lengths.get(id(k), (0, 0))[0]}
        return node.score > 0 and (lengths[id(node)][0] > 60 or bool(kinds & {"h1", "h2", "h3", "h4", "h5", "h6"}) and "p" in kinds)

    best, top = None, 0.0
    for node in visible[1:]:
        if node.name in CONTAINER and (t := total(node)) > top:
            best, top = node, t
    if best is None:
        best = nodes[0]
    chosen = [best]
    if best.parent is not None:
        chosen = []
        for kid in best.parent.kids:
            if isinstance(kid, str) or kid.apart:
                continue
            if kid is best:
                chosen.append(kid)
            elif kid.name in BLOCK and id(kid) in lengths:
                text, link = lengths[id(kid)]
                if link / max(1, text) < 0.25 and (total(kid) >= max(10.0, 0.2 * top) or prose(kid)):
                    chosen.append(kid)
    out: list[str] = []
    for node in chosen:
        _blocks(node, out)
    return "\n".join(out)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Map only: no shuffle."""

    def work(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_column, url_column, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url_column)]
    return pages.select(pages[id_column], pages[url_column], pages[html_column].alias("html")).mapInArrow(work, f"`{id_column}` {kinds[0]}, `{url_column}` {kinds[1]}, text string, n_chars long")
