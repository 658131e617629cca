"""Main text of web pages by composite text density.

Each DOM node has the characters of its subtree and the tags in it; characters and
tags of links lower its density. A node's composite score is the sum of its
children's densities, so the container whose children are dense wins. Going down
from the body, a child stays eligible only while its density reaches the lowest
density on the path from the body to the best-scored node. Every eligible node,
on that path or beside it, adds the best-scored container below it; the main text
is the smallest subtree that holds all these containers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by what they mean for main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset(
    "script style noscript template iframe object svg canvas math audio video select option datalist textarea button"
    " form input label fieldset head title meta link nav footer aside menu dialog".split()
)
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "br", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SELF_CLOSING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Elements that hold paragraphs and more; what only marks up a paragraph or a part of one is none.
CONTAINERS = frozenset("article body center details div html main section table".split())
#: Elements whose class or id may name page furniture.
NAMED = (CONTAINERS | frozenset("dl header ol ul".split())) - {"article", "body", "html", "main"}
#: Class or id names made of these words only, or of these and PLACES, name page furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer"
    " header login masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo related"
    " reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLACES = frozenset(
    "area bar block bottom box col column container global inner item items left link links list main outer page panel primary"
    " right secondary section site top wrap wrapper".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """A DOM node; ``parts`` holds text pieces and child nodes in page order."""

    __slots__ = ("tag", "parts", "parent", "skip", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag: str, parent: "Node | None", skip: bool):
        self.tag, self.parent, self.skip, self.parts = tag, parent, skip, []

    def children(self) -> list["Node"]:
        return [p for p in self.parts if isinstance(p, Node)]


def _is_furniture(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in NEVER_TEXT or (tag == "header" and not inside_article):
        return True
    for name, value in attrs:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and value and tag in NAMED:
            for own in value.split():
                own = set(_NAME.findall(_CAMEL.sub("-", own).lower()))
                if own & FURNITURE and own <= FURNITURE | PLACES:
                    return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class TreeBuilder(HTMLParser):
    """Builds the tree as browsers do for the cases that pages get wrong: unclosed and misplaced end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("html", None, False)
        self.articles = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in CLOSES_P:
            self._close(frozenset(["p"]), frozenset(["article", "section", "div", "td", "th", "li", "blockquote", "body"]))
        if tag in SELF_CLOSING:
            self._close(*SELF_CLOSING[tag])
        node = Node(tag, self.open, self.open.skip or _is_furniture(tag, attrs, self.articles > 0))
        self.open.parts.append(node)
        if tag not in VOID:
            self.open = node
            self.articles += tag == "article"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _up_to(self, node: Node) -> None:
        while True:
            gone, self.open = self.open, self.open.parent
            self.articles -= gone.tag == "article"
            if gone is node:
                return

    def _close(self, tags: frozenset[str], barrier: frozenset[str]) -> None:
        """Close the nearest open element of ``tags`` below a ``barrier``."""
        node = self.open
        while node.parent is not None and node.tag not in barrier:
            if node.tag in tags:
                self._up_to(node)
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None:
            if node.tag == tag:
                self._up_to(node)
                return
            node = node.parent
        # An end tag of something never opened says nothing.

    def handle_data(self, data: str) -> None:
        if data:
            self.open.parts.append(data)


def _in_order(root: Node) -> list[Node]:
    """Parents before children, without recursion: pages may nest very deep."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(node.children())
    return nodes


def score_nodes(root: Node) -> Node:
    """Counts, densities and composite scores of every node, from the leaves up; returns the body."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        children = node.children()
        own = 0 if node.skip else sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in children)
        node.tags = sum(c.tags + 1 for c in children if not c.skip)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in children)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in children if not c.skip)
    body = next((n for n in nodes if n.tag == "body"), root)
    page_links = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.score = sum(c.density for c in node.children())
        node.density = 0.0
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            # Characters per tag, times a logarithm whose base grows with the node's and the page's link text.
            base = math.log(node.chars / plain * node.link_chars + page_links * node.chars + math.e)
            inner = node.chars / max(node.link_chars, 1) * max(node.tags, 1) / max(node.link_tags, 1)
            node.density = node.chars / max(node.tags, 1) * math.log(inner + 1) / math.log(base + math.e - 1)
    return body


def _container(node: Node, body: Node) -> Node:
    while node is not body and node.tag not in CONTAINERS:
        node = node.parent
    return node


def main_node(root: Node) -> Node | None:
    """The smallest subtree that holds the best-scored container of every node eligible from the body down."""
    body = score_nodes(root)
    if not body.chars:
        return None
    nodes = _in_order(body)
    best: dict[Node, Node] = {}
    for node in reversed(nodes):
        found = [node, *(best[c] for c in node.children())]
        best[node] = max(found, key=lambda n: (n.score if n.chars else -1.0, n.chars))
    threshold, node = math.inf, best[body]
    while node is not body.parent:
        threshold = min(threshold, node.density)
        node = node.parent
    kept: set[Node] = set()
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node not in kept:
            kept.add(_container(best[node], body))
            stack.extend(node.children())
    held = dict.fromkeys(nodes, 0)
    for node in reversed(nodes):
        held[node] += node in kept
        if node is not body:
            held[node.parent] += held[node]
    top = body
    while top not in kept and (below := next((c for c in top.children() if held[c] == held[body]), None)):
        top = below
    _skip_link_lists(top, kept, held, threshold)
    return top


def _skip_link_lists(top: Node, kept: set[Node], held: dict[Node, int], threshold: float) -> None:
    """Take out what is neither eligible nor in an article nor beside text of its own: containers and lists that are mostly links."""
    node: Node | None = top
    while node is not None:
        if node.tag in ("article", "main"):
            return
        node = node.parent
    stack = [top]
    while stack:
        node = stack.pop()
        if node in kept or node.tag in ("article", "main"):
            continue
        if not held[node] and node.tag in NAMED and node.density < threshold and 2 * node.link_chars > node.chars:
            node.skip = True
            for below in _in_order(node):
                below.skip = True
        else:
            stack.extend(node.children())


def text_blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order; white space inside a block is one space."""
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            blocks.append(text)

    stack: list = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            piece.append(at)
        elif at is None:
            end()
        elif not at.skip:
            if at.tag in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(at.parts))
    end()
    return blocks


def extract(html: str | None) -> str:
    """Main text of a page; empty for null, blank or textless pages."""
    if not html or not html.strip():
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    node = main_node(builder.root)
    return " ".join(text_blocks(node)) if node is not None else ""


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array([extract(x.as_py()) for x in batch.column("html")], pa.string())],
            names=["id", "url", "text"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page; no shuffle. Null or textless pages have an empty text."""
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    done = rows.mapInArrow(_extract_batches, f"id {kind}, url {url_kind}, text string")
    return done.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars")
    )
