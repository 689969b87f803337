"""Main text of web pages by tree scoring.

A page is parsed into a tree in which paragraphs pass points (for length and commas) to their
ancestors: all to the parent, half to the next, then falling by depth. A container's points are
discounted by the share of its text that lies in links. The best container is kept, or what is around
it and is or is named an article or main part, together with siblings that score well or are plain. Elements that are never content
(navigation, headers, footers, sidebars, forms, scripts, hidden parts) and those whose class, id or role
names such a part, adverts, notices or comments leave the tree first.

Defined results: a NULL or empty page has an empty text and 0 characters; a page without paragraphs
falls back to all text that is left; broken markup is repaired as a browser would roughly do it; rows are
taken one by one, repeated ones alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead tr ul""".split())
_DROP = frozenset("""nav header footer aside form script style noscript template iframe object embed svg math canvas button select
    textarea input audio video map head title dialog menu""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_PARTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside
    menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot comment comments commentlist disqus respond replies
    related recommended share sharing social follow search pagination pager paging toolbar widget widgets form skip hidden""".split())
_P_ENDS = _BLOCK - {"html", "body", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "figcaption", "summary"}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Names of what holds the whole main text.
_WHOLE = frozenset("article content main post entry story text articlebody".split())
#: Share of text in links above which a list, table or division is a menu.
_MENU = 0.5


class Node:
    __slots__ = ("tag", "parent", "items", "points", "chars", "linked", "gone", "whole")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0
        self.gone = False
        self.whole = tag in ("article", "main")

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in _DROP:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    a = {k: v or "" for k, v in attrs}
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    return any(x in _PARTS for x in _names(a))


def _names(a: dict[str, str]) -> list[str]:
    return _NAME.split(_CAMEL.sub("-", f"{a.get('class') or ''} {a.get('id') or ''}").lower())


class Tree(HTMLParser):
    """Builds the tree; unclosed and misnested elements are closed where a block begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.at.items.append(" ")
            return
        if tag in _P_ENDS:
            self._close("p", stop=("table", "td", "th", "button", "object"))
        if tag == "li":
            self._close("li", stop=("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            self._close("dt", stop=("dl",)), self._close("dd", stop=("dl",))
        elif tag in ("td", "th"):
            self._close("td", stop=("tr", "table")), self._close("th", stop=("tr", "table"))
        elif tag == "tr":
            self._close("tr", stop=("table",))
        elif tag == "option":
            self._close("option", stop=("select",))
        node = Node(tag, self.at)
        node.gone = _unwanted(tag, attrs)
        node.whole |= bool(attrs) and (("role", "main") in attrs or any(x in _WHOLE for x in _names(dict(attrs))))
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close(tag, stop=("td", "th") if tag not in ("tr", "table", "tbody", "thead", "tfoot", "td", "th") else ())

    def _close(self, tag: str, stop: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in stop or node.gone and node.tag in _DROP and tag not in _DROP:
                return  # an end tag inside does not close what is around
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.items.append(data)


def _walk(root: Node) -> list[Node]:
    """Nodes that stay, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.gone)
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(_SPACE.sub(" ", x).strip())
            elif not x.gone:
                node.chars += x.chars
                node.linked += x.chars if x.tag == "a" else x.linked


def _own(node: Node) -> tuple[int, int]:
    """(characters, commas) of the text of a block outside blocks within it."""
    chars = commas = 0
    todo: list[Node | str] = list(node.items)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            chars += len(x.strip())
            commas += x.count(",")
        elif not x.gone and x.tag not in _BLOCK:
            todo.extend(x.items)
    return chars, commas


def _main(nodes: list[Node]) -> list[Node]:
    """The containers of the main text, in page order."""
    for node in nodes:
        if node.tag in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section", "article", "main"):
            chars, commas = _own(node)
            if not chars:
                continue
            points = 1 + commas + min(chars / 100, 3.0)
            if node.tag in ("li", "td", "h1", "h2", "h3", "h4", "h5", "h6"):
                points /= 4
            taker = node if node.tag in ("div", "section", "article", "main") else node.parent
            depth = 0
            while taker is not None:
                taker.points += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
                taker, depth = taker.parent, depth + 1
    scored = [n for n in nodes if n.points]
    if not scored:
        return [nodes[0]]
    value = lambda n: n.points * (1 - n.density())
    best = max(scored, key=value)
    node = best
    while node is not None:  # what is around it and named so holds all of it
        if node.whole:
            best = node
            if node.tag == "article":
                break
        node = node.parent
    if best.parent is None or best.tag in ("article", "main"):
        return [best]
    least = 0.2 * value(best)
    return [x for x in best.parent.items if isinstance(x, Node) and not x.gone and (
        x is best or x.points and value(x) >= least or x.tag == "p" and x.density() < 0.25
        or x.tag in _BLOCK and x.chars and not x.linked)]


def _blocks(root: Node, menus: bool) -> Iterator[str]:
    """Text of one block after the other, white space in it as single spaces; ``menus``: those are left out."""
    held: list[str] = []
    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(x)
            continue
        if x is None or x.tag in _BLOCK:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                yield text
        if x is None or x.gone:
            continue
        if menus and x is not root and x.tag in ("ul", "ol", "dl", "table", "div", "section") and x.linked and x.density() > _MENU:
            continue
        if x.tag in _BLOCK:
            todo.append(None)
        todo.extend(reversed(x.items))
    text = _SPACE.sub(" ", "".join(held)).strip()
    if text:
        yield text


def main_text(page: str) -> str:
    """Blocks of the main text in page order, joined by line feeds."""
    if not page:
        return ""
    tree = Tree()
    tree.feed(page)
    # only a comment without an end is left like this: what it holds is no text
    if tree.rawdata.startswith("<!--"):
        tree.rawdata = ""
    tree.close()
    nodes = _walk(tree.root)
    _measure(nodes)
    # a page without a chosen container may be all menus
    return "\n".join(b for n in _main(nodes) for b in _blocks(n, n is tree.root))


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of each page with its ``text`` and ``n_chars``."""
    keep = [c for c in (keep or []) if c not in ("text", "n_chars")]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [main_text(x.as_py() or "") for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 [*keep, "text", "n_chars"])

    return df.select(df[html].alias("__html"), *keep).mapInArrow(run, schema)
