"""A lenient reader of HTML into a tree of block elements with their text."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"  # tag
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)",  # tag with an odd quote
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is never shown as page text
SILENT = frozenset("script style noscript template iframe object svg canvas title textarea select option datalist button audio video head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption legend summary figcaption li dt dd html body".split())
#: an open element that a new one of the listed kinds ends, and what it is not sought beyond
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}


#: end tags that reach beyond the innermost table cell
_TABLE_ENDS = frozenset("tr tbody thead tfoot table body html".split())


@dataclass
class Node:
    """A block element. texts: its own runs of text as (order on the page, text)."""

    tag: str
    attributes: str
    parent: int
    depth: int
    texts: list[tuple[int, str]] = field(default_factory=list)
    own_chars: int = 0
    link_chars: int = 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


class Open:
    """The open elements of a page, innermost last. Everything that a tag asks of them takes constant or logarithmic
    time, however deep they are: each name keeps the places where it is open, and blocks keep theirs."""

    def __init__(self):
        self.names = ["body"]
        self.block_of = [0]  # the block node that each open element's text belongs to
        self.places: dict[str, list[int]] = {"body": [0]}
        self.blocks = [0]  # places of open block elements

    def innermost(self, name: str) -> int:
        held = self.places.get(name)
        return held[-1] if held else -1

    def push(self, name: str, block: int) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCK:
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.block_of.append(block)

    def pop(self) -> str:
        name = self.names.pop()
        self.block_of.pop()
        if name:
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
        return name

    def forget(self, name: str) -> int:
        """Takes every open element of a name as not there; returns how many there were."""
        held = self.places.pop(name, [])
        for k in held:
            self.names[k] = ""
        return len(held)

    def to_close(self, name: str) -> int:
        """The place down to which an end tag closes, or 0: an end tag inside a table cell does not reach beyond it."""
        at = self.innermost(name)
        if name not in _TABLE_ENDS and at < max(self.innermost("td"), self.innermost("th"), self.innermost("table")):
            return 0
        return max(at, 0)

    def implied(self, name: str) -> int:
        """The place down to which a start tag closes what it implies the end of, or 0."""
        at = 0
        if name in _ENDS_P and self.names[self.blocks[-1]] == "p":
            at = self.blocks[-1]
        if name in _IMPLIED:
            ends, stop = _IMPLIED[name]
            limit = max(0, *(self.innermost(x) for x in stop))
            for x in ends:
                held = self.places.get(x, [])
                k = bisect_right(held, limit)
                if k < len(held) and (not at or held[k] < at):
                    at = held[k]
        return at


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root (an unnamed body) first; text is decoded and its white space squeezed.
    Time grows with the page's length alone, whatever is nested or left open."""
    nodes = [Node("body", "", -1, 0)]
    stack = Open()
    block, links, silent, order = 0, 0, 0, 0
    run: list[str] = []
    run_links = 0

    def flush():
        nonlocal run, run_links, order
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                nodes[block].texts.append((order, text))
                nodes[block].own_chars += len(text)
                nodes[block].link_chars += min(run_links, len(text))
                order += 1
            run, run_links = [], 0

    def close(depth: int):
        nonlocal block, links, silent
        while len(stack.names) > depth:
            name = stack.pop()
            if name in BLOCK:
                flush()
            elif name == "a":
                links -= 1
            if name in SILENT:
                silent -= 1
            block = stack.block_of[-1]

    def text(value: str):
        nonlocal run_links
        if value and not silent:
            run.append(value)
            if links:
                run_links += len(value)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[6]
        if name is None:
            continue
        ending, rest, closed = (m[1], m[3], m[4]) if m[2] else (m[5], m[7], m[8])
        if not closed:
            break  # the page stops inside a tag
        name = name.lower()
        if ending:
            depth = stack.to_close(name)
            if depth:
                close(depth)
            continue
        if name in ("br", "hr", "wbr"):
            text("" if name == "wbr" else " ")
            if name == "hr":
                flush()
            continue
        if name in VOID:
            continue
        depth = stack.implied(name)
        if depth:
            close(depth)
        if rest.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in ("html", "body"):
            continue
        if name in SILENT:
            silent += 1
        elif name in BLOCK:
            flush()
            nodes.append(Node(name, rest, block, nodes[block].depth + 1))
            block = len(nodes) - 1
        elif name == "a":
            links += 1
        stack.push(name, block)
        if name in ("article", "main", "section", "div", "p") and stack.innermost("head") >= 0:
            silent -= stack.forget("head")  # a head that was never closed
    flush()
    return nodes
