"""Leaf blocks of a web page: runs of text between block-level tags, with the elements they stand in.

An element knows its parent, so that a block costs the same however deep it stands, and open elements are found by
name without a search: a page takes time in proportion to its length."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

#: Fixed values of HTML: elements without content, with content that is no markup, and those inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Fixed values of HTML: elements whose content is not shown as text, elements of other languages, and the start tags that
#: end those where they were left open.
HIDDEN = frozenset("svg template".split())
FOREIGN = frozenset("svg math".split())
BREAKOUT = frozenset("big blockquote body center code dd div dl dt em h1 h2 h3 h4 h5 h6 head li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Fixed value of HTML: what a start tag ends, if it is open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",)}

#: A value in quotes begins after an equals sign only; a quote elsewhere, or one that is never closed, is a character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")
_CLOSERS: dict[str, re.Pattern] = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


class Element:
    """An open element. held keeps what a model has worked out for it."""

    __slots__ = ("tag", "marks", "parent", "held")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Element | None):
        self.tag, self.marks, self.parent, self.held = tag, marks, parent, None


@dataclass
class Block:
    text: str
    element: Element | None  # the innermost one
    linked: int  # characters inside links


@lru_cache(maxsize=20_000)
def _marks(attributes: str) -> tuple[str, ...]:
    """Words of the class, id, role and the like."""
    marks: list[str] = []
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            marks += _NAME.findall(value)
        elif hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            marks.append("~hidden")
    return tuple(dict.fromkeys(marks))


class _Open:
    """The open elements, innermost last."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}  # of each name, in the stack
        self.blocks: list[int] = []  # places of those that are not part of a line
        self.hidden = self.foreign = 0

    def push(self, tag: str, attributes: str) -> None:
        if tag not in INLINE and not self.foreign:
            self.blocks.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Element(tag, _marks(attributes), self.stack[-1] if self.stack else None))
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in FOREIGN
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def place(self, tag: str) -> int:
        """Of the innermost open element of that name; -1 without one."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def end(self, tag: str) -> None:
        depth = self.place(tag)
        # A line's element doesn't close the blocks inside it; a tag that closes nothing is passed over.
        if depth >= 0 and not (tag in INLINE and self.blocks and self.blocks[-1] > depth):
            self.cut(depth)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked = 0
    element: Element | None = None

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, element, linked))
            parts, linked = [], 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not opened.hidden:
            if not parts or len(parts) == 1 and not parts[0].strip():
                element, parts = opened.stack[-1] if opened.stack else None, []
            parts.append(page[at:stop])
            if opened.place("a") >= 0:
                linked += stop - at
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2), m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            if not opened.hidden:
                parts.append(" ")
            if tag == "hr":
                close()
            continue
        if closing:
            if tag not in INLINE and not opened.foreign:
                close()
            opened.end(tag)
            continue
        if tag in RAW:
            # Raw content is dropped up to its end tag; without one, what is closed in itself is empty and the rest has the page.
            done = _CLOSERS[tag].search(page, at)
            at = done.end() if done else at if attributes.rstrip().endswith("/") else end
            continue
        if tag in VOID:
            continue
        if opened.foreign and tag in BREAKOUT and opened.place("foreignobject") < max(opened.place(x) for x in FOREIGN):
            opened.cut(min(x for x in (opened.place(f) for f in FOREIGN) if x >= 0))
        if opened.foreign or tag in FOREIGN:
            if not attributes.rstrip().endswith("/"):
                opened.push(tag, attributes)
            continue
        if tag not in INLINE:
            close()
            # A block ends an open paragraph and what stands in a line; some end their like.
            depth, stack = len(opened.stack), opened.stack
            while depth and (stack[depth - 1].tag in INLINE or stack[depth - 1].tag == "p" or stack[depth - 1].tag in ENDS.get(tag, ())):
                depth -= 1
            opened.cut(depth)
        opened.push(tag, attributes)
    close()
    return out
