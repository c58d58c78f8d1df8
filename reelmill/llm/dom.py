"""Leaf blocks of an HTML page: text between block-level tags, with the elements around it, in time linear in the page."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

#: Fixed values of HTML: elements without content, elements whose content is not text, inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())  # up to their end tag or the end of the page
UNREAD = RAW | frozenset("noscript template object svg select".split())  # the others only where they end at all
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of these closes an open paragraph; li, tr, td, dt and option close their own kind.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
WALLS = frozenset(("table", "ul", "ol"))
#: Elements nested deeper are read as if they stood at this depth, as browsers do.
DEEPEST = 512

# a tag ends at its >, at the next < or at the end of the page; quotes delimit after = only, and only so far
TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:=\s*+\"[^\"]{0,2000}+\"|=\s*+'[^']{0,2000}+'|[^<>])*+)(?:>|(?=<)|\Z)")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ENDS = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^<>]*>?", re.I) for name in UNREAD}


class Element:
    """An open element; all that lies in it points to it."""

    __slots__ = ("name", "names", "parent", "linked", "marks")

    def __init__(self, name: str, names: str, parent: Element | None):
        self.name, self.names, self.parent = name, names, parent
        self.linked = name == "a" or (parent is not None and parent.linked)
        self.marks = None  # filled by whoever reads features off the elements

    def chain(self) -> list[Element]:
        found, at = [], self
        while at is not None:
            found.append(at)
            at = at.parent
        return found[::-1]


class Block(NamedTuple):
    text: str
    element: Element | None  # the innermost one
    linked: float  # share of characters inside links

    @property
    def tags(self) -> tuple[str, ...]:
        """Element names from the outermost inwards."""
        return tuple(e.name for e in self.element.chain()) if self.element else ()

    @property
    def names(self) -> tuple[str, ...]:
        """Class, id and role values of those elements."""
        return tuple(e.names for e in self.element.chain() if e.names) if self.element else ()


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; white space in a block is one space; blocks without text are left out."""
    blocks: list[Block] = []
    stack: list[Element] = []
    open_tags: Counter = Counter()
    endless: set[str] = set()
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, stack[-1] if stack else None, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        if any(e.name not in INLINE for e in stack[depth:]):
            close()
        for e in stack[depth:]:
            open_tags[e.name] -= 1
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack and stack[-1].linked:
            linked += len(text)

    def after(name: str, at: int) -> int:
        """Where the content of an unread element ends, -1 if it should be read."""
        if name not in endless and (m := ENDS[name].search(page, at)):
            return m.end()
        endless.add(name)  # none from here on, so none later
        return len(page) if name in RAW else -1

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            say(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, start)
        if not m:
            say("<")
            at = start + 1
            continue
        at = m.end()
        name, rest = m["name"].lower(), m["rest"]
        if m["end"]:
            if open_tags[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            elif name not in INLINE:
                close()
            continue
        if name in UNREAD:
            end = at if name == "svg" and rest.endswith("/") else after(name, at)
            if end >= 0:
                at = end
                continue
        if name in VOID:
            parts.append(" ") if name in INLINE else close()
            continue
        if name not in INLINE:
            close()
            own = CLOSES_OWN.get(name) or (("p",) if name in CLOSES_P else ())
            if any(open_tags[o] for o in own):
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name in own or stack[i].name in WALLS)
                if stack[depth].name in own:
                    pop_to(depth)
        if len(stack) < DEEPEST:
            stack.append(Element(name, " ".join(a or b or c for a, b, c in NAMES.findall(rest)).lower() if "=" in rest else "", stack[-1] if stack else None))
            open_tags[name] += 1
    if at < n:
        say(page[at:])
    close()
    return blocks
