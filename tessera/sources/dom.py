"""A small tolerant HTML tree with the selectors that the extractors need (standard library only)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: For an element that begins: what it ends if open, and what bounds that.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
_PART = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)\]")


class Node:
    __slots__ = ("attrs", "children", "classes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset(attrs.get("class", "").split())
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self, between: str = "") -> str:
        """Trimmed strings, joined."""
        return between.join(s for s in (x.strip() for x in self.strings()) if s)

    def _is(self, want: tuple) -> bool:
        tag, classes, ident, attrs = want
        return (not tag or self.tag == tag) and classes <= self.classes and (not ident or self.attrs.get("id") == ident) and all(a in self.attrs for a in attrs)

    def select(self, selector: str) -> Iterator[Node]:
        """Elements that match ``tag.class#id[attr]`` steps, each below the one before."""
        steps = [_compound(s) for s in selector.split()]
        for node in self.walk():
            if not node._is(steps[-1]):
                continue
            at, k = node.parent, len(steps) - 2
            while k >= 0 and at is not None:
                if at._is(steps[k]):
                    k -= 1
                at = at.parent
            if k < 0:
                yield node

    def first(self, *selectors: str) -> Node | None:
        """First match of the first selector that has one."""
        return next((n for s in selectors for n in self.select(s)), None)


_compounds: dict[str, tuple] = {}


def _compound(step: str) -> tuple:
    if step not in _compounds:
        tag, classes, ident, attrs = "", set(), "", []
        for kind, name, attr in _PART.findall(step):
            if attr:
                attrs.append(attr)
            elif kind == ".":
                classes.add(name)
            elif kind == "#":
                ident = name
            else:
                tag = name
        _compounds[step] = tag, frozenset(classes), ident, attrs
    return _compounds[step]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags, bounds) -> None:
        node, last = self.at, None
        while node.parent is not None and node.tag not in bounds:
            if node.tag in tags:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"td", "th", "table", "button"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        node = Node(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
