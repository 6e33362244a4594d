"""A small element tree over the standard HTML parser, for the jobs that need real structure.

Unclosed elements simply nest; an end tag closes the nearest open element of its name and is ignored
when there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Element]:
        """Elements below this one in document order (iterative: pages nest deeply)."""
        stack = [child for child in reversed(self.children) if isinstance(child, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(child for child in reversed(node.children) if isinstance(child, Element))

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((node for node in self.walk() if test(node)), None)

    def drop(self, test: Callable[[Element], bool]) -> None:
        for node in [node for node in self.walk() if test(node)]:
            if node.parent is not None and node in node.parent.children:
                node.parent.children.remove(node)

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                if item.strip():
                    yield item.strip()
            else:
                stack.extend(reversed(item.children))

    def text(self, joiner: str) -> str:
        return joiner.join(self.strings())

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self._open = self.root

    def handle_starttag(self, tag, attrs):
        given: dict[str, str] = {}
        for key, value in attrs:
            given.setdefault(key, value or "")
        node = Element(tag, given, self._open)
        self._open.children.append(node)
        if tag not in _VOID:
            self._open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self._open
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self._open = node.parent

    def handle_data(self, data):
        self._open.children.append(data)


def parse(markup: str) -> Element:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def named(*tags: str) -> Callable[[Element], bool]:
    return lambda node: node.tag in tags
