"""Selectors over HTML trees: a step is compiled into parts that narrow a list of nodes (EXT-08, EXT-11 to EXT-21).

::

    step      := part ("@" part)*            the last part may be the name of an attribute
    part      := [locator] position*         positions alone pick from the whole list at hand
    locator   := "tag." NAME | "class." NAME (" " NAME)* | "id." NAME | "text." WORD | XPath | CSS
    position  := "[" a ":" b "]" | "." a ":" b       from a to b, both included
               | "[" a ("," a)* "]"                  these, in this order
               | "!" a ("," a)*                      all but these
               | "." a                               this one

Positions may be negative, counting from the end; those outside the list are passed over. Whatever their
order in the text, a range is applied first, then the list, then what is left out, then the single one.
In XPath "[2]" and ".5" belong to the path itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from . import dom

#: Attribute names that a last "@" part may be, and their open families. Fixed values.
ATTRIBUTES = {"href", "src", "alt", "title", "value", "content", "class", "id", "style", "text", "textNodes", "html"}
FAMILIES = ("data-", "aria-")

Locator = Callable[[dom.Node], list[Any]]

#: A position at the end of a part. The name of the group says how its numbers are applied.
_INTEGER = r"-?[0-9]+"
_LIST = rf"{_INTEGER}(?:\s*,\s*{_INTEGER})*"
_POSITION = re.compile(rf"\[(?P<range>{_INTEGER}:{_INTEGER})\]$|\.(?P<dotted>{_INTEGER}:{_INTEGER})$|\[(?P<these>{_LIST})\]$|!(?P<others>{_LIST})$|\.(?P<one>{_INTEGER})$")


def _in_range(items: list[Any], at: list[int]) -> list[Any]:
    return items[max(at[0], 0) : max(at[1] + 1, 0)]


def _these(items: list[Any], at: list[int]) -> list[Any]:
    return [items[k] for k in at if 0 <= k < len(items)]


def _others(items: list[Any], at: list[int]) -> list[Any]:
    return [x for k, x in enumerate(items) if k not in at]


#: How each kind of position is applied, in the order of application.
_APPLIED = {"range": _in_range, "dotted": _in_range, "these": _these, "others": _others, "one": _these}


@dataclass(frozen=True)
class Part:
    """One narrowing: the nodes that a locator finds below a node, and which of them stay."""

    locate: Locator | None
    positions: tuple[tuple[str, tuple[int, ...]], ...] = ()

    def pick(self, items: list[Any]) -> list[Any]:
        for kind, numbers in self.positions:
            items = _APPLIED[kind](items, [k + len(items) if k < 0 else k for k in numbers])
        return items

    def below(self, node: dom.Node) -> list[Any]:
        return self.pick(self.locate(node) if self.locate else [])


def _locator(text: str) -> Locator:
    """What a part without its positions finds."""
    head, dot, rest = text.partition(".")
    shorthand = {"tag": lambda s: s, "class": lambda s: "".join(f".{name}" for name in s.split()), "id": lambda s: f"#{s}"}
    if text.startswith("xpath:"):
        return lambda n: dom.xpath(n, text[6:])
    if text.startswith(("/", "./")):
        return lambda n: dom.xpath(n, text)
    if text.startswith("text."):
        return lambda n: dom.by_text(n, rest)
    if dot and head.lower() in shorthand:
        text = shorthand[head.lower()](rest)
    found = dom.css(text)
    return found.find


@lru_cache(4096)
def part(text: str) -> Part:
    """Compile a part: positions are taken off its end until what is left is the locator."""
    rest = text.strip()
    path = rest.startswith(("xpath:", "/", "./"))
    held: list[tuple[str, tuple[int, ...]]] = []
    while m := _POSITION.search(rest):
        kind = m.lastgroup or ""
        if (path and kind in ("these", "one")) or kind in dict(held):
            break
        held.append((kind, tuple(int(k) for k in re.split("[,:]", m[kind]))))
        rest = rest[: m.start()].rstrip()
    return Part(_locator(rest) if rest else None, tuple(sorted(held, key=lambda x: _rank(x[0]))))


def _rank(kind: str) -> int:
    return list(_APPLIED).index(kind)


@dataclass(frozen=True)
class Step:
    """Parts one below the other, then perhaps an attribute of what they find."""

    parts: tuple[Part, ...]
    attribute: str
    texts: bool  # keeps strings that an earlier step has found

    def __call__(self, nodes: list[Any]) -> list[Any]:
        if len(self.parts) == 1 and not self.attribute and self.parts[0].locate is None:
            return self.parts[0].pick(nodes)
        out: list[Any] = []
        for n in nodes:
            if not isinstance(n, dom.Node):
                out += [n] if self.texts else []
                continue
            level: list[Any] = [n]
            for p in self.parts:
                level = [y for x in level if isinstance(x, dom.Node) for y in p.below(x)]
            out += [accessor(self.attribute)(x) for x in level] if self.attribute else level
        return out


@lru_cache(4096)
def accessor(name: str) -> Callable[[Any], str]:
    """EXT-16: the value of a node by a name: its text, its markup or one of its attributes."""
    of: Callable[[dom.Node], str]
    if name in ("text", "textNodes"):
        of = dom.Node.text
    elif name == "html":
        of = dom.Node.html
    else:
        of = lambda n: n.attrs.get(name.lower(), "")
    return lambda x: of(x) if isinstance(x, dom.Node) else x


@lru_cache(4096)
def step(text: str, split: Callable[[str, str], list[str]]) -> Step:
    """Compile a step; ``split`` splits a text at a mark outside brackets and quotes."""
    names = [p for p in map(str.strip, split(text, "@")) if p]
    last = names[-1] if names else ""
    named = last in ATTRIBUTES or last.startswith(FAMILIES) or (text.startswith("@") and len(names) == 1)
    return Step(tuple(part(p) for p in (names[:-1] if named else names)), last if named else "", text.strip() in ("text", "@text", "@"))
