"""A lenient HTML tree with selectors, on the standard library only (EXT-08, EXT-11 to EXT-16)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag on the left closes an open one of those on the right.
CLOSES = {
    "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    **dict.fromkeys(["p", "div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form"], {"p"}),
}
#: Open elements that shield what they hold from being closed by CLOSES.
SHIELDS = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            else:
                stack += reversed(n.children)

    def text(self) -> str:
        return squash("".join(self.strings()))

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def html(self) -> str:
        """The markup of the element; a stack instead of recursion, since pages may nest without end."""
        out: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(self, True)]  # (node or text ready to write, still to be opened)
        while stack:
            n, opening = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "#root" and opening:
                stack += [(c if isinstance(c, Node) else escape(c, quote=False), True) for c in reversed(n.children)]
            elif opening:
                out.append(f"<{n.tag}{''.join(f' {k}={chr(34)}{escape(v)}{chr(34)}' for k, v in n.attrs.items())}>")
                if n.tag not in VOID:
                    raw = n.tag in ("script", "style")
                    stack.append((n, False))
                    stack += [(c if isinstance(c, Node) or raw else escape(c, quote=False), True) for c in reversed(n.children)]
            else:
                out.append(f"</{n.tag}>")
        return "".join(out)


def squash(text: str) -> str:
    """STR-01: entities resolved, every run of white space one space, ends stripped."""
    return " ".join(unescape(text).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closed = CLOSES.get(tag, ())
        n, shield = self.at, SHIELDS.get(tag, {"div", "td", "li", "section", "article", "body"} if tag not in ("p",) else {"div", "td", "li", "section", "article", "body"})
        while closed and n.parent is not None:
            if n.tag in closed:
                self.at = n.parent
                break
            if n.tag in shield:
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


# --- CSS ---------------------------------------------------------------------------------------

Test = Callable[[Node], bool]
_NAME = r"[\w\u0080-￿-]+"
_SIMPLE = re.compile(rf"\*|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]]*?)\s*)?\]|:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\))?[^()]*)\))?|(?P<tag>{_NAME})")


def _attr_test(name: str, op: str | None, value: str | None) -> Test:
    v = (value or "").strip()
    v = v[1:-1] if v[:1] in "\"'" and v[:1] == v[-1:] and len(v) > 1 else v
    tests: dict[str | None, Callable[[str], bool]] = {
        None: lambda a: True, "=": lambda a: a == v, "!=": lambda a: a != v, "~=": lambda a: v in a.split(), "|=": lambda a: a == v or a.startswith(v + "-"),
        "^=": lambda a: bool(v) and a.startswith(v), "$=": lambda a: bool(v) and a.endswith(v), "*=": lambda a: bool(v) and v in a,
    }
    test = tests[op]
    return lambda n: name in n.attrs and test(n.attrs[name])


def _nth(arg: str) -> Callable[[int], bool]:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip(), arg.replace(" ", ""))
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not m:
        raise ValueError(f"nth: {arg}")
    if m[3]:
        return lambda k: k == int(m[3])
    a, b = int({"": "1", "+": "1", "-": "-1"}.get(m[1], m[1])), int(m[2] or 0)
    return lambda k: (k - b) % a == 0 and (k - b) // a >= 0 if a else k == b


def _pseudo(name: str, arg: str | None) -> Test:
    def place(n: Node, same: bool = False, back: bool = False) -> int:
        around = [c for c in n.parent.elements() if not same or c.tag == n.tag] if n.parent else [n]
        k = next(i for i, c in enumerate(around) if c is n)
        return len(around) - k if back else k + 1

    if name == "not":
        inner = css(arg or "*")
        return lambda n: not any(t(n) for t in inner.tests)
    if name in ("contains", "-soup-contains"):
        word = (arg or "").strip().strip("\"'")
        return lambda n: word in n.text()
    if name == "has":
        inner = css(arg or "*")
        return lambda n: bool(inner.find(n))
    if name == "empty":
        return lambda n: not n.children
    fixed = {"first-child": ("1", 0, 0), "last-child": ("1", 0, 1), "first-of-type": ("1", 1, 0), "last-of-type": ("1", 1, 1)}
    kinds = {"nth-child": (0, 0), "nth-last-child": (0, 1), "nth-of-type": (1, 0), "nth-last-of-type": (1, 1)}
    if name in fixed:
        a, same, back = fixed[name]
    elif name in kinds:
        a, (same, back) = arg or "", kinds[name]
    else:
        raise ValueError(f"pseudo-class {name}")
    fits = _nth(a)
    return lambda n: fits(place(n, bool(same), bool(back)))


def _compound(text: str) -> Test:
    tests: list[Test] = []
    pos = 0
    while pos < len(text):
        m = _SIMPLE.match(text, pos)
        if not m:
            raise ValueError(f"selector {text!r}")
        if m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            tests.append(_attr_test(m["attr"].lower(), m["op"], m["val"]))
        elif m["pseudo"]:
            tests.append(_pseudo(m["pseudo"], m["arg"]))
        elif m["tag"]:
            tests.append(lambda n, v=m["tag"].lower(): n.tag == v)
        pos = m.end()
    return lambda n: all(t(n) for t in tests)


def _outside(text: str, marks: str) -> list[tuple[str, str]]:
    """(mark before, part) of a text split at marks that stand outside of brackets and quotes."""
    parts, depth, quote, mark, part = [], 0, "", "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if not quote and not depth and c in marks:
            parts.append((mark, part))
            mark, part = c, ""
        else:
            part += c
    return [*parts, (mark, part)]


class Css:
    def __init__(self, text: str):
        self.tests = [self._complex(p.strip()) for _, p in _outside(text, ",") if p.strip()]

    def _complex(self, text: str) -> Test:
        steps: list[tuple[str, Test]] = []
        how = ""
        for mark, part in _outside(re.sub(r"\s*([>+~])\s*(?![^\[]*\])", r"\1", text), " >+~\t\n"):
            how = mark.strip() or how or (" " if mark else "")
            if part.strip():
                steps.append((how, _compound(part.strip())))
                how = ""

        def fits(n: Node, k: int) -> bool:
            if not steps[k][1](n):
                return False
            if k == 0:
                return True
            how = steps[k][0]
            if how == ">":
                return n.parent is not None and fits(n.parent, k - 1)
            if how in "+~":
                before = []
                for c in n.parent.elements() if n.parent else []:
                    if c is n:
                        break
                    before.append(c)
                return any(fits(c, k - 1) for c in (before[-1:] if how == "+" else before))
            up = n.parent
            while up is not None:
                if fits(up, k - 1):
                    return True
                up = up.parent
            return False

        return lambda n: fits(n, len(steps) - 1)

    def find(self, node: Node) -> list[Node]:
        return [n for n in node.walk() if any(t(n) for t in self.tests)]


@lru_cache(4096)
def css(text: str) -> Css:
    return Css(text)


# --- XPath -------------------------------------------------------------------------------------

_STEP = re.compile(r"(//|/)?\s*(@[\w:*-]+|text\(\)|string\(\)|\.\.|\.|\*|[\w-]+)((?:\[[^\[\]]*(?:\[[^\[\]]*\])?[^\[\]]*\])*)")


def _predicate(text: str, nodes: list[Node]) -> list[Node]:
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return nodes[int(text) - 1 : int(text)]
    m = re.fullmatch(r"last\(\)(?:\s*-\s*(\d+))?", text)
    if m:
        k = len(nodes) - 1 - int(m[1] or 0)
        return nodes[k : k + 1] if k >= 0 else []
    m = re.fullmatch(r"position\(\)\s*(<=|>=|<|>|=)\s*(\d+)", text)
    if m:
        k = int(m[2])
        ops = {"<": lambda p: p < k, ">": lambda p: p > k, "<=": lambda p: p <= k, ">=": lambda p: p >= k, "=": lambda p: p == k}
        return [n for p, n in enumerate(nodes, 1) if ops[m[1]](p)]
    for word, both in ((" and ", all), (" or ", any)):
        parts = re.split(rf"{word}(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", text)
        if len(parts) > 1:
            sets = [{id(n) for n in _predicate(p, nodes)} for p in parts]
            return [n for n in nodes if both(id(n) in s for s in sets)]
    m = re.fullmatch(r"not\((.*)\)", text)
    if m:
        out = {id(n) for n in _predicate(m[1], nodes)}
        return [n for n in nodes if id(n) not in out]

    def value(n: Node, what: str) -> str | None:
        what = what.strip()
        if what.startswith("@"):
            return n.attrs.get(what[1:].lower())
        return n.text() if what in (".", "text()", "string()", "normalize-space(.)", "normalize-space()", "string(.)") else next((c.text() for c in n.elements() if c.tag == what), None)

    m = re.fullmatch(r"(contains|starts-with)\(\s*([^,]+?)\s*,\s*(['\"])(.*)\3\s*\)", text)
    if m:
        return [n for n in nodes if (v := value(n, m[2])) is not None and (m[4] in v if m[1] == "contains" else v.startswith(m[4]))]
    m = re.fullmatch(r"(.+?)\s*(!?=)\s*(['\"])(.*)\3", text)
    if m:
        return [n for n in nodes if (v := value(n, m[1])) is not None and (v == m[4]) == (m[2] == "=")]
    return [n for n in nodes if value(n, text) is not None]


def xpath(node: Node, text: str) -> list[Node | str]:
    """Child and descendant steps, positions, attribute and text tests, unions."""
    if "|" in text:
        seen: list[Node | str] = []
        for _, p in _outside(text, "|"):
            seen += [x for x in xpath(node, p.strip()) if x not in seen]
        return seen
    text = text.strip()
    text = (text[1:] if text.startswith((".//", "./")) else text).rstrip("/")
    current: list[Node | str] = [node]
    pos = 0
    while pos < len(text):
        m = _STEP.match(text, pos)
        if not m:
            raise ValueError(f"xpath {text!r}")
        deep, name = m[1] == "//", m[2]
        out: list[Node | str] = []
        for n in current:
            if isinstance(n, str):
                continue
            if name.startswith("@"):
                out += [x.attrs[name[1:].lower()] for x in ([n, *n.walk()] if deep else [n]) if name[1:].lower() in x.attrs]
            elif name == "text()":
                out += [c for x in ([n, *n.walk()] if deep else [n]) for c in x.children if isinstance(c, str)]
            elif name == "string()":
                out.append("".join(n.strings()))
            elif name == ".":
                out.append(n)
            elif name == "..":
                out += [n.parent] if n.parent else []
            else:
                for holder in [n, *n.walk()] if deep else [n]:
                    found: list = [c for c in holder.elements() if name in ("*", c.tag)]
                    for p in re.findall(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]", m[3]):
                        found = _predicate(p, found)
                    out += found
        ids: set[int] = set()
        current = [x for x in out if isinstance(x, str) or not (id(x) in ids or ids.add(id(x)))]
        pos = m.end()
    return current


def by_text(node: Node, word: str) -> list[Node]:
    """Elements with a link whose text holds the word, or else any such element (EXT-13)."""
    word = word.strip()
    if not word:
        return []
    found = [n for n, text in _texts(node) if word in squash(text)]
    return [n for n in found if "href" in n.attrs] or found


def _texts(node: Node) -> Iterator[tuple[Node, str]]:
    """Each element below with its text: one pass writes all strings, elements know their ranges."""
    parts: list[str] = []
    spans: dict[int, list[int]] = {}
    order: list[Node] = []
    stack: list[tuple[Node | str, bool]] = [(c, True) for c in reversed(node.children)]
    at = 0
    while stack:
        n, opening = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            at += len(n)
        elif opening:
            order.append(n)
            spans[id(n)] = [at, at]
            stack.append((n, False))
            stack += [(c, True) for c in reversed(n.children)]
        else:
            spans[id(n)][1] = at
    whole = "".join(parts)
    for n in order:
        low, high = spans[id(n)]
        yield n, whole[low:high]
