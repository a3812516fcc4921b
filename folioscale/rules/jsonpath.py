"""JSON paths over parsed values (EXT-09, EXT-10): members, positions, slices, unions, wildcards,
recursive descent and comparisons."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

_TOKEN = re.compile(r"(?P<deep>\.\.)?(?:\.?(?P<name>[^.\[\]'\"\s*]+)|\.?(?P<star>\*)|\[\s*(?P<inside>(?:'[^']*'|\"[^\"]*\"|[^\[\]'\"]|\[[^\]]*\])+)\s*\])")
_FILTER = re.compile(r"\?\(\s*@\.?(?P<path>[\w.\[\]]*)\s*(?:(?P<op>==|!=|<=|>=|<|>|=~)\s*(?P<value>.+?))?\s*\)")


def _literal(text: str) -> Any:
    text = text.strip()
    if text[:1] in "\"'":
        return text[1:-1]
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    return float(text) if re.fullmatch(r"-?\d+(\.\d+)?", text) else text


def _deep(node: Any) -> list[Any]:
    out = [node]
    for v in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        out += _deep(v)
    return out


def _inside(node: Any, text: str) -> list[Any]:
    m = _FILTER.fullmatch(text)
    if m:
        kept = []
        for v in node if isinstance(node, list) else node.values() if isinstance(node, dict) else ():
            got = find(v, m["path"]) if m["path"] else [v]
            if not m["op"]:
                ok = bool(got)
            else:
                want = _literal(m["value"])
                ok = any(_compare(x, m["op"], want) for x in got)
            if ok:
                kept.append(v)
        return kept
    if text == "*":
        return list(node.values()) if isinstance(node, dict) else list(node) if isinstance(node, list) else []
    m = re.fullmatch(r"(-?\d*):(-?\d*)(?::(-?\d+))?", text)
    if m:
        return node[slice(*(int(x) if x else None for x in m.groups()))] if isinstance(node, list) else []
    out = []
    for part in re.findall(r"'[^']*'|\"[^\"]*\"|[^,\s]+", text):
        key = _literal(part)
        if isinstance(node, list) and isinstance(key, float):
            k = int(key)
            out += [node[k]] if -len(node) <= k < len(node) else []
        elif isinstance(node, dict) and str(part).strip("\"'") in node:
            out.append(node[str(part).strip("\"'")])
    return out


def _compare(a: Any, op: str, b: Any) -> bool:
    if isinstance(b, float) and isinstance(a, (int, float)) and not isinstance(a, bool):
        a = float(a)
    try:
        return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "=~": lambda: re.search(str(b).strip("/"), str(a)) is not None}[op]()
    except TypeError:
        return False


@lru_cache(4096)
def _tokens(path: str) -> tuple:
    text, out, pos = path.strip().removeprefix("$").removeprefix("@"), [], 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"path {path!r}")
        out.append((bool(m["deep"]), m["name"], m["star"], m["inside"]))
        pos = m.end()
    return tuple(out)


def find(node: Any, path: str) -> list[Any]:
    """All values at the path; a bare name is a member of the root."""
    current = [node]
    for deep, name, star, inside in _tokens(path):
        out: list[Any] = []
        for n in current:
            for x in _deep(n) if deep else [n]:
                if inside is not None:
                    out += _inside(x, inside)
                elif star:
                    out += _inside(x, "*")
                elif isinstance(x, dict) and name in x:
                    out.append(x[name])
                elif isinstance(x, list) and re.fullmatch(r"-?\d+", name) and -len(x) <= int(name) < len(x):
                    out.append(x[int(name)])
        current = out
    return current
