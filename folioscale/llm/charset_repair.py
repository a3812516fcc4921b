"""Text decoded with the wrong character encoding (problem 5).

Method: for every pair (true encoding, wrong encoding) the sequences that usual characters turn into
are computed beforehand and put into one multi-pattern automaton. Only lines that hold a character
outside the usual repertoire are searched. Hits say which pairs to try, and every pair with a hit is
tried: the line is encoded back character by character, strictly, and decoded rightly; of the pieces
between common boundaries the maximal stretches whose text becomes clearly more usual replace theirs, if
they hold a hit. What the wrong encoding has no bytes for, and what reads worse than before, is correct text
and stays as it is.

A record is garbled if a stretch of it can be restored, holds U+FFFD, or is dense in garbled
sequences though bytes were lost. Null, empty and blank texts are not garbled. Whole texts are read;
the declared encoding is not used, since it is often untrue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: (true, wrong): how the bytes were written and how they were read. "x2": twice over. Fixed values.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac-roman"), ("utf-8", "x2"),
    ("gb18030", "cp1252"), ("gb18030", "latin-1"), ("gb18030", "cp1251"), ("gb18030", "mac-roman"),
    ("big5", "cp1252"), ("big5", "latin-1"), ("big5", "cp1251"), ("big5", "mac-roman"),
    ("utf-8", "gb18030"), ("utf-8", "big5"), ("gb18030", "big5"), ("big5", "gb18030"),
    ("cp1252", "cp1251"), ("cp1252", "mac-roman"), ("cp1252", "gb18030"), ("cp1252", "big5"), ("mac-roman", "cp1252"), ("cp1251", "cp1252"),
]
ACCENTED = "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßÁÀÂÄÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝŸ"
MARKS = "“”‘’«»–—…·•¿¡°©®™€£§×÷ªº½¼¾¹²³†‡‰‹›\xa0"
WIDE = "，。、；：？！（）《》〈〉【】「」『』“”‘’…—·～￥　"
RUSSIAN = "".join(map(chr, range(0x410, 0x450))) + "Ёё"


def _rows(encoding: str, first: range, second: list[int]) -> str:
    return "".join(c for a in first for b in second if (c := bytes([a, b]).decode(encoding, "ignore")))


@cache
def repertoire() -> dict[str, frozenset[str]]:
    """Character sets built from the encodings' own tables."""
    gb1, gb2 = _rows("gb2312", range(0xB0, 0xD8), list(range(0xA1, 0xFF))), _rows("gb2312", range(0xD8, 0xF8), list(range(0xA1, 0xFF)))
    big = _rows("big5", range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)])
    ascii_ = "".join(map(chr, range(32, 127))) + "\t\n\r"
    symbols = _rows("gb2312", range(0xA1, 0xA4), list(range(0xA1, 0xFF)))
    usual = set(ascii_) | set(gb1) | set(gb2) | set(big) | set(symbols) | set(WIDE) | set("​‌‍⁠﻿\xad")
    western = set("áàâäæçéèêëíîïñóôöœúùûüßÁÀÂÄÆÇÉÈÊËÍÎÏÑÓÔÖŒÚÙÛÜ“”‘’«»–—…·•¿¡©\xa0 ")
    return {k: frozenset(v) for k, v in {"hans": gb1, "hanzi": gb1 + gb2, "hant": big, "plain": set(ascii_) | set(WIDE) | western, "usual": usual | western}.items()}


@cache
def _unusual() -> re.Pattern[str]:
    return re.compile("[^" + re.escape("".join(sorted(repertoire()["usual"]))) + "]")


def garble(text: str, true: str, wrong: str) -> str:
    data = text.encode(true, "ignore")
    if wrong == "x2":
        return _loose(_loose(data).encode("utf-8"))
    return _loose(data) if wrong == "cp1252" else data.decode(wrong, "ignore")


def _loose(data: bytes) -> str:
    """cp1252 with the five unassigned bytes read as C1 controls, as browsers do."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)


def _tight(text: str) -> bytes | None:
    out = bytearray()
    for c in text:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return None
            out.append(ord(c))
    return bytes(out)


def _patterns() -> Iterator[tuple[str, int]]:
    sets = repertoire()
    han, hant = sorted(sets["hanzi"]), sorted(sets["hant"])
    wide = [*han, *hant, *WIDE]
    leads = ["é", "“", "，", *map(chr, (0x4E00, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000))]
    for n, (true, wrong) in enumerate(PAIRS):
        if true == "cp1252" and wrong in ("gb18030", "big5"):
            sources = [a + b for a in ACCENTED + MARKS for b in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        elif true in ("cp1252", "mac-roman"):
            sources = list(ACCENTED + MARKS)
        elif true == "cp1251":
            sources = [a + b for a in RUSSIAN for b in RUSSIAN[32:64]]
        elif true == "utf-8" and wrong in ("gb18030", "big5"):
            sources = [a + b for a in wide + list(MARKS + ACCENTED) for b in leads]
        else:
            sources = wide + (list(ACCENTED + MARKS) if true == "utf-8" else [])
        for s in sources:
            g = garble(s, true, wrong)
            if true == "utf-8" and wrong in ("gb18030", "big5"):
                g = g[:2]
            if g and g != s and _unusual().search(g) and "�" not in g and not (len(g) == 1 and wrong == "x2"):
                yield g, n


@cache
def automaton() -> ahocorasick.Automaton:
    held: dict[str, set[int]] = {}
    for g, n in _patterns():
        held.setdefault(g, set()).add(n)
    found = ahocorasick.Automaton()
    for g, ns in held.items():
        found.add_word(g, (len(g), tuple(ns)))
    found.make_automaton()
    return found


@lru_cache(200_000)
def _bytes(c: str, wrong: str) -> bytes | None:
    """The bytes that were read as this character; None where the wrong encoding has no such character."""
    if c == "�":
        return b"?"  # a byte that was lost
    if wrong in ("cp1252", "latin-1"):
        return _tight(c)
    try:
        return c.encode(wrong)
    except UnicodeEncodeError:
        return None


@lru_cache(200_000)
def _size(c: str, true: str) -> int:
    return len(c.encode(true, "surrogateescape"))


def _unread(bad: str) -> bool:
    return "\udc80" <= bad <= "\udcff"


UNREAD = re.compile("[\udc80-\udcff]+")


def aligned(text: str, true: str, wrong: str) -> list[tuple[str, str | None]]:
    """The text in shortest pieces, each with what its bytes are in the true encoding.

    None where a character has no bytes in the wrong encoding; bytes that are no text come as lone surrogates.
    """
    if wrong == "x2":
        return _composed(aligned(text, "utf-8", "cp1252"))
    out: list[tuple[str, str | None]] = []
    run: list[tuple[str, bytes]] = []

    def flush() -> None:
        if not run:
            return
        new = b"".join(b for _, b in run).decode(true, "surrogateescape")
        sizes = [_size(c, true) for c in new]
        if sum(sizes) != sum(len(b) for _, b in run):  # an encoding with two spellings of one character
            out.append(("".join(c for c, _ in run), None))
            run.clear()
            return
        a = b = place = other = start = begin = 0
        while a < len(run):
            place += len(run[a][1])
            a += 1
            while b < len(new) and other + sizes[b] <= place:
                other += sizes[b]
                b += 1
            if other == place:
                out.append(("".join(c for c, _ in run[start:a]), new[begin:b]))
                start, begin = a, b
        run.clear()

    for c in text:
        got = _bytes(c, wrong)
        if got is None:
            flush()
            out.append((c, None))
        else:
            run.append((c, got))
    flush()
    return out


def _composed(first: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """What was read wrongly twice: the pieces of the first reading read once more."""
    out: list[tuple[str, str | None]] = []
    held: list[tuple[str, str]] = []

    def flush() -> None:
        if not held:
            return
        at = used = 0
        start = 0
        for old, new in aligned("".join(n for _, n in held), "utf-8", "cp1252"):
            used += len(old)
            piece = ""
            reach = sum(len(n) for _, n in held[:start])
            while start < len(held) and reach + len(held[start][1]) <= used:
                piece += held[start][0]
                reach += len(held[start][1])
                start += 1
            out.append((piece, new)) if reach == used else out.append((piece, None))
            at = used
        if start < len(held):
            out.append(("".join(o for o, _ in held[start:]), None))
        held.clear()

    for old, new in first:
        if new is None or any(map(_unread, new)):
            flush()
            out.append((old, None))
        else:
            held.append((old, new))
    flush()
    return out


def oddness(text: str) -> float:
    """How far from usual text, per character: 1 for each unusual character, part of it for hanzi beyond the first level of one script."""
    sets = repertoire()
    usual, plain, hans, hant = sets["usual"], sets["plain"], sets["hans"], sets["hant"]
    odd = simple = full = neither = 0
    for c in text:
        if c in plain:
            continue
        if c not in usual:
            odd += 1
        elif c in hans:
            simple += 1
            full += c in hant
        elif c in hant:
            full += 1
        else:
            neither += 1
    return odd + 0.5 * neither + 0.5 * (max(0, simple + _count(text, hant, hans) - max(simple, full)))


def _count(text: str, inside: frozenset[str], outside: frozenset[str]) -> int:
    return sum(c in inside and c not in outside for c in text)


LATIN_WORD = re.compile(r"[A-Za-zÀ-ÿœŒ’'√Ѐ-ӿ]+")
#: Words rightly written in other scripts: capital and small letters in their order, or kana.
FOREIGN = re.compile("(?<![A-Za-zÀ-ÿЀ-ӿ])(?:[А-ЯЁ]?[а-яё]{2,}|[Α-Ω]?[ά-ώ]{2,})(?![A-Za-zÀ-ÿЀ-ӿ])|[ぁ-ヿ]{2,}")
#: Such a word of Cyrillic letters between spaces, which no sentence of another script turns into.
APART = re.compile(r"(?<![^\s\"'(«“,.!?;:—-])[А-ЯЁ]?[а-яё]{3,}(?![^\s\"')»”,.!?;:—-])")


@cache
def _weights(full: bool) -> dict[str, float]:
    """Oddness of single characters beside simplified or, if full, traditional ones; 1 for any that is missing."""
    sets = repertoire()
    first, second = ("hant", "hans") if full else ("hans", "hant")
    out = {c: 0.5 for c in sets["usual"]}
    out |= {c: 0.25 for c in sets[second]}
    return out | {c: 0.0 for c in sets[first] | sets["plain"]}


#: A Han character within a word of letters.
GRAFTED = re.compile("[A-Za-zÀ-ÿ][一-鿿]|[一-鿿][a-zà-ÿ]")
DOUBLE = ("gb18030", "big5")


def _barred(line: str, true: str, wrong: str) -> set[int]:
    """Places of characters that stand rightly in another script, whatever they could be read as."""
    words = list(APART.finditer(line)) if true != "cp1251" else []
    if wrong == "cp1251" and true in ("cp1252", "mac-roman"):  # a word garbled so holds letters of both scripts, or is one letter between Latin words
        every = list(LATIN_WORD.finditer(line))
        latin = [re.search("[A-Za-z]", m[0]) is not None for m in every]
        single = [len(m[0]) == 1 and all(latin[max(0, k - 1) : k] + latin[k + 1 : k + 2]) for k, m in enumerate(every)]
        words += [m for m, a, b in zip(every, latin, single) if not a and not b]
    return {k for m in words for k in range(*m.span())}


def stretches(line: str, pair: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, text, gain): the stretches of the line that are clearly more usual text when read as this pair.

    hits: (start, end) of the pair's garbled sequences; a stretch holds one at least.
    """
    true, wrong = PAIRS[pair]
    lost = 0.2 if true == "utf-8" else 2.0  # UTF-8 is hardly ever valid by chance, so lost bytes count little there
    barred = _barred(line, true, wrong)
    weights, after_weights = _weights(False), _weights(true == "big5")
    if true == "cp1251":
        after_weights = after_weights | dict.fromkeys(RUSSIAN, 0.0)
    places: list[tuple[int, int, str, float]] = []
    at = 0
    runs: list[list[tuple[int, int, str, str, float]]] = [[]]
    for old, new in aligned(line, true, wrong):
        end = at + len(old)
        if new is None or (barred and not barred.isdisjoint(range(at, end))):
            runs.append([])
        else:
            gain = 0.0
            if old != new:
                gain = sum(weights.get(c, 1.0) for c in old) - sum(lost if _unread(c) else after_weights.get(c, 1.0) for c in new)
            runs[-1].append((at, end, old, new, gain))
        at = end
    for run in runs:
        done = 0
        for low, high in maximal([r[-1] for r in run]):
            # what reads as usual either way goes with its neighbours, as far as it changes at all
            while low > done and run[low - 1][-1] >= 0:
                low -= 1
            while high < len(run) and run[high][-1] >= 0:
                high += 1
            while run[low][2] == run[low][3]:
                low += 1
            while run[high - 1][2] == run[high - 1][3]:
                high -= 1
            start, end = run[low][0], run[high - 1][1]
            done = high
            if not any(a < end and b > start for a, b in hits):
                continue
            new, old = UNREAD.sub("�", "".join(r[3] for r in run[low:high])), line[start:end]
            gone = new.count("�")
            if not new.strip() or gone > (0.4 if true == "utf-8" else 0.15) * len(new):
                continue
            around = line[max(0, start - 1) : start], line[end : end + 1]
            before = oddness(old)
            shown = new.replace("�", "").replace("?", "") if true == "utf-8" else new.replace("�", "")
            after = oddness("".join(c for c in shown if c not in RUSSIAN) if true == "cp1251" else shown) + (0.0 if true == "utf-8" else 2.0 * gone) + 0.5 * len(GRAFTED.findall(around[0] + new + around[1]))
            if true in DOUBLE and wrong in DOUBLE and (len(old) < 4 or before - after < 1.5):  # nearly all such text can be read either way
                continue
            if after <= 0.3 * before:
                places.append((start, end, new, before - after))
    return places


def maximal(gains: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches of positive sum, disjoint, none of which grows by going on."""
    held: list[tuple[float, float, int, int]] = []  # sums before and through, first, behind the last
    total = 0.0
    for i, g in enumerate(gains):
        before, total = total, total + g
        if g <= 0:
            continue
        new = (before, total, i, i + 1)
        while True:
            j = next((k for k in range(len(held) - 1, -1, -1) if held[k][0] < new[0]), -1)
            if j < 0 or held[j][1] >= new[1]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(a, b) for _, _, a, b in held]


def repair_line(line: str) -> tuple[str, bool]:
    """The line with its garbled stretches restored, and whether it holds any (restorable or not)."""
    new, bad = _repair_once(line)
    if new != line:  # what was garbled twice over shows as garbled again
        new = _repair_once(new, {p for p, (true, _) in enumerate(PAIRS) if true == "utf-8"})[0]
    return new, bad


def _repair_once(line: str, only: set[int] | None = None) -> tuple[str, bool]:
    unusual = len(_unusual().findall(line))
    if not unusual or not _unusual().search(FOREIGN.sub("", line)):
        return line, False
    lossy = "�" in line
    hits: dict[int, list[tuple[int, int]]] = {}
    covered = 0
    for end, (size, pairs) in automaton().iter(line):
        covered += size
        for p in pairs if only is None else only.intersection(pairs):
            hits.setdefault(p, []).append((end - size + 1, end + 1))
    if not hits:
        return line, lossy or bool(re.search("[\x80-\x9f]", line))
    ends = [k for k, c in enumerate(line) if c not in repertoire()["usual"]]
    found = []
    for p, own in sorted(hits.items(), key=lambda x: (-sum(b - a for a, b in x[1]), x[0])):
        got = stretches(line, p, own)
        found += got
        if any(start <= ends[0] and end > ends[-1] and oddness(new) <= 0.02 * len(new) for start, end, new, _ in got):
            break  # nothing is left to explain
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[:3]))
    taken: list[tuple[int, int, str]] = []
    for start, end, new, _ in found:  # the best reading of each stretch
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, new))
    if taken:
        out, at = [], 0
        for start, end, new in sorted(taken):
            out += [line[at:start], new]
            at = end
        return "".join([*out, line[at:]]), True
    letters = sum(not c.isascii() and not c.isspace() for c in line)
    dense = unusual >= 8 and unusual >= 0.25 * letters and covered >= 0.25 * letters
    return line, lossy or dense


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text, garbled?) of a whole text; line ends are kept."""
    if not text or not _unusual().search(text):
        return text, False
    out, found = [], False
    for line in text.split("\n"):
        new, bad = repair_line(line)
        out.append(new)
        found |= bad
    return "\n".join(out), found


def _run(restore: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new, bad = repair(text)
                if bad:
                    keys.append(key)
                    texts.append(new)
            cols = {"key": pa.array(keys, b.schema.field(0).type)} | ({"text": pa.array(texts, pa.string())} if restore else {})
            yield pa.RecordBatch.from_pydict(cols)

    return run


def garbled(df: DataFrame, key: str, text: str, restore: bool = False) -> DataFrame:
    """The garbled records: (key), or (key, text) with the text restored as far as it can be."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").mapInArrow(_run(restore), f"key {kind}" + (", text string" if restore else ""))
    return out.withColumnRenamed("key", key)
