"""Evaluation texts that leaked into training text (problem 9).

Method: spaced-seed hashing. Texts become tokens (words of alphabetic scripts, single characters of
Chinese; case, spacing and punctuation gone). Fixed masks pick some positions of each window and
ignore the rest, so that a window still matches where an ignored token was replaced. The hashes of
the test side are probed by every window of every training text; around the hits of a pair the
diagonals are compared token by token, stretches that tolerate scattered replacements are put in
order, and their share of the item is the evidence.

The test side is broadcast in blocks of at most ``block_tokens`` tokens, whatever its size; every
block is matched against all documents in a pass of its own. Nothing is shuffled, so neither a
repeated document nor a repeated item gathers anywhere. An item too short for the shortest mask (five
words, ten Han characters) is looked for whole, by windows of its own length. Null and empty texts, and
texts without a letter or digit, match nothing. Repeated rows give repeated results.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Positions that a window compares. Fixed values; the zeros forgive one replaced word.
MASKS_HAN = ["1111111111", "111110011111", "111100111111", "11111100001111"]
MASKS_WORD = ["11111", "1101011", "1110011", "1011101"]
#: Characters of text that are worked on at a time.
SLICE_CHARS = 400_000
FILTER_BITS = 22
_odd = np.random.default_rng(9).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its comparable form, and its kind: 0 no token, 1 part of a word, 2 a token."""
    fold = np.arange(0x110000, dtype=np.uint32)
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        if s.isalnum():
            kind[c] = 1
            low = s.lower()
            if len(low) == 1:
                fold[c] = ord(low)
    full = np.arange(0xFF01, 0xFF5F)
    fold[full] = fold[full - 0xFEE0]
    kind[full] = kind[full - 0xFEE0]
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000), (0x3040, 0x3100)):
        kind[a:b] = 2
    return fold, kind


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, the text of each, and whether it is a single Han character."""
    fold, kinds = tables()
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    code = fold[code]
    kind = kinds[code]
    word = kind == 1
    start = kind == 2
    start[0] |= word[0]
    start[1:] |= word[1:] & ~word[:-1]
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.arange(len(code)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(code)]])))
    part = np.where(kind > 0, (code.astype(np.uint64) + np.uint64(1)) * _odd[at % 64], np.uint64(0))
    return mix(np.add.reduceat(part, begin)), np.searchsorted(ends, begin, "right"), kind[begin] == 2


def windows(tok: np.ndarray, text: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window that lies within one text."""
    n, size = len(tok), len(mask)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n - size + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h += tok[k : n - size + 1 + k] * _odd[64 + k]
    inside = text[: n - size + 1] == text[size - 1 :]
    return np.flatnonzero(inside), mix(h)[inside]


class Tests:
    """The test side: tokens of the items and the sorted hashes of their windows."""

    def __init__(self, ids: list[int], texts: list[str]):
        tok, text, han = tokens(texts)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        self.ids, self.tok = ids, [tok[a:b] for a, b in zip(cut, cut[1:])]
        self.han = [bool(len(h)) and h.mean() > 0.5 for h in (han[a:b] for a, b in zip(cut, cut[1:]))]
        self.masks: list[tuple[bool, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for is_han, masks in ((True, MASKS_HAN), (False, MASKS_WORD)):
            own = [i for i, h in enumerate(self.han) if h == is_han and len(self.tok[i])]
            if not own:
                continue
            flat = np.concatenate([self.tok[i] for i in own])
            item = np.repeat(np.array(own), [len(self.tok[i]) for i in own])
            first = np.repeat(np.cumsum([0, *[len(self.tok[i]) for i in own]])[:-1], [len(self.tok[i]) for i in own])
            sizes = np.repeat([len(self.tok[i]) for i in own], [len(self.tok[i]) for i in own])
            shortest = min(map(len, masks))
            for mask in [*masks, *("1" * n for n in sorted({int(n) for n in sizes if n < shortest}))]:
                at, h = windows(flat, item, mask)
                if len(mask) < shortest:  # whole items only
                    whole = sizes[at] == len(mask)
                    at, h = at[whole], h[whole]
                by = np.argsort(h, kind="stable")
                sieve = np.zeros(1 << FILTER_BITS, bool)
                sieve[h >> np.uint64(64 - FILTER_BITS)] = True
                self.masks.append((is_han, mask, h[by], item[at][by], (at - first[at])[by], sieve))

    def hits(self, tok: np.ndarray, text: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text, item) -> [(place in the item, place in all tokens)]."""
        found: dict[tuple[int, int], list] = defaultdict(list)
        for _, mask, hashes, items, places, sieve in self.masks:
            at, h = windows(tok, text, mask)
            maybe = sieve[h >> np.uint64(64 - FILTER_BITS)]
            at, h = at[maybe], h[maybe]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for a, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                t = int(text[a])
                for j in range(x, y):
                    found[t, int(items[j])].append((int(places[j]), a))
        return found


def stretches(same: np.ndarray, gap: int, least: int, density: float) -> list[tuple[int, int]]:
    """Runs of matching places that tolerate up to ``gap`` others in between."""
    at = np.flatnonzero(same)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > gap + 1)
    first = np.concatenate([[0], breaks + 1])
    last = np.concatenate([breaks, [len(at) - 1]])
    size = at[last] - at[first] + 1
    good = (size >= least) & ((last - first + 1) >= density * size)
    return [(int(a), int(b) + 1) for a, b in zip(at[first[good]], at[last[good]])]


def coverage(item: np.ndarray, doc: np.ndarray, hits: list[tuple[int, int]], han: bool) -> float:
    """Share of the item that stands in the document, in the item's order."""
    n = len(item)
    gap, least = (4, min(n, 10)) if han else (2, min(n, 6))
    parts = []
    for diagonal in {d - i for i, d in hits}:
        lo, hi = max(0, -diagonal), min(n, len(doc) - diagonal)
        if hi > lo:
            parts += [(a + lo, b + lo, diagonal) for a, b in stretches(item[lo:hi] == doc[lo + diagonal : hi + diagonal], gap, least, 0.6)]
    parts.sort(key=lambda p: (p[1], p[1] + p[2]))
    best: list[int] = []
    for k, (a, b, d) in enumerate(parts):
        most = b - a
        for j in range(k):
            a0, b0, d0 = parts[j]
            cut = max(a, b0, b0 + d0 - d)  # the part that comes after the earlier one in both texts
            if cut < b:
                most = max(most, best[j] + b - cut)
        best.append(most)
    return max(best, default=0) / n if n else 0.0


#: The test side of this worker process, by the name of its block.
_sides: dict[str, Tests] = {}


def _run(name: str, tests, min_share: float):
    def emit(side: Tests, keys: list, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        tok, text, _ = tokens(texts)
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        for (t, i), hits in side.hits(tok, text).items():
            reach = 14 if side.han[i] else 7
            if len({p // reach for p, _ in hits}) * 3 * reach < min_share * len(side.tok[i]):
                continue  # too few places of the item are near a hit
            a, b = first[t], first[t + 1]
            share = coverage(side.tok[i], tok[a:b], [(p, d - a) for p, d in hits], side.han[i])
            if share >= min_share:
                yield side.ids[i], keys[t], share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if name not in _sides:
                _sides.clear()
                _sides[name] = Tests(*tests.value)
            side = _sides[name]
            keys, texts, out, low, held = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= SLICE_CHARS or i == len(texts) - 1:
                    out += emit(side, keys[low : i + 1], texts[low : i + 1])
                    low, held = i + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["item_id", "doc_id", "share"])

    return run


def leaked(docs: DataFrame, doc_id: str, text: str, tests: DataFrame, item_id: str, item_text: str, min_share: float = 0.5, block_tokens: int = 400_000) -> DataFrame:
    """(item_id, doc_id, share): documents that hold at least ``min_share`` of an item."""
    spark = docs.sparkSession
    ship(spark)
    side = docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    out, ids, texts, held = None, [], [], 0

    def block(ids: list[int], texts: list[str]) -> DataFrame:
        return side.mapInArrow(_run(uuid.uuid4().hex, spark.sparkContext.broadcast((ids, texts)), min_share), "item_id bigint, doc_id bigint, share double")

    for r in tests.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).where("t is not null").toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"])
        if held >= block_tokens:
            got = block(ids, texts)
            out = got if out is None else out.unionByName(got)
            ids, texts, held = [], [], 0
    if ids or out is None:
        got = block(ids, texts)
        out = got if out is None else out.unionByName(got)
    return out
