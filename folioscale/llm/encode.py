"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 8).

Method: forced-boundary splitting. A pair of neighbouring bytes that stands inside no token of the
vocabulary can never be merged across, so it marks a certain cut. Texts are cut there and at the
pretokenizer's boundaries, the short fragments are encoded on their own (each distinct fragment
once), and the ids are put together again. Everything but the encoding of distinct fragments is
done on whole batches at once.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of text that are worked on at a time.
SLICE_BYTES = 3_000_000
#: White_Space of Unicode.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pretokenizer takes together with their apostrophe. Fixed values.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, OTHER, SPACE = range(4)


def default_vocabulary() -> str:
    return os.path.join(os.environ.get("FOLIOSCALE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Encoder:
    """Encodes batches of texts; keeps what it learnt about fragments."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.inside = np.zeros((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.inside[a, b] = True
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.kind = np.full(0x110000, OTHER, np.uint8)
        category = unicodedata.category
        major = {"L": LETTER, "N": NUMBER}
        self.kind[:] = np.fromiter((major.get(category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        self.kind[SPACES] = SPACE
        self.known: dict[object, int] = {}
        self.store = np.zeros(1 << 16, np.int32)
        self.spans = np.zeros((1 << 12, 2), np.int64)
        self.used = 0

    def merge(self, fragment: bytes) -> list[int]:
        """Plain byte-pair merging: the adjacent pair of lowest rank first, leftmost on ties.

        Pairs wait in a heap and parts are linked, so a fragment of n bytes takes n log n steps.
        """
        ranks = self.ranks
        if fragment in ranks:
            return [ranks[fragment]]
        n = len(fragment)
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 for a part merged into another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(fragment[i : end[stop]])
                if r is not None:
                    heappush(heap, (r, i, end[stop]))
            k = before[i]
            if k >= 0:
                r = ranks.get(fragment[k:stop])
                if r is not None:
                    heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[fragment[i : end[i]]])
            i = end[i]
        return out

    def _number(self, key: object, fragment: bytes) -> int:
        n = self.known.get(key)
        if n is None:
            ids = self.merge(fragment)
            if len(self.known) + 1 > len(self.spans):
                self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
            while self.used + len(ids) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            n = self.known[key] = len(self.known)
            self.store[self.used : self.used + len(ids)] = ids
            self.spans[n] = self.used, len(ids)
            self.used += len(ids)
        return n

    def _forget(self) -> None:
        """Keep the memory of fragments bounded."""
        if len(self.known) > 2_000_000:
            self.known.clear()
            self.used = 0

    def pieces(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the pretokenizer's pieces start. first: where a text starts."""
        n = len(code)
        kind = self.kind[code]
        run = first.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])  # the last of a run of spaces before other text
        start[last] = True
        start[last[code[last] == 0x20] + 1] = False
        quote = np.flatnonzero((code[:-1] == 0x27) & run[:-1] & start[:-1] & (kind[1:] == LETTER) & ~first[1:])
        for p in quote.tolist():
            for e in ENDINGS:
                q = p + 1 + len(e)
                if q <= n and all(code[p + 1 + i] == ord(c) for i, c in enumerate(e)) and not first[p + 1 : q].any():
                    start[p + 1] = False
                    if q < n:
                        start[q] = True
                    break
        return start

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each character starts
        ends = np.cumsum(lengths)
        begins = ends - lengths
        text_first = np.zeros(len(data) + 1, bool)
        text_first[begins] = True
        cut = np.zeros(len(data), bool)
        cut[at[self.pieces(code, text_first[at])]] = True
        cut[1:] |= ~self.inside[data[:-1], data[1:]]
        begin = np.flatnonzero(cut)
        size = np.diff(begin, append=len(data))
        number = np.full(len(begin), -1, np.int64)
        count = np.ones(len(begin), np.int64)
        short = np.flatnonzero((size > 1) & (size < 8))
        key = size[short].astype(np.uint64) << np.uint64(56)
        for k in range(7):
            has = size[short] > k
            key[has] |= data[begin[short[has]] + k].astype(np.uint64) << np.uint64(8 * k)
        values, back = np.unique(key, return_inverse=True)
        known = np.fromiter((self._number(v, v.to_bytes(8, "little")[: v >> 56]) for v in values.tolist()), np.int64, len(values))
        number[short] = known[back] if len(values) else 0
        blob = data.tobytes()
        for i in np.flatnonzero(size >= 8).tolist():
            f = blob[begin[i] : begin[i] + size[i]]
            number[i] = self._number(f, f)
        many = np.flatnonzero(number >= 0)
        count[many] = self.spans[number[many], 1]
        stop = np.cumsum(count)
        ids = np.empty(int(stop[-1]), np.int32)
        one = np.flatnonzero(number < 0)
        ids[stop[one] - 1] = self.single[data[begin[one]]]
        c = count[many]
        within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        ids[np.repeat(stop[many] - c, c) + within] = self.store[np.repeat(self.spans[number[many], 0], c) + within]
        upto = np.searchsorted(begin, ends)  # fragments before each text's end
        offsets = np.concatenate([[0], np.where(upto > 0, stop[np.maximum(upto - 1, 0)], 0)]).astype(np.int32)
        self._forget()
        return ids, offsets


#: The encoder of this worker process, by its vocabulary's digest.
_coders: dict[str, Encoder] = {}


def _coder(digest: str, vocabulary) -> Encoder:
    if digest not in _coders:
        _coders.clear()
        _coders[digest] = Encoder(read_ranks(vocabulary.value))
    return _coders[digest]


def _run(digest: str, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coder = _coder(digest, vocabulary)
            keys, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            low = held = 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= SLICE_BYTES or i == len(texts) - 1:
                    ids, offsets = coder.encode(texts[low : i + 1])
                    yield pa.RecordBatch.from_arrays([keys.slice(low, i + 1 - low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["key", "ids"])
                    low, held = i + 1, 0

    return run


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids ARRAY<INT>), one row for each row of ``df``; other columns are ignored."""
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = f.read()
    held = spark.sparkContext.broadcast(data)
    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_run(hashlib.sha256(data).hexdigest(), held), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
