"""Keyword-stuffed pages and link lists (problem 10).

Method: a page becomes a sequence of function words and word classes, with marks of how long no sentence
has ended; an n-gram model (trigrams, interpolated) is trained on the prose of the corpus itself, counted
over all documents. Perplexity is taken in a window around every token, and a page is flagged if at
least ``min_share`` of its characters stand where it is abnormally high or low for prose.

* *Abnormally high*: the window's bits a token lie above those of prose. The bounds come from the histogram
  of the prose pages' own windows (``TAIL`` at either end and a tenth of the way from the middle beyond).
* *Abnormally low*: search words strung together in sentence frames look like prose to a model of classes,
  but the page itself foretells them. A second model, of the page's own characters, calls a run of
  ``OWN_HAN`` Han or ``OWN_LATIN`` other characters foretold if ``FRAMES`` different sentences of the page
  hold it; a sentence is abnormal if at least ``FORETOLD`` of it is. Equal sentences count once, so that
  a refrain foretells nothing, and in half of the page's sentences some run must come back within a sentence
  (``DENSE`` places a sentence), so that numbered sentences of one pattern are none.

An exact check of the flagged pages follows: at most ``1 - min_share`` of the characters stand in telling
sentences, that is ended ones which a page of ``PLACES`` different sentences or more does not foretell.

Prose to train on is decided without labels: a page whose text stands in ended sentences for nine tenths
and hardly foretells itself. The model and the histograms are counts over all documents, merged by adding;
their size is bounded by the number of classes (``CLASSES`` cubed) and of histogram cells.

Null, empty and blank texts, texts of one symbol, word or number (fewer than ``min_items`` items or one
distinct word), and texts too short to fill a window are never flagged. Whole texts are scored; long texts are no exception. Repeated rows are
judged each for itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .leakage import _odd, mix

#: Function characters and words. Fixed values.
HAN = "的了在是把和有人从被得地着过就也都又才却不没可与或而且但因为所以这那哪谁他她它我你们之其于像让向对将会要能想说问上下里中"
WORDS = {
    "en": "the a an of to in on at by for with from into and or but so as if that this these those he she it they we you i his her its their was were is are be been had has have not no nor than then there when while until because although though before after behind above beside yet who what which would could did do",
    "fr": "le la les un une des de du d l à au aux et ou mais donc que qui ne pas plus en dans sur sous par pour avec sans vers contre il elle ils elles on ce cette ces son sa ses leur était fut avait a est se s n y puis alors tandis lorsque parce jusqu",
    "es": "el la los las un una unos de del a al y o pero que no en con sin por para sobre bajo hacia contra ante él ella ellos se su sus lo le era fue había es está mientras cuando aunque porque luego como más ya",
}
START, OTHER, HAN1, WORD_LOW, WORD_UP, NUMBER, GAP, LINE, STOP, COMMA, PAUSE, QUOTE, OPEN, CLOSE, LIST, LINK = range(16)
HAN_RUNS = 9  # HAN1 and the seven classes after the fixed ones: runs of 2 to 8 and more characters
FIRST_FREE = 16
CLASSES = 176
#: After every so many tokens without an ended sentence a token of its own says how long that has gone on.
LONG_EVERY, LONGS = 8, 14
#: Characters of text that are worked on at a time.
SLICE_CHARS = 400_000
#: Tokens of a window, and the histogram of windows' bits; the last cell is for what the page itself foretells.
WINDOW = 32
CELLS, CELL_WIDTH = 400, 0.05
OWN = CELLS + 1
TAIL = 0.005
OWN_HAN, OWN_LATIN, FRAMES, PLACES, FORETOLD, DENSE = 5, 12, 3, 6, 0.5, 1.1
ITEM = re.compile(r"[\n|·,，、;；#>]|\s{1,}")
#: The number of an item at the start of a line, which tells sentences and titles alike nothing.
ITEM_NUMBER = re.compile(r"^[^\S\n]*[0-9]{1,4}\s?[.、)）．][^\S\n]*(?=[^\s0-9])", re.M)
WORDLIKE = re.compile(r"[^\W\d_]")


@cache
def classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; hashes of the function words, sorted; and their classes."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s.isdigit():
            kind[c] = NUMBER
        elif s.isalpha():
            kind[c] = WORD_LOW if s == s.lower() else WORD_UP
        elif s.isspace():
            kind[c] = GAP
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000), (0x3040, 0x3100)):
        kind[a:b] = HAN1
    for chars, k in (("\n", LINE), ("。！？!?.…", STOP), ("，,", COMMA), ("；;：:、", PAUSE), ("“”「」『』«»\"'’‘", QUOTE), ("（([【《〈{", OPEN), ("）)]】》〉}", CLOSE), ("|·#*>-_=/→~+&", LIST)):
        for c in chars:
            kind[ord(c)] = k
    free = FIRST_FREE + HAN_RUNS
    for n, c in enumerate(HAN):
        kind[ord(c)] = free + n
    free += len(HAN)
    words = sorted({w for ws in WORDS.values() for w in ws.split()})
    codes = [word_hash(w) for w in words]
    room = CLASSES - LONGS - free
    by = np.argsort(np.array(codes, np.uint64))
    return kind, np.array(codes, np.uint64)[by], (free + by % room).astype(np.int64)


def word_hash(word: str) -> int:
    code = np.array([ord(c) for c in word], np.uint64)
    return int(mix(np.add.reduce((code + np.uint64(1)) * _odd[np.arange(len(code)) % 64], keepdims=True))[0])


class Batch:
    """Some texts in a row: their characters' classes, tokens and sentences."""

    def __init__(self, texts: list[str]):
        kind = classes()[0]
        self.n = len(texts)
        texts = [ITEM_NUMBER.sub("", t) for t in texts]
        self.raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        self.ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        k = kind[self.raw].astype(np.int64)
        k[self.raw == 0] = START
        dot = np.flatnonzero(self.raw == 0x2E)  # a point within an address, or before a number, ends no sentence
        after, then = k[dot + 1], k[np.minimum(dot + 2, len(k) - 1)]
        k[dot[~np.isin(after, (GAP, LINE, START, STOP, QUOTE, CLOSE)) | ((after == GAP) & (then == NUMBER))]] = PAUSE
        self.kind = k
        self.text = np.repeat(np.arange(self.n), np.diff(self.ends, prepend=0))
        self.solid = (k != GAP) & (k != LINE) & (k != START)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all tokens, each text led by START; the text of each; its first character; and its solid characters."""
        _, hashes, numbers = classes()
        k, raw = self.kind, self.raw
        letter = (k == WORD_LOW) | (k == WORD_UP)
        run = np.ones(len(k), bool)
        same = k[1:] == k[:-1]
        run[1:] = ~((letter[1:] & letter[:-1]) | (same & ((k[1:] == HAN1) | (k[1:] == NUMBER) | (k[1:] == GAP) | (k[1:] == LINE) | (k[1:] == LIST) | (k[1:] == STOP) | (k[1:] == OTHER))))
        begin = np.flatnonzero(run)
        size = np.diff(begin, append=len(k))
        out = k[begin]
        han = out == HAN1
        out[han] = np.where(size[han] == 1, HAN1, FIRST_FREE + np.minimum(size[han], HAN_RUNS) - 2)
        word = np.flatnonzero((out == WORD_LOW) | (out == WORD_UP))
        if len(word):
            at = np.arange(len(k)) - np.repeat(begin, size)
            low = np.where(k == WORD_UP, np.where(raw < 0x250, raw + 32, raw), raw).astype(np.uint64)
            h = mix(np.add.reduceat(np.where(letter, (low + np.uint64(1)) * _odd[at % 64], np.uint64(0)), begin)[word])
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[place] == h
            out[word[known]] = numbers[place[known]]
            first = raw[begin[word[~known]]]
            link = (size[word[~known]] >= 4) & (first == ord("h")) & (raw[np.minimum(begin[word[~known]] + 3, len(raw) - 1)] == ord("p"))
            out[word[~known][link]] = LINK
        text, chars = self.text[begin], np.add.reduceat(self.solid.astype(np.int64), begin)
        # layout: a line's end after an ended sentence, and gaps beside lines' ends, say nothing
        place = np.arange(len(out))
        line = (out == LINE) | (out == START)
        before = np.maximum.accumulate(np.where((out == GAP) | (out == LINE) | (out == QUOTE) | (out == CLOSE), 0, place))
        beside = np.zeros(len(out), bool)
        beside[1:] = line[:-1]
        beside[:-1] |= line[1:]
        keep = ~(((out == GAP) & beside) | ((out == LINE) & (out[before] == STOP)))
        out, text, begin, chars = out[keep], text[keep], begin[keep], chars[keep]
        lead = np.searchsorted(text, np.arange(self.n))
        out, text, begin, chars = np.insert(out, lead, START), np.insert(text, lead, np.arange(self.n)), np.insert(begin, lead, begin[lead]), np.insert(chars, lead, 0)
        place = np.arange(len(out))
        since = place - np.maximum.accumulate(np.where((out == STOP) | (out == START), place, 0))
        long_ = np.flatnonzero((since > 0) & (since % LONG_EVERY == 0))
        level = CLASSES - LONGS - 1 + np.minimum(since[long_] // LONG_EVERY, LONGS)
        return tuple(np.insert(a, long_ + 1, v) for a, v in ((out, level), (text, text[long_]), (begin, begin[long_]), (chars, 0)))

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """Sentence number of each character (they end at stops, with what closes after them, and at lines), and which sentences are ended by a stop."""
        k = self.kind
        shut = (k == QUOTE) | (k == CLOSE)
        at = np.arange(len(k))
        held = at - np.maximum.accumulate(np.where(~shut, at, -1))  # closing characters in a row up to here
        stop = (k == STOP) | (shut & (k[np.maximum(at - held, 0)] == STOP) & (held > 0))
        over = stop & ~np.append(stop[1:], False)
        final = over | (k == LINE) | (k == START)
        number = np.cumsum(final) - final
        ended = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
        ended[number[over]] = True
        return number, ended

    def foretold(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per sentence: is it foretold by the page itself, and does the page also hold runs that come back within sentences?"""
        k, raw = self.kind, self.raw
        count = int(number[-1]) + 1
        low = np.where((k == WORD_UP) & (raw < 0x250), raw + 32, raw).astype(np.uint64)
        start = np.searchsorted(number, np.arange(count))
        size = np.diff(start, append=len(number))
        solid = np.add.reduceat(self.solid.astype(np.int64), start)
        at = np.arange(len(number)) - np.repeat(start, size)
        owner = self.text[start]
        spelt = np.where(self.solid, (low + np.uint64(1)) * mix(at.astype(np.uint64)), np.uint64(0))
        same = mix(np.add.reduceat(spelt, start) + owner.astype(np.uint64) * _odd[3])
        _, first, copy = np.unique(same, return_index=True, return_inverse=True)
        single = np.zeros(count, bool)
        single[first] = True
        wide = np.bincount(self.text, (k == HAN1) | (k >= FIRST_FREE + HAN_RUNS), self.n) * 2 > np.bincount(self.text, self.solid, self.n)
        covered, bait = np.zeros(len(number) + 1, np.int64), np.zeros(self.n, bool)
        different = np.bincount(owner[single & (solid > 0)], minlength=self.n)
        usable = single[number] & (k != START) & (k != LINE)
        for n, ours in ((OWN_HAN, wide), (OWN_LATIN, ~wide)):
            mine = np.flatnonzero(usable & ours[self.text] & (at + n <= np.repeat(size, size)))
            if not len(mine):
                continue
            gram = self.text[mine].astype(np.uint64) * _odd[5]
            for i in range(n):
                gram = gram + (low[mine + i] + np.uint64(1)) * _odd[8 + i]
            gram = mix(gram)
            slot = (gram >> np.uint64(44)).astype(np.int64)
            often = np.bincount(slot, minlength=1 << 20)[slot] >= FRAMES  # no gram of fewer places is looked at further
            mine, gram = mine[often], gram[often]
            if not len(mine):
                continue
            _, place, name = np.unique(gram, return_index=True, return_inverse=True)
            pairs = np.unique(name.astype(np.int64) * count + number[mine])
            frames, places = np.bincount(pairs // count, minlength=len(place)), np.bincount(name)
            page = self.text[mine[place]]
            bait[page[(frames >= np.maximum(FRAMES, 0.5 * different[page])) & (places >= DENSE * frames)]] = True
            good = frames[name] >= FRAMES
            np.add.at(covered, mine[good], 1)
            np.add.at(covered, mine[good] + n, -1)
        told = np.add.reduceat(((np.cumsum(covered)[:-1] > 0) & self.solid).astype(np.int64), start)
        odd = ((told >= FORETOLD * solid) & (told > 0) & (different[owner] >= PLACES))[first[copy]]
        return odd, odd & bait[owner]


def grams(seq: np.ndarray) -> np.ndarray:
    a = np.concatenate([[START, START], seq[:-2]]) if len(seq) >= 2 else np.zeros(len(seq), np.int64)
    b = np.concatenate([[START], seq[:-1]])
    a = np.where(b == START, START, a)
    return (a * CLASSES + b) * CLASSES + seq


class Model:
    """Interpolated trigram model over classes: bits of each token."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        tri = np.zeros(CLASSES**3)
        tri[cells] = counts
        tri = tri.reshape(CLASSES, CLASSES, CLASSES)
        bi = tri.sum(0)
        uni = bi.sum(0)
        p1 = (uni + 0.5) / (uni.sum() + 0.5 * CLASSES)
        n2 = bi.sum(1, keepdims=True)
        p2 = (bi + 5.0 * p1) / (n2 + 5.0)
        n3 = tri.sum(2, keepdims=True)
        self.bits = (-np.log2((tri + 5.0 * p2) / (n3 + 5.0))).astype(np.float32).ravel()

    def windows(self, seq: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Mean bits in the window around each token; a window ends with its text."""
        real = seq != START
        total = np.concatenate([[0.0], np.cumsum(np.where(real, self.bits[grams(seq)], 0.0).astype(np.float64))])
        place = np.arange(len(seq))
        lead = np.searchsorted(text, np.arange(int(text[-1]) + 1))
        first = lead[text] + 1
        last = np.append(lead[1:], len(seq))[text] - 1  # without the mark of the text's end
        high = np.minimum(np.maximum(place - WINDOW // 2, first) + WINDOW, last)
        low = np.maximum(high - WINDOW, first)
        return (total[high] - total[low]) / np.maximum(1, high - low)


def prosaic(batch: Batch, number: np.ndarray, ended: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which texts are prose to train on."""
    solid = np.bincount(batch.text, batch.solid, batch.n)
    told = np.bincount(batch.text, batch.solid & ended[number], batch.n)
    strung = np.bincount(batch.text, batch.solid & own[number], batch.n)
    return (solid >= 80) & (told >= 0.9 * solid) & (strung <= 0.25 * solid)


def _slices(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    keys, texts, low, held = b.column(0).to_pylist(), b.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_CHARS or i == len(texts) - 1:
            yield keys[low : i + 1], texts[low : i + 1]
            low, held = i + 1, 0


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for b in batches:
        for _, texts in _slices(b):
            batch = Batch(texts)
            number, ended = batch.sentences()
            good = prosaic(batch, number, ended, batch.foretold(number)[0])
            seq, text, _, _ = batch.tokens()
            cells, counts = np.unique(grams(seq)[good[text]], return_counts=True)
            total[cells] += counts
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])


#: The model of this worker process, by the name of its run.
_models: dict[str, Model] = {}


def _model(name: str, held) -> Model:
    if name not in _models:
        _models.clear()
        _models[name] = Model(*held.value)
    return _models[name]


SCORES = "row bigint, prose boolean, cells array<smallint>, chars array<int>, telling int, plain boolean"


def _score(name: str, held, min_share: float, min_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, texts in _slices(b):
                batch = Batch(texts)
                number, ended = batch.sentences()
                likely, own = batch.foretold(number)
                good = prosaic(batch, number, ended, likely)
                seq, text, begin, chars = batch.tokens()
                cell = np.minimum((_model(name, held).windows(seq, text) / CELL_WIDTH).astype(np.int64), CELLS)
                cell[own[number[begin]]] = OWN
                both, back = np.unique(text * (OWN + 1) + cell, return_inverse=True)
                weight = np.bincount(back, chars, len(both)).astype(np.int32)
                offsets = pa.array(np.searchsorted(both, np.arange(batch.n + 1) * (OWN + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, k)) for v, k in (((both % (OWN + 1)).astype(np.int16), pa.int16()), (weight, pa.int32()))]
                telling = np.bincount(batch.text, batch.solid & (ended & ~likely)[number], batch.n).astype(np.int32)
                full = np.bincount(text[seq != START], minlength=batch.n) >= WINDOW
                plain = pa.array([not f or one_thing(t, min_items) for f, t in zip(full.tolist(), texts)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(good), *lists, pa.array(telling), plain], names=["row", "prose", "cells", "chars", "telling", "plain"])

    return run


def one_thing(text: str, min_items: int) -> bool:
    """Is the text one symbol, word or number, or hardly more than that?"""
    words = [x for x in ITEM.split(text) if x and WORDLIKE.search(x)]
    return len(words) < min_items or len(set(words)) < 2


def scored(df: DataFrame, row: str, text: str, min_share: float = 0.75, min_items: int = 6) -> tuple[DataFrame, float, float]:
    """(row, prose, cells, chars, telling, plain) of each non-blank text, and the first and last cell of normal windows.

    cells, chars: how many characters stand in windows of how many bits.
    """
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(f"`{row}`").cast("bigint").alias("row"), F.col(f"`{text}`").cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    counts = texts.mapInArrow(_train, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CLASSES cubed rows
    model = spark.sparkContext.broadcast((counts["cell"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)))
    out = written(texts.mapInArrow(_score(uuid.uuid4().hex, model, min_share, min_items), SCORES), "spam")
    held = out.where("prose").select(F.explode(F.arrays_zip("cells", "chars")).alias("x")).select("x.*").where(F.col("cells") < OWN)
    prose = held.groupBy("cells").agg(F.sum("chars").alias("n")).orderBy("cells").toPandas()  # a row per cell
    if not len(prose):
        return out, 0.0, float(CELLS)
    share = (prose["n"].cumsum() / prose["n"].sum()).to_numpy()
    at = lambda q: float(prose["cells"].to_numpy()[min(int(np.searchsorted(share, q)), len(share) - 1)])
    low, middle, high = at(TAIL), at(0.5), at(1 - TAIL)
    return out, low - 0.1 * (middle - low), high + 0.1 * (high - middle)


def stuffed(df: DataFrame, row: str, text: str, min_share: float = 0.75, min_items: int = 6) -> DataFrame:
    """(row): pages of search words, tags, links or bare titles rather than sentences."""
    out, low, high = scored(df, row, text, min_share, min_items)
    pair = F.arrays_zip("cells", "chars")
    sum_of = lambda keep: F.aggregate(F.filter(pair, keep), F.lit(0).cast("bigint"), lambda s, x: s + x["chars"])
    odd = sum_of(lambda x: (x["cells"] == OWN) | (x["cells"] < low) | (x["cells"] > high))
    total = sum_of(lambda x: F.lit(True))
    return out.where(~F.col("plain") & (odd >= min_share * total) & (F.col("telling") <= (1 - min_share) * total)).select("row")
