"""Matching records of the same book across sources without a common key (problem 1).

Method: sorted neighbourhood over several composite sort keys, comparison with weighted field
similarities within a sliding window, then one-to-one assignment of largest total confidence.

*Profiles.* Hits of one page (source and address, variants of the address resolved) are one entity:
its title and author are the spellings most hits agree on, its intro the longest.

*Sort keys.* title+author, author+title, title backwards, title from its middle, title's characters or
words in order, intro, address. The plans are ranked by
each key and cut into blocks of ``block`` plans that overlap by the window; an entity goes to the
block where its key falls (to each block that holds plans of its very key) and is compared with the ``window`` plans before and after it: 6, and 6 more
for each doubling of the plans beyond 1,000, since neighbours crowd as plans grow. Keys end in all fields, so
plans of an equal key are copies of one record; of very many each entity takes ``COPIES`` of its own.
Windows count plans, so any number of hits may crowd at one place; crowded blocks are salted. No pairs within
a group of entities are made, and only one key in ``block`` reaches the driver.

*Assignment.* A page shows one book, and of one source a plan takes one page: edges that nothing
contests are taken at once, contested ones are gathered into their connected components, which are
solved exactly: up to ``EXACT`` edges by trying, beyond by shortest augmenting paths. A component is
solved in one task, in memory of the order of its edges.

Null titles, authors, intros and addresses are no evidence; two records without any common evidence
are never matched. Repeated hits are all matched to their page's plan.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .confusables import form

#: Decorations around titles and authors, in the sources' languages. Fixed values.
AROUND_TITLE = re.compile(
    r"[（(【\[]\s*(?:完结|完本|连载中?|精校版?|全本|校对版|最新|complete[d]?|completo|intégral|integral|web novel|novel|unabridged|free|ongoing)[^）)】\]]*[）)】\]]"
    r"|(?:最新章节(?:列表)?|全文阅读|全文免费阅读|免费阅读|txt\s*下载|txt全集|无弹窗|全集)\s*$|[-_—–]\s*\S{1,6}小说\s*$|\s+-\s+read online\s*$|,\s*unabridged\s*$|\s*-\s*leer en línea\s*$|\s*-\s*lire en ligne\s*$",
    re.I,
)
GENRE = re.compile(r"^\s*[\[【(（]\s*[^\]】)）]{1,14}\s*[\]】)）]\s*")
WRITTEN_BY = re.compile(r"[（(]\s*([^（()）]{2,40}?)\s*著\s*[）)]\s*$|\s+(?:by|par|por)\s+(\S.{2,60})$|\s+-\s+(\S.{2,60})$", re.I)
AROUND_AUTHOR = re.compile(r"^\s*(?:作者\s*[:：]?|by\s+|par\s+|por\s+|@|文\s*[/／]\s*)|\s*(?:著|大大|（签约作者）|\(签约作者\)|（作者）|\(author\))\s*$", re.I)
NOBODY = {"", "unknown", "anonymous", "n/a", "none", "null", "佚名", "匿名", "未知", "不详", "无名氏", "anonyme", "anónimo", "inconnu", "desconocido", "author unknown", "-", "—", "admin", "网友", "暂无"}
#: What makes a title another book though the rest is equal. Fixed values.
OTHER_BOOK = re.compile(r"续[篇集写]?$|第[一二三四五六七八九十\d]+[部卷季]|同人|番外|外传|前传|后传|新编|改编|漫画版|有声|(?:\b|(?<=[一-鿿]))(?:ii|iii|iv|v|[2-9])$|\bbook (?:two|three|\d+)|\bvol(?:ume|umen)?\.? ?\d+|\bpart (?:two|\d+)|\bparte? (?:ii|\d+)|\btome \d+|\bsequel\b|\bfan ?fic(?:tion)?\b|\bfanfic\b|\bside stor(?:y|ies)\b|\bprequel\b|\bsuite\b|\bsecuela\b|\bthe return\b|\ble retour\b|\bel regreso\b|\b(?:second|deuxième|segunda) (?:book|partie|parte)\b|\b(?:libro|livre) (?:dos|deux|\d+)", re.I)
NOT_WORD = re.compile(r"[\W_]+")
PAGE = re.compile(r"^(?:https?:)?//(?:www\.|m\.|wap\.)?|#.*$", re.I)
#: Parameters of an address that say where the reader came from, not which page it is. Fixed values.
VISIT = re.compile(r"(?:utm_\w+|from|ref|referer|referrer|source|src|spm|share|sid|session\w*|fbclid|gclid|channel|click\w*|track\w*)(?:=.*)?", re.I)
EXACT = 14
#: Of more copies of one plan than this (equal in title, author and intro) each entity is compared with this many, each with its own.
COPIES = 64


def address(url: str | None) -> str | None:
    """One spelling of a page's address."""
    if not url or not url.strip():
        return None
    path, _, query = PAGE.sub("", url.strip()).partition("?")
    kept = sorted(p for p in query.split("&") if p and not VISIT.fullmatch(p))
    return (path.rstrip("/") + ("?" + "&".join(kept) if kept else "")).lower() or None


@lru_cache(50_000)
def clean_author(text: str | None) -> str:
    """Name words in one order; empty where nobody is named."""
    if text is None:
        return ""
    s = " ".join((form(text) or "").split()).lower()
    for _ in range(3):
        s, before = AROUND_AUTHOR.sub("", s).strip(), s
        if s == before:
            break
    if s in NOBODY:
        return ""
    if re.search("[一-鿿]", s):
        return NOT_WORD.sub("", s)
    if "," in s:
        last, _, first = s.partition(",")
        s = f"{first.strip()} {last.strip()}"
    return " ".join(NOT_WORD.sub(" ", s).split())


@lru_cache(50_000)
def clean_title(text: str | None) -> tuple[str, str]:
    """(title without decorations, author named in it)."""
    if text is None:
        return "", ""
    s = " ".join((form(text) or "").split())
    author = ""
    for _ in range(4):
        before = s
        s = AROUND_TITLE.sub("", GENRE.sub("", s)).strip(" \"'《》「」『』“”")
        m = WRITTEN_BY.search(s)
        if m and m.start() > 1:
            author = author or clean_author(m[1] or m[2] or m[3])
            s = s[: m.start()]
        if s == before:
            break
    s = s.lower()
    return ("".join if re.search("[一-鿿]", s) else " ".join)(NOT_WORD.sub(" ", s).split()), author


@lru_cache(20_000)
def clean_intro(text: str | None) -> str:
    return "" if text is None else NOT_WORD.sub("", (form(text) or "").lower())


@lru_cache(4_000)
def _places(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


@lru_cache(4_000)
def _counts(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in a:
        out[c] = out.get(c, 0) + 1
    return out


def shared(a: str, b: str) -> int:
    """Characters that both hold, with repeats: max(len) less this is the least their edit distance can be."""
    x, y = _counts(a), _counts(b)
    return sum(n if n < y[c] else y[c] for c, n in x.items() if c in y)


def edits(a: str, b: str, most: int | None = None) -> int:
    """Edit distance with a swap of neighbours as one edit, a column of the table at a time as bits.

    A distance above ``most`` may be given as any number above it.
    """
    if not a or not b:
        return len(a) + len(b)
    places, full, top = _places(a), (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, diagonal, before, distance = full, 0, 0, 0, len(a)
    bound = len(b) + (len(a) + len(b) if most is None else most)
    for n, c in enumerate(b):
        if distance + n > bound:  # it falls by one a column at most
            return distance + n - len(b)
        match = places.get(c, 0)
        swap = ((~diagonal & match) << 1) & before
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus | swap) & full
        up, down = minus | (~(diagonal | plus) & full), diagonal & plus
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus, before = down | (~(diagonal | up) & full), up & diagonal, match
    return distance


def likeness(a: str, b: str, floor: float = 0.2) -> float:
    """1 for equal texts, 0 for texts that share little; what lies below ``floor`` may come as any number below it."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    if shared(a, b) < 0.5 * n:
        return 0.0
    return max(0.0, 1 - edits(a, b, int((1 - floor) * n) + 1) / n)


@lru_cache(50_000)
def title_likeness(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if shared(a, b) < 0.6 * max(len(a), len(b)):
        return 0.0
    if {m[0] for m in OTHER_BOOK.finditer(a)} != {m[0] for m in OTHER_BOOK.finditer(b)}:
        return 0.0
    best = likeness(a, b, 0.6)
    if best < 0.9 and " " in a and " " in b:
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        best = max(best, likeness(x, y, 0.6))
    elif sorted(a) == sorted(b):
        best = max(best, 0.85)
    return best


@lru_cache(50_000)
def author_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    if len(x) >= 2 and len(y) >= 2 and (len(x[0]) == 1 or len(y[0]) == 1):
        return 0.9 * likeness(x[-1], y[-1]) if x[0][0] == y[0][0] else 0.0
    best = likeness(a, b)
    if len(x) >= 2 and len(y) >= 2:
        best = max(best, likeness(" ".join(sorted(x)), " ".join(sorted(y))))
    return best


def intro_likeness(a: str, b: str) -> float | None:
    """Agreement of the part that both show; None where it is too short to tell."""
    n = min(len(a), len(b))
    if n < 8:
        return None
    if a[:n] == b[:n]:
        return 1.0
    return likeness(a[:n], b[:n], 0.5)


#: Weights of title, author and intro. Fixed values.
WEIGHTS = (0.45, 0.25, 0.30)


def confidence(plan: tuple, hit: tuple) -> float:
    """Of (title, author, intro, address) of a plan and an entity: 0 for no match."""
    if plan[3] is not None and plan[3] == hit[3]:
        return 0.9 + 0.1 * title_likeness(plan[0], hit[0])
    a = author_likeness(plan[1], hit[1]) if plan[1] and hit[1] else None
    if a is not None and a < 0.2:  # told first, since names are short
        return 0.0
    t = title_likeness(plan[0], hit[0])
    if t < 0.6:
        return 0.0
    i = intro_likeness(plan[2], hit[2])
    if a is not None and a < 0.5 and (i is None or i < 0.8 or a < 0.2):
        return 0.0
    if i is not None and i < 0.5:  # sources also write intros of their own
        return 0.65 + 0.05 * t + 0.05 * a if a is not None and a >= 0.8 and t >= 0.8 else 0.0
    have = [(w, v) for w, v in zip(WEIGHTS, (t, a, i)) if v is not None]
    score = sum(w * v for w, v in have) / sum(w for w, _ in have)
    if len(have) == 1:  # a title alone
        return 0.64 if t == 1.0 and len(plan[0]) >= 5 else 0.0
    return score if t >= 0.8 or (a or 0) >= 0.8 or (i or 0) >= 0.8 else 0.0


def keys_of(title: str, author: str, intro: str, page: str | None) -> list[tuple[int, str]]:
    """The composite sort keys that a record has; each ends in all that the record says, so that equal keys are equal records."""
    out = []
    rest = f"{title}|{author}|{intro}"
    if title:
        middle = len(title) // 2
        ordered = " ".join(sorted(title.split())) if " " in title else "".join(sorted(title))
        out += [(0, rest), (2, f"{title[::-1]}|{author}|{intro}"), (5, f"{title[middle:]}{title[:middle]}|{author}|{intro}"), (6, f"{ordered}|{rest}")]
    if author:
        out.append((1, f"{author}|{title}|{intro}"))
    if len(intro) >= 8:
        out.append((3, f"{intro}|{title}|{author}"))
    if page:
        out.append((4, f"{page}|{rest}"))
    return out


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for source, title, author, intro, url in zip(*(b.column(c).to_pylist() for c in ("source", "title", "author", "intro", "url"))):
            t, named = clean_title(title)
            a = clean_author(author) or named
            page = address(url)
            rows.append((page or f"?{source}|{t}|{a}", t, a, clean_intro(intro)))
        cols = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("source"), *cols], names=["row", "source", "page", "title", "author", "intro"])


def cleaned(df: DataFrame, row: str, source: str, title: str, author: str, intro: str, url: str) -> DataFrame:
    """(row, source, page, title, author, intro) in comparable form."""
    named = {"row": row, "source": source, "title": title, "author": author, "intro": intro, "url": url}
    return df.select(*(F.col(f"`{c}`").cast("bigint" if n == "row" else "string").alias(n) for n, c in named.items())).mapInArrow(_cleaned, "row bigint, source string, page string, title string, author string, intro string")


def profiles(hits: DataFrame) -> DataFrame:
    """(page, source, title, author, intro): one entity for each page, by what most of its hits say."""

    def most(c: str) -> DataFrame:
        counts = hits.where(F.col(c) != "").groupBy("page", c).agg(F.count("*").alias("n"))
        return counts.groupBy("page").agg(F.max_by(c, F.struct("n", F.length(c), c)).alias(c))

    base = hits.groupBy("page").agg(F.min("source").alias("source"), F.max_by("intro", F.struct(F.length("intro"), "intro")).alias("intro"))
    return base.join(most("title"), "page", "left").join(most("author"), "page", "left").na.fill("", ["title", "author", "intro"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, nos, keys = [], [], []
        for i, (t, a, n, p) in enumerate(zip(*(b.column(c).to_pylist() for c in ("title", "author", "intro", "page")))):
            for no, key in keys_of(t, a, n, None if p.startswith("?") else p):
                at.append(i)
                nos.append(no)
                keys.append(key)
        t = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(nos, pa.int32()), pa.array(keys, pa.string())], names=[*t.schema.names, "no", "key"])


def _placed(splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = splits.value
        for b in batches:
            at, cells = [], []
            for i, (no, key) in enumerate(zip(b.column("no").to_pylist(), b.column("key").to_pylist())):
                if starts := held.get(no):  # plans of an equal key may fill several cells
                    own = range(max(0, bisect_left(starts, key) - 1), max(1, bisect_right(starts, key)))
                    at += [i] * len(own)
                    cells += own
            b = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=[*b.schema.names, "cell"])

    return run


def letters(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each of 64 classes of characters stands in each title, and the titles' lengths."""
    size = np.array([len(t) for t in titles], np.int64)
    code = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) & 63
    cell = np.repeat(np.arange(len(titles)), size) * 64 + code
    return np.bincount(cell, minlength=len(titles) * 64).reshape(-1, 64).astype(np.int16), size


def _compare(window: int, least: float):
    """Of all pairs in the windows those are compared whose titles can be alike.

    Titles share at most what their classes of characters share, so no pair is lost by looking at these
    first; pairs of one address are compared in any case.
    """

    def fn(plans: pa.Table, entities: pa.Table) -> pa.Table:
        out: list[tuple[int, str, str, float]] = []
        if plans.num_rows and entities.num_rows:
            ps = sorted(zip(*(plans.column(c).to_pylist() for c in ("key", "row", "title", "author", "intro", "page"))))
            keys = [p[0] for p in ps]
            held, sizes = letters([p[2] for p in ps])
            by_page: dict[str, list[int]] = {}
            for n, p in enumerate(ps):
                if p[5] is not None:
                    by_page.setdefault(p[5], []).append(n)
            es = sorted(zip(*(entities.column(c).to_pylist() for c in ("key", "page", "source", "title", "author", "intro"))))
            own, lengths = letters([e[3] for e in es])
            for n, (key, page, source, title, author, intro) in enumerate(es):
                at, end = bisect_left(keys, key), bisect_right(keys, key)
                low, high = max(0, at - window), end + window
                if end - at > COPIES:  # copies of one record: each entity takes some of them, in turn
                    first = crc32(page.encode())
                    some = sorted(at + (first + k) % (end - at) for k in range(COPIES))
                    within = np.array([*range(low, at), *some, *range(end, min(high, len(ps)))])
                else:
                    within = np.arange(low, min(high, len(ps)))
                alike = np.minimum(held[within], own[n]).sum(1) >= 0.6 * np.maximum(sizes[within], lengths[n])
                near = within[alike].tolist()
                near += [k for k in by_page.get(page, ()) if k in within[~alike]]
                for k in near:
                    p = ps[k]
                    c = confidence(p[2:], (title, author, intro, page))
                    if c >= least:
                        out.append((p[1], page, source, c))
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.float64()))], names=["plan", "page", "source", "confidence"])

    return fn


def window_for(plans: int) -> int:
    """Places to either side that keep recall level as plans grow."""
    return 6 + math.ceil(6 * max(0.0, math.log2(max(1, plans) / 1000)))


def neighbours(plans: DataFrame, entities: DataFrame, window: int | None = None, block: int = 2048, crowd: int = 20_000, least: float = 0.6) -> DataFrame:
    """(plan, page, source, confidence): the likely pairs of all sort keys."""
    spark = plans.sparkSession
    window = window_for(plans.count()) if window is None else window
    kinds = "source string, page string, title string, author string, intro string, no int, key string"
    keyed = plans.mapInArrow(_keyed, "row bigint, " + kinds).repartitionByRange(F.col("no"), F.col("key"), F.col("row")).sortWithinPartitions("no", "key", "row")
    keyed = written(keyed.withColumn("part", F.spark_partition_id()).withColumn("in_part", F.monotonically_increasing_id()), "plan-keys")
    starts = {(r["no"], r["part"]): (r["first"], r["n"]) for r in keyed.groupBy("no", "part").agg(F.min("in_part").alias("first"), F.count("*").alias("n")).collect()}  # a row per partition
    base, seen = [], {}
    for (no, part), (first, n) in sorted(starts.items()):
        base.append((no, part, seen.get(no, 0) - first))
        seen[no] = seen.get(no, 0) + n
    shift = spark.createDataFrame(base, "no int, part int, shift bigint") if base else spark.createDataFrame([], "no int, part int, shift bigint")
    ranked = keyed.join(F.broadcast(shift), ["no", "part"]).withColumn("rank", F.col("in_part") + F.col("shift"))
    splits: dict[int, list[str]] = {}
    for r in ranked.where(F.col("rank") % block == 0).select("no", "rank", "key").orderBy("no", "rank").collect():  # one in ``block`` plans
        splits.setdefault(r["no"], []).append(r["key"])
    held = spark.sparkContext.broadcast(splits)
    placed = written(entities.mapInArrow(_keyed, "page string, source string, intro string, title string, author string, no int, key string").mapInArrow(_placed(held), "page string, source string, intro string, title string, author string, no int, key string, cell int").where("cell >= 0"), "entity-keys")
    crowds = placed.groupBy("no", "cell").agg(F.ceil(F.count("*") / crowd).cast("int").alias("salts"))
    placed = placed.join(F.broadcast(crowds), ["no", "cell"]).withColumn("salt", F.pmod(F.xxhash64("page"), F.col("salts")).cast("int"))
    spread = ranked.withColumn("cell", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - window) / block).cast("int")), F.floor((F.col("rank") + window) / block).cast("int"))))
    shares = crowds.select(F.col("no").alias("its_no"), F.col("cell").alias("its_cell"), F.col("salts").alias("shares"))
    spread = spread.join(F.broadcast(shares), (F.col("no") == F.col("its_no")) & (F.col("cell") == F.col("its_cell"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    spread = spread.select("no", "cell", "salt", "row", "title", "author", "intro", "page", "key")
    placed = placed.select("no", "cell", "salt", "page", "source", "title", "author", "intro", "key")
    by = ["no", "cell", "salt"]
    pairs = spread.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_compare(window, least), "plan bigint, page string, source string, confidence double")
    return pairs.groupBy("plan", "page").agg(F.min("source").alias("source"), F.max("confidence").alias("confidence"))


def augmented(edges: list[tuple[str, str, float]], order: list[int]) -> list[int]:
    """The assignment by shortest augmenting paths; every left end may also stay alone, at the cost of the best edge."""
    alone = max(0.0, max(c for _, _, c in edges))
    lefts: dict[str, int] = {}
    rights: dict[str, int] = {}
    roads: list[dict[int, tuple[float, int]]] = []
    for k in order:  # of equal edges the first
        a, b, c = edges[k]
        if lefts.setdefault(a, len(lefts)) == len(roads):
            roads.append({})
        roads[lefts[a]].setdefault(rights.setdefault(b, len(rights)), (alone - c, k))
    up, down = [0.0] * len(lefts), [0.0] * len(rights)
    of_left, of_right = [-1] * len(lefts), [-1] * len(rights)
    for start in range(len(lefts)):
        far: dict[int, float] = {}
        came: dict[int, int] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        seen = [(start, 0.0)]
        left, at, end, last = start, 0.0, math.inf, start
        while True:
            if at + alone - up[left] < end:
                end, last = at + alone - up[left], left
            for j, (cost, _) in roads[left].items():
                to = at + cost - up[left] - down[j]
                if j not in done and to < far.get(j, math.inf):
                    far[j], came[j] = to, left
                    heapq.heappush(heap, (to, j))
            while heap and heap[0][1] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:  # ``last`` stays alone
                j = of_left[last]
                of_left[last] = -1
                break
            at, j = heapq.heappop(heap)
            if of_right[j] < 0:
                end = at
                break
            done.add(j)
            left = of_right[j]
            seen.append((left, at))
        for i, d in seen:
            up[i] += end - d
        for k in done:
            down[k] -= end - far[k]
        while j >= 0:
            i = came[j]
            of_right[j], of_left[i], j = i, j, of_left[i]
    return [roads[i][j][1] for i, j in enumerate(of_left) if j >= 0]


def best_assignment(edges: list[tuple[str, str, float]]) -> list[int]:
    """Numbers of the edges of the one-to-one assignment of largest total confidence."""
    order = sorted(range(len(edges)), key=lambda k: (-edges[k][2], edges[k][:2]))
    if len(edges) > EXACT:
        return augmented(edges, order)
    best: tuple[float, list[int]] = (0.0, [])

    def extend(i: int, total: float, chosen: list[int], used: frozenset) -> None:
        nonlocal best
        if total > best[0] + 1e-12:
            best = (total, list(chosen))
        for j in range(i, len(order)):
            a, b, c = edges[order[j]]
            if ("a", a) in used or ("b", b) in used:
                continue
            extend(j + 1, total + c, [*chosen, order[j]], used | {("a", a), ("b", b)})

    extend(0, 0.0, [], frozenset())
    return best[1]


def _assign(t: pa.Table) -> pa.Table:
    edges = list(zip(t.column("left").to_pylist(), t.column("page").to_pylist(), t.column("confidence").to_pylist()))
    return t.select(["plan", "page", "confidence"]).take(pa.array(best_assignment(edges), pa.int64()))


def assigned(pairs: DataFrame) -> DataFrame:
    """(plan, page, confidence): one-to-one between plans and pages within each source."""
    edges = written(pairs.withColumn("left", F.concat_ws("|", F.col("plan").cast("string"), F.coalesce("source", F.lit("?")))), "edges")
    lefts = edges.groupBy("left").agg(F.count("*").alias("nl"))
    rights = edges.groupBy("page").agg(F.count("*").alias("nr"))
    counted = edges.join(lefts, "left").join(rights, "page")
    free = counted.where("nl = 1 and nr = 1").select("plan", "page", "confidence")
    # an edge that is alone at one end joins no others; the rest is labelled by its component
    labelled = written(counted.where("nl > 1 or nr > 1").select("plan", "page", "confidence", "left", F.col("left").alias("label")), "labels")
    moved = not labelled.isEmpty()
    while moved:
        by_page = labelled.groupBy("page").agg(F.min("label").alias("p"))
        one = labelled.join(by_page, "page")
        by_left = one.groupBy("left").agg(F.min("p").alias("l"), F.min("label").alias("old"))
        by_left = written(by_left.select("left", F.least("l", "old").alias("near"), "old"), "lefts")
        # a label is the name of a left end: its own label is taken over, so that chains halve
        ahead = by_left.select(F.col("left").alias("near"), F.col("near").alias("ahead"))
        new = written(by_left.join(ahead, "near", "left").select("left", "old", F.least("near", "ahead").alias("next")), "lefts")
        moved = not new.where("next < old").isEmpty()
        labelled = written(labelled.drop("label").join(new.select("left", F.col("next").alias("label")), "left"), "labels")
    solved = labelled.groupBy("label").applyInArrow(_assign, "plan bigint, page string, confidence double")
    return free.unionByName(solved)


def match(hits: DataFrame, plans: DataFrame, hit: dict[str, str], plan: dict[str, str], window: int | None = None, least: float = 0.62) -> DataFrame:
    """(plan_id, hit_id, confidence). hit, plan: the columns for row, source, title, author, intro, url."""
    ship(hits.sparkSession)
    clean_hits = written(cleaned(hits, **hit), "hits")
    entities = written(profiles(clean_hits), "entities")
    shown = entities.select(F.col("page").alias("its_page"), F.col("author").alias("its_author"), F.col("intro").alias("its_intro"))
    known = cleaned(plans, **plan).join(shown, F.col("page") == F.col("its_page"), "left")
    fill = lambda c: F.when(F.col(c) == "", F.coalesce(f"its_{c}", F.lit(""))).otherwise(F.col(c)).alias(c)
    known = known.select("row", "source", "page", "title", fill("author"), fill("intro"))  # from the hits of the plan's own page
    pairs = neighbours(known, entities, window=window, least=least)
    pages = assigned(pairs)
    return clean_hits.join(pages, "page").select(F.col("plan").alias("plan_id"), F.col("row").alias("hit_id"), "confidence")
