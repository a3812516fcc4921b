"""Page boilerplate mixed with main content (problem 2).

Method: composite text density. Where markup is given (``html``), the density of every DOM node is

    C/T * log_b(C/LC * T/LT),   b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)

(C characters, LC characters in links, T tags, LT link tags), the densities of a node's children are
summed, and the subtree of the largest sum is the main one; what stands in it speaks for a line of the
text, what stands in links outside it against. Most pages are texts whose markup is gone. There the tree is
read off the text: the page is the body, runs of lines alike are its blocks, lines are the leaves; the
items of a line (parts between separators) stand for its tags. How far a line stands for links is a score
between 0 and 1: evidence such as a line that the source repeats on many of its pages, a navigation trail,
an entry without an ended sentence, a reader's signed remark, the site's own name or address adds to it
(``WEIGHTS``); none decides. A line whose score leaves it open takes over what the lines around it
show. LC and LT are the line's characters and tags times its score.

A line's density then decides: the threshold is the least density along the path from the densest block to
the body, per character of a tag; of the runs of blocks the one of the largest sum above the threshold is
the main subtree, and the lines in it that reach the threshold are kept. Chapter headings and scene marks
belong to the story wherever they touch it; a page without a line of story has none.

Which lines a source repeats is counted over all its pages: mergeable summaries give candidates, a second
pass counts them exactly (see site_lines). Each worker reads the sets of the sources it meets.

Null and blank texts have no lines to judge. Whole texts are read, blank lines are counted in the
numbering. A null source is a source like any other; a null title is no evidence for headings, null
markup none for anything.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import dom
from ..session import ship, written
from .site_lines import SetsBySource, candidates, line_keys

ENDED = re.compile(r"[。！？!?…；;：:，,—~～][”’」』»\"')）】\]]*$|\.[”’»\"')）]*$|[”’」』»]$")
HEADING = re.compile(r"(?:第\s*[0-9０-９零〇一二三四五六七八九十百千两]+\s*[章节回卷话篇]|(?:chapter|chapitre|cap[ií]tulo|ch\.|cap\.)\s*[0-9ivxlc]+\b|[0-9]+\s*[、.．:：)]\s*)\s*[-—–:：.、|]*\s*", re.I)
NUMBER_HEAD = re.compile(r"(?:第\s*[0-9０-９零〇一二三四五六七八九十百千两]+\s*[章节回卷话篇]|(?:chapter|chapitre|cap[ií]tulo|ch\.|cap\.)\s*[0-9ivxlc]+\b)", re.I)
SCENE = re.compile(r"[\W_]{1,12}")
PANEL = re.compile(r"[【\[〔][^【】\[\]]{1,20}[:：]\s*[^【】\[\]]{1,24}[】\]〕]")
SEPARATOR = re.compile(r"\s*[|·»›>←→/«<]+\s*|　|\s{2,}|\s[-–—]\s")
TRAIL = re.compile(r"\S{1,12}?\s*[»›>/|·][^»›>/|·]+[»›>/|·]\s*\S")
META = re.compile(r"(?:字数|作者|更新|words|mots|palabras|updated|mis à jour|actualizado|^by |^par |^por )", re.I)
#: What a site or its readers say about reading, in the site's languages. Fixed values.
REMARKS = re.compile(r"最新书评|本章说|读者评论|书友评论|评论区|^discussion$|reader comments|^comments$|^comentarios$|^commentaires$|avis des lecteurs|opiniones", re.I)
SIGNED = re.compile(r"^\[[^\[\]]{1,20}\]\s+\S.*$|^[^。！？.!?：:]{1,16}?\s*(?:发表于[^：:]{1,12}|wrote [^:]{1,14}|\((?:hace|il y a)[^)]{1,14}\)|a écrit [^:]{1,14}|escribió [^:]{1,14})\s?[：:]")
REPLY = re.compile(r"^[^。！？.!?：:，,]{1,24}[：:]\s*\S|^[^。！？.!?]{1,16} [-–] \S")
LIKED = re.compile(r"(?:赞|顶|\+|likes?)\s*\(?\+?\d+\)?$|\(\+?\d+\)$")
SITE = re.compile(r"©|copyright|版权所有|all rights reserved|tous droits réservés|derechos reservados|(?:www|m)\.[\w-]+\.\w{2,}|https?://", re.I)
NUMBERED = re.compile(r"[0-9０-９]+\s*[、.．]\s*\S")
NAME = re.compile(r"^\[([^\[\]]{1,20})\]\s|^([^。！？.!?：:，,]{1,16}?)(?:\s*(?:发表于|wrote |\((?:hace|il y a)|a écrit |escribió )|\s?[：:]| [-–] )")
DIGITS = re.compile(r"[0-9]+")
PLAIN_STOP = re.compile(r"[。！？.!?]")
#: How much a line with the evidence stands for links; evidence is put together as 1 - product(1 - weight).
WEIGHTS = {
    "repeated": 0.97, "remarks": 0.9, "in_remarks": 0.9, "known_name": 0.85, "signed": 0.85, "liked": 0.85, "site": 0.85, "meta": 0.85, "trail": 0.9, "unended": 0.75, "numbered": 0.3, "markup_link": 0.6,
}
#: An ended sentence, or a line of the markup's main subtree, stands for links by this much.
PROSE, MAIN = 0.06, 0.02
#: The link score of a line as open as can be, and the bounds between which the body's path may set the threshold's.
OPEN, STRICT, LAX = 0.5, 0.45, 0.65
#: What a line below the threshold takes from the sum of a run, as a part of what it lacks: stories go on behind inserted lines.
BETWEEN = 0.2
STORY, HEAD, MARK = range(3)


def name_key(line: str) -> str | None:
    m = NAME.match(line)
    return DIGITS.sub("0", m[1] or m[2]).strip() if m else None


def signed_names(content: str) -> list[str]:
    """The names of those whose remarks the page shows, by their evident form."""
    if "发表于" not in content and " wrote " not in content and "(hace" not in content and "[" not in content and "(il y a" not in content:
        return []
    return [k for line in content.split("\n") if SIGNED.match(x := line.strip()) and not PANEL.fullmatch(x) and (k := name_key(x))]


def _tail(text: str) -> str:
    return "".join(HEADING.sub("", text.strip(), count=1).split()).lower()


def density(c: float, lc: float, t: float, lt: float, share: float) -> float:
    """Composite text density of a node; share: the body's share of characters in links."""
    if c <= 0:
        return 0.0
    base = math.log(c / max(1.0, c - lc) * lc + share * c + math.e)
    value = (c / max(lc, 0.01 * c)) * (max(1.0, t) / max(lt, 0.01 * t, 1e-9))
    return c / max(1.0, t) * math.log(max(1.0, value)) / math.log(max(base, math.e ** 0.5))


def main_subtree(html: str) -> tuple[set[str], set[str]]:
    """(line keys in the subtree of largest density sum, line keys in links outside it) of a page's markup, which may be cut."""
    root = dom.parse(html)
    order = [root, *root.walk()]
    at = {id(n): i for i, n in enumerate(order)}
    chars, linked, tags, link_tags = ([0] * len(order) for _ in range(4))
    for i in range(len(order) - 1, -1, -1):  # children come after their parents
        n = order[i]
        if n.tag in ("script", "style", "head", "title"):
            continue
        chars[i] += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        if n.tag == "a":
            linked[i], link_tags[i] = chars[i], tags[i] + 1
        up = at.get(id(n.parent)) if n.parent is not None else None
        if up is not None:
            chars[up] += chars[i]
            linked[up] += linked[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i]
    share = linked[0] / max(1, chars[0])
    own = [density(c, lc, max(1, t), lt, share) for c, lc, t, lt in zip(chars, linked, tags, link_tags)]
    sums = [0.0] * len(order)
    for i, n in enumerate(order[1:], 1):
        up = at.get(id(n.parent))
        if up is not None:
            sums[up] += own[i]
    best = max(range(len(order)), key=lambda i: (sums[i] if any(not isinstance(c, str) for c in order[i].children) else own[i], -i))
    inside = {id(order[best])} | {id(n) for n in order[best].walk()}
    keep: set[str] = set()
    drop: set[str] = set()
    for n in order:
        if n.tag in ("script", "style", "head", "title"):
            continue
        for c in n.children:
            if isinstance(c, str) and c.strip():
                for k in line_keys(c):
                    if k:
                        if id(n) in inside and n.tag != "a":
                            keep.add(k)
                        elif n.tag == "a":
                            drop.add(k)
    return keep, drop - keep


class Reader:
    """Judges the lines of a text.

    repeated: line keys that the text's source repeats; names: names of those who sign remarks.
    """

    def __init__(self, repeated: set[str], site: str | None = None, names: set[str] = frozenset()):
        self.repeated, self.site, self.names = repeated, site, names

    def scores(self, lines: list[str], keys: list[str], title: str | None, html: str | None = None) -> tuple[list[int | None], list[float]]:
        """(kind, link score) of each line; kind None for blank ones."""
        head = (title or "").split("_")[0].strip()
        whole, tail = "".join(head.split()).lower(), _tail(head) if head else ""
        main, linked = main_subtree(html) if html else (frozenset(), frozenset())
        kinds: list[int | None] = []
        scores: list[float] = []
        evidence: list[list[str]] = []  # of the lines that are not blank
        at: list[int] = []
        free: list[float] = []
        remarks = False
        for line, key in zip(lines, keys):
            scores.append(0.0)
            if not key:
                kinds.append(None)
                continue
            text = line.strip()
            n = len(text)
            at.append(len(kinds))
            evidence.append([])
            free.append(1.0)
            if whole and len(key) <= 80 and ("".join(text.split()).lower() == whole or (len(tail) > 1 and _tail(text) == tail)):
                remarks = False
                kinds.append(HEAD)
                continue
            found = evidence[-1]
            mark = n <= 52 and (SCENE.fullmatch(text) is not None or PANEL.fullmatch(text) is not None)
            if key in self.repeated and not mark:
                found.append("repeated")
            ended = ENDED.search(text[-12:]) is not None
            says = n <= 24 and REMARKS.search(text) is not None
            signed = not mark and SIGNED.match(text) is not None
            liked = n <= 200 and text[-1] in "0123456789)" and LIKED.search(text[-24:]) is not None
            if says:
                found.append("remarks")
            elif remarks and (signed or liked or (not found and (not ended or REPLY.match(text) is not None))):
                found.append("in_remarks")
            remarks = says or (remarks and bool(found))
            if signed:
                found.append("signed")
            if liked:
                found.append("liked")
            if self.names and REPLY.match(text) is not None and name_key(text) in self.names:
                found.append("known_name")
            if SITE.search(text) is not None or (self.site and n <= 80 and self.site in text):
                found.append("site")
            heading = not found and not mark and n <= 80 and NUMBER_HEAD.match(text) is not None and TRAIL.match(text) is None
            if heading:
                kinds.append(HEAD)
                continue
            if not mark:
                if n <= 60 and META.search(text) is not None and SEPARATOR.search(text) is not None and PLAIN_STOP.search(text) is None:
                    found.append("meta")
                if not ended:
                    found.append("trail" if TRAIL.match(text) is not None else "numbered" if not whole and NUMBERED.match(text) is not None else "unended")
            if key in linked:
                found.append("markup_link")
            kinds.append(MARK if mark and not found else STORY)
            free[-1] -= (MAIN if main and any(key.startswith(k) or k.startswith(key) for k in main if len(k) >= 8 or k == key) else PROSE)
        loose = [e in (["unended"], ["numbered"]) for e in evidence]
        for i, (n, found, rest) in enumerate(zip(at, evidence, free)):
            if found == ["numbered"] and any(loose[max(0, i - 1) : i] + loose[i + 1 : i + 2]):  # a heading stands alone, an entry among others
                found = ["unended"]
            elif found == ["numbered"]:
                kinds[n] = HEAD
                continue
            for f in found:
                rest *= 1.0 - WEIGHTS[f]
            scores[n] = 1.0 - rest
        return kinds, scores

    def story(self, text: str, title: str | None, html: str | None = None) -> list[bool | None]:
        """For each line of the text whether it is story; None for blank ones."""
        lines, keys = text.split("\n"), line_keys(text)
        kinds, raw = self.scores(lines, keys, title, html)
        leaves = [n for n, k in enumerate(kinds) if k == STORY]
        runs = [0]  # headings and marks stand between what is around them
        for a, b in zip(leaves, leaves[1:]):
            runs.append(runs[-1] + (HEAD in kinds[a:b]))
        score = _settled([raw[n] for n in leaves], runs)
        sizes = [len(keys[n]) for n in leaves]
        tags = [1 + (len(SEPARATOR.findall(lines[n].strip())) if s > OPEN else 0) for n, s in zip(leaves, score)]
        total_c, total_t = sum(sizes), sum(tags)
        total_lc = sum(c * s for c, s in zip(sizes, score))
        share = total_lc / max(1, total_c)
        own = [density(c, c * s, t, t * s, share) for c, s, t in zip(sizes, score, tags)]
        blocks: list[list[int]] = []  # numbers of the leaves of each block
        for i, s in enumerate(score):
            if blocks and (score[blocks[-1][-1]] > OPEN) == (s > OPEN):
                blocks[-1].append(i)
            else:
                blocks.append([i])
        least = _threshold(blocks, sizes, tags, score, own, share)
        floor = [density(c, c * least, t, t * least, share) for c, t in zip(sizes, tags)]
        gain = [sum(g if (g := own[i] - floor[i]) > 0 else BETWEEN * g for i in b) for b in blocks]
        low, high = best_run(gain)
        keep = {leaves[i] for b in blocks[low:high] for i in b if own[i] >= floor[i]}
        out: list[bool | None] = []
        for n, k in enumerate(kinds):
            out.append(None if k is None else (n in keep if k == STORY else bool(keep)))
        return out


def _settled(raw: list[float], runs: list[int]) -> list[float]:
    """Scores, open ones moved towards what the lines around them in the same run show."""
    out = list(raw)
    for i, s in enumerate(raw):
        open_ = 1.0 - abs(2.0 * s - 1.0)
        if open_ > 0.3:
            near = [raw[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(raw) and runs[j] == runs[i]]
            if near:
                out[i] = s + open_ * (sum(near) / len(near) - s)
    return out


def _threshold(blocks: list[list[int]], sizes: list[int], tags: list[int], score: list[float], own: list[float], share: float) -> float:
    """The link share at which a line's density falls below the least one on the path from the densest block to the body."""
    if not blocks:
        return OPEN
    best = max(blocks, key=lambda b: sum(own[i] for i in b))
    path = (sum(sizes[i] * score[i] for i in best) / max(1, sum(sizes[i] for i in best)), share)
    return min(LAX, max(STRICT, math.sqrt(max(path))))


def best_run(gain: list[float]) -> tuple[int, int]:
    """The contiguous run of largest sum."""
    best, low, high, total, start = -math.inf, 0, 0, 0.0, 0
    for i, g in enumerate(gain):
        if total <= 0:
            total, start = 0.0, i
        total += g
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def _counted(sets: SetsBySource):
    """(source, id, n): on how many pages of this task each candidate line stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for source, content in zip(b.column("source").to_pylist(), b.column("content").to_pylist()):
                own = sets.of(source)
                if own:
                    seen.update((source, own[k]) for k in set(line_keys(content)) if k in own)
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["source", "id", "n"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = Counter(name for content in b.column(0).to_pylist() for name in signed_names(content))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["name", "n"])


def repeated_lines(pages: DataFrame, min_share: float = 0.05, min_pages: int = 5, counters: int = 1000, min_sites: int = 3, site_share: float = 0.01, limit: int = 200_000) -> SetsBySource:
    """For each site the line keys on at least ``min_share`` of its pages in a table. pages: (site, source, content), source being table and site.

    The set of the site "\x01" holds the keys that ``min_sites`` sites, and ``site_share`` of them, repeat.
    """
    totals = written(pages.groupBy("source", "site").agg(F.count("*").alias("n")), "pages")
    need = totals.select("source", F.greatest(F.lit(float(min_pages)), min_share * F.col("n")).alias("need"))
    found = candidates(pages.select("source", "content"), need, counters)
    wanted = SetsBySource(found.select("source", "line", "id"), limit)
    counts = pages.select("source", "content").mapInArrow(_counted(wanted), "source string, id int, n bigint").groupBy("source", "id").agg(F.sum("n").alias("n"))
    confirmed = found.join(counts, ["source", "id"]).where("n >= need").join(totals.select("source", "site"), "source").select("site", "line").distinct()
    confirmed = written(confirmed, "repeated")
    least = max(float(min_sites), site_share * totals.select("site").distinct().count())
    everywhere = confirmed.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.lit("\x01").alias("site"), "line")
    return SetsBySource(confirmed.unionByName(everywhere).select(F.col("site").alias("source"), "line", F.lit(0).alias("id")), limit)


def signers(pages: DataFrame, share: float = 1e-4, least: int = 3) -> frozenset[str]:
    """Names that sign remarks on at least ``share`` of the pages: at most (signed lines per page) / ``share``."""
    counts = pages.select("content").mapInArrow(_named, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    total = pages.count()
    return frozenset(r["name"] for r in counts.where(F.col("n") >= share * total).collect())


def _judge(sets: SetsBySource, names, keep_story: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = sets.of("\x01")
        for b in batches:
            tabs, rows, numbers, texts = [], [], [], []
            for tab, row, site, name, title, content, html in zip(*(b.column(c).to_pylist() for c in ("tab", "row_id", "site", "site_name", "title", "content", "html"))):
                own = sets.of(site)
                story = Reader(_Either(own, everywhere), name, names.value).story(content, title, html)
                if keep_story:
                    tabs.append(tab)
                    rows.append(row)
                    texts.append("\n".join(x for x, s in zip(content.split("\n"), story) if s is not False).strip("\n"))
                    continue
                for n, s in enumerate(story, 1):
                    if s is False:
                        tabs.append(tab)
                        rows.append(row)
                        numbers.append(n)
            last = {"content": pa.array(texts, pa.string())} if keep_story else {"line_no": pa.array(numbers, pa.int32())}
            yield pa.RecordBatch.from_pydict({"tab": pa.array(tabs, pa.string()), "row_id": pa.array(rows, pa.int64())} | last)

    return run


class _Either:
    """Membership in either of two sets, without making their union."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __contains__(self, key: str) -> bool:
        return key in self.a or key in self.b


def _prepared(pages: DataFrame, sites: DataFrame) -> tuple[DataFrame, SetsBySource, object]:
    ship(pages.sparkSession)
    site = F.coalesce("source", F.lit("?"))
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    texts = pages.where(F.col("content").isNotNull()).select("tab", "row_id", site.alias("site"), F.concat_ws(":", "tab", site).alias("source"), "title", "content", html.alias("html"))
    names = pages.sparkSession.sparkContext.broadcast(signers(texts))
    sets = repeated_lines(texts.select("site", "source", "content"))
    named = sites.where("name is not null and trim(name) <> ''").groupBy(F.col("source").alias("site")).agg(F.min("name").alias("site_name"))
    return texts.join(named, "site", "left"), sets, names


def furniture(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(tab, row_id, line_no): every non-blank line that is not story.

    pages: (tab, row_id, source, title, content) and, where there is any, html; sites: (source, name).
    """
    texts, sets, names = _prepared(pages, sites)
    return texts.mapInArrow(_judge(sets, names, False), "tab string, row_id bigint, line_no int")


def bodies(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(tab, row_id, content): the main body of each page with a content."""
    texts, sets, names = _prepared(pages, sites)
    return texts.mapInArrow(_judge(sets, names, True), "tab string, row_id bigint, content string")
