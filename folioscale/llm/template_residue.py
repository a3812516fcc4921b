"""Template residue, filler and error pages in place of content (problem 4).

Method: the terms of a record's address (its slug), title and body are compared, and the evidence is added
up (``WEIGHTS``); at ``ENOUGH`` the record is a case.

* *Placeholder detectors* are enough by themselves: a line, or part of a title, that is the syntax of an
  unfilled template, a raw empty value, a default title, or filler (one unit or one line repeated, or a
  phrase that asks to be replaced).
* *Mismatch*: the title lacks the chapter number of the address.
* *No term shared*: the suspected text has no term of title and slug. A title is compared with slug and body.
* *Low information*: a text of few different terms.
* *Host evidence*: the very text is the whole body of ``min_records`` records of ``min_hosts`` hosts under
  different chapter numbers (a repost keeps its number). It counts for records that are it, and for
  records whose last lines are it: these have the notice in place of the rest of their chapter. The
  comparison is a join on hashed keys, with counts over all records, so nothing is gathered in one place;
  a notice that a third of all rows hold is pre-aggregated.
* *Vocabulary*: words that error pages use. It is a weight like the others.

Quoted speech is never evidence: a story may speak of such things. Nor is the line with which a host ends a
fifth of its records: that is the site's. Null and blank contents are no case unless their title is one. A
null title, url or host is simply no evidence. Whole texts of any length are read and compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written

#: Syntax of templates, each as it stands alone. Fixed values.
SYNTAX = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}%]*%\}", r"\$\{[^{}]*\}", r"<%[^%]*%>", r"\[\[[^\[\]]*\]\]", r"%[A-Z][A-Z0-9_]*%", r"\{\$[\w.\[\]]+\}", r"@\{[\w.]+\}",
    r"\{[A-Za-z_][\w.]*\}", r"#[A-Za-z_][\w]*#", r"__[A-Z][A-Z0-9_]*__", r"<!--.*?-->", r"<\?(?:php|=).*?\?>", r"@[A-Z]\w*\.[A-Z]\w*", r"\[object \w+\]",
]
PLACEHOLDER = re.compile("|".join(SYNTAX))
ALONE = re.compile(rf"(?:{'|'.join(SYNTAX)}|undefined|null|NULL|nil|None|NaN|\(null\)|\(none\)|N/A|#N/A)[\s,;]*")
#: One unit over and over, and phrases that ask to be replaced. Fixed values.
REPEATED = re.compile(r"([\w ]{1,8}?)\1{2,}")
FILLER = re.compile(r"lorem ipsum|asdf|your text (?:goes )?here|(?:sample|dummy|placeholder) text|texto de (?:ejemplo|relleno|prueba)|texte (?:d[’']exemple|de remplissage|factice)|示例(?:文本|内容)|此处(?:填写|输入|为)|请替换|占位", re.I)
NOTICE = re.compile(
    r"页面(?:不存在|未找到|已失效)|(?:错误的|坏的)网关|网关超时|开启(?:java)?脚本|启用(?:java)?脚本|浏览器版本过低|数据库(?:连接|错误)|访问(?:您)?(?:的)?(?:过于|太)频繁|过于频繁|(?:加载|载入|读取)失败|(?:章节|内容).{0,6}审核中|开小差|还在录入|正在(?:录入|手打)中?|(?:付费|收费|VIP)章节|登录后(?:方可|才能|可)|异常流量|完成.{0,6}验证|服务器(?:错误|繁忙|维护)|系统维护|无权访问"
    r"|\bnot found\b|could not be (?:located|loaded|found)|bad gateway|gateway time-?out|internal server error|(?:temporarily )?unavailable|too many requests|slow down, please|access denied|(?:enable|activate|turn on) (?:java ?)?scripts?|scripting turned on|requires? (?:a browser|javascript)|fatal error|traceback \(most recent|\w+Error: |verif(?:y|ying) that you are|^one moment, please|request was blocked|due to maintenance|\bforbidden\b|\bcaptcha\b|log ?in to (?:read|continue)|premium chapter"
    r"|veuillez (?:activer|patienter|réessayer|vous connecter)|indisponible|page introuvable|réessayez|accès refusé|trop de requêtes|erreur \d{3}"
    r"|active los scripts|no disponible|no encontrad[ao]|acceso denegado|demasiadas (?:solicitudes|peticiones)|vuelva en \d|inténtelo|error \d{3}",
    re.I,
)
DEFAULT_TITLE = re.compile(r"untitled(?: document)?|new (?:chapter|page|document)|(?:chapter )?title here|新建(?:章节|文档|页面)?标题|无标题(?:文档)?|未命名|sans titre|sin título|documento sin título|document sans titre", re.I)
QUOTES = re.compile("[“”「」『』«»\"]")
NUMBERS = re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b|[0-9]+")
CHAPTER_NUMBER = re.compile(r"\d|[零一二三四五六七八九十百千两]|\b[ivxlc]+\b", re.I)
HAN_NUMBER = re.compile("第?([零一二三四五六七八九十百千两]+)")
TERM = re.compile(r"[一-鿿]+|[^\W\d_一-鿿]{4,}")
#: Words of headings that say nothing about the chapter. Fixed values.
HEADING_WORDS = {"chapter", "chapitre", "capítulo", "capitulo", "index", "book", "novel", "info", "html", "page", "part", "章节", "目录"}
#: What each kind of evidence adds, and how much is enough.
WEIGHTS = {"detector": 3.0, "vocabulary": 2.0, "hosts": 2.0, "mismatch": 1.5, "unshared": 1.0, "poor": 1.0}
ENOUGH = 3.0
#: A text of fewer different terms than this, or than half of its terms, is poor.
FEW_TERMS = 4
#: Lines at a record's end that are compared with the bodies of others; a notice's own line is at most so long.
LAST_LINES, LINE_CHARS = 3, 120
#: A host's own line ends at least this share of its records, and this many.
OWN_SHARE, OWN_LEAST = 0.2, 5
WHOLE, ENDING = 0, 1


def _key(lines: list[str]) -> int:
    text = "\n".join(NUMBERS.sub("0", " ".join(x.lower().split())) for x in lines)
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def filler(line: str) -> bool:
    m = REPEATED.fullmatch(line) or REPEATED.fullmatch(line + " ")
    return bool(m and not m[1].isdigit() and any(c.isalpha() for c in m[1])) or (len(line) <= 60 and FILLER.search(line) is not None and not QUOTES.search(line))


def residue_line(line: str) -> bool:
    """A line that is an unfilled placeholder or a raw empty value."""
    return ALONE.fullmatch(line) is not None or (len(line) <= 80 and PLACEHOLDER.search(line) is not None and not re.sub(PLACEHOLDER, "", line).strip("第章节 :：.-_0123456789").replace("Chapter", "").strip(" :"))


def notice_line(line: str) -> bool:
    return len(line) <= 120 and not QUOTES.search(line) and NOTICE.search(line) is not None


def residue_title(title: str) -> bool:
    return PLACEHOLDER.search(title) is not None or ALONE.fullmatch(title) is not None or DEFAULT_TITLE.fullmatch(title) is not None or filler(title)


def terms(text: str) -> list[str]:
    """Words, and pairs of neighbouring Han characters."""
    out: list[str] = []
    for t in TERM.findall(text.lower()):
        out += [t[i : i + 2] for i in range(max(1, len(t) - 1))] if "一" <= t[0] <= "鿿" else [t]
    return [t for t in out if len(t) > 1 and t not in HEADING_WORDS]


def number_of(title: str) -> int | None:
    """The chapter number that a title gives."""
    if m := re.search(r"\d+", title):
        return int(m[0])
    m = HAN_NUMBER.search(title)
    if not m:
        return None
    total = part = 0
    for c in m[1]:
        if c in "十百千":
            total += (part or 1) * {"十": 10, "百": 100, "千": 1000}[c]
            part = 0
        else:
            part = 2 if c == "两" else "零一二三四五六七八九".index(c)
    return total + part


def slug_of(url: str | None) -> tuple[str, int | None]:
    """The words of an address behind its host, and the number of its last part."""
    path = re.sub(r"^\w+://[^/]*|[?#].*$", "", url or "")
    m = re.search(r"(\d+)\D*$", path.rstrip("/").rpartition("/")[2])
    return re.sub(r"[\W_]+", " ", path), int(m[1]) if m else None


def _poor(text: str) -> bool:
    own = terms(text)
    return len(set(own)) < max(FEW_TERMS, 0.5 * len(own))


def judge(title: str | None, url: str | None, content: str | None) -> tuple[bool, list[tuple[int, int, float]]]:
    """(enough by itself?, (kind, key, evidence so far) for the evidence of other records) of a record."""
    head = (title or "").strip()
    slug, place = slug_of(url)
    body = content if content is not None and content.strip() else ""
    number = number_of(head)
    evidence = WEIGHTS["mismatch"] if head and place is not None and number != place else 0.0
    about = set(terms(head)) | set(terms(slug))

    def unshared(text: str, other: set[str]) -> float:
        low = text.lower()
        return 0.0 if any(t in low for t in other) else WEIGHTS["unshared"]

    if head:
        if residue_title(head):
            return True, []
        if notice_line(head) and evidence + WEIGHTS["vocabulary"] + unshared(f"{slug}\n{body}", set(terms(head))) >= ENOUGH:
            return True, []
    if not body:
        return False, []
    lines = [x for x in map(str.strip, body.split("\n")) if x]
    if any(residue_line(x) for x in lines if len(x) <= LINE_CHARS):
        return True, []
    if all(filler(x) for x in lines) or any(filler(x) and REPEATED.fullmatch(x) is None for x in lines if len(x) <= 60):
        return True, []
    if len(lines) >= 3 and len(set(lines)) == 1 and terms(lines[0]):
        return True, []
    keys = []
    speaks = [QUOTES.search(x) is not None for x in lines]
    whole = evidence + unshared(body, about)
    notice = notice_line(lines[0]) and not any(speaks) and _short(lines)
    if not any(speaks):
        if whole + (WEIGHTS["poor"] if len(lines) <= LAST_LINES and _poor(body) and number is not None else 0.0) + (WEIGHTS["vocabulary"] if notice or all(map(notice_line, lines)) else 0.0) >= ENOUGH:
            return True, [(WHOLE, _key(lines), whole)]
        keys.append((WHOLE, _key(lines), whole))
    for n in range(1, min(LAST_LINES, len(lines) - 1) + 1):
        if speaks[-n] or len(lines[-n]) > LINE_CHARS:
            break
        keys.append((ENDING, _key(lines[-n:]), evidence + unshared("\n".join(lines[-n:]), about) + (WEIGHTS["vocabulary"] if n == 1 and notice_line(lines[-1]) else 0.0)))
    return any(kind == ENDING and score >= ENOUGH for kind, _, score in keys), keys


def _short(lines: list[str]) -> bool:
    """Are all lines as short as those of notices?"""
    return all(len(x) <= LINE_CHARS for x in lines)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, certain, kinds, keys, scores, numbers, at = [], [], [], [], [], [], []
        for i, (row, title, url, content) in enumerate(zip(*(b.column(c).to_pylist() for c in ("row", "title", "url", "content")))):
            bad, found = judge(title, url, content)
            number = slug_of(url)[1] if found else None
            if number is None and found and title:
                number = number_of(title)
            for kind, key, score in found or ([(None, None, None)] if bad else []):
                rows.append(row)
                certain.append(bad and all(k == WHOLE for k, _, _ in found))  # an ending may be its host's own line
                kinds.append(kind)
                keys.append(key)
                scores.append(score)
                numbers.append(number)
                at.append(i)
        columns = [pa.array(rows, pa.int64()), pa.array(certain, pa.bool_()), pa.array(kinds, pa.int8()), pa.array(keys, pa.int64()), pa.array(scores, pa.float64()), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, b.column("host").take(pa.array(at, pa.int64()))], names=["row", "certain", "kind", "key", "score", "number", "host"])


def residue(df: DataFrame, row: str, host: str, title: str, url: str, content: str, min_hosts: int = 2, min_records: int = 3) -> DataFrame:
    """(row): the records that hold residue, filler or an error page in place of content.

    A text is a notice if records of ``min_hosts`` hosts (1 or 2), and ``min_records`` in all, have it as
    their whole body under different numbers.
    """
    ship(df.sparkSession)
    named = {"row": row, "host": host, "title": title, "url": url, "content": content}
    texts = df.select(*(F.col(f"`{c}`").cast("bigint" if n == "row" else "string").alias(n) for n, c in named.items()))
    seen = written(texts.mapInArrow(_run, "row bigint, certain boolean, kind tinyint, key bigint, score double, number bigint, host string"), "residue")
    bodies = seen.where(F.col("kind") == WHOLE).groupBy("key").agg(
        F.count("*").alias("n"), F.min("host").alias("a"), F.max("host").alias("b"), F.min("number").alias("low"), F.max("number").alias("high"),
    )
    several = F.lit(True) if min_hosts < 2 else F.col("a") != F.col("b")
    notices = bodies.where((F.col("n") >= min_records) & several & (F.col("low") != F.col("high"))).select("key", F.lit(WEIGHTS["hosts"]).alias("hosts"))
    likely = seen.where("not certain and kind is not null").join(notices, "key", "left").where(F.col("score") + F.coalesce("hosts", F.lit(0.0)) >= ENOUGH)
    likely = written(likely.select("row", "host", "key", "kind"), "likely")
    records = df.groupBy(F.col(f"`{host}`").cast("string").alias("host")).agg(F.count("*").alias("records"))
    ends = likely.where(F.col("kind") == ENDING).groupBy("host", "key").agg(F.count("*").alias("n"))
    own = ends.join(records, ends["host"].eqNullSafe(records["host"])).where((F.col("n") >= OWN_LEAST) & (F.col("n") >= OWN_SHARE * F.col("records"))).select(ends["host"].alias("its_host"), ends["key"].alias("its_key"), F.lit(ENDING).cast("tinyint").alias("its_kind"))
    others = likely.join(own, (F.col("key") == F.col("its_key")) & (F.col("kind") == F.col("its_kind")) & F.col("host").eqNullSafe(F.col("its_host")), "left_anti")
    return seen.where("certain").select("row").unionByName(others.select("row")).distinct()
