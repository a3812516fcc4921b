"""Text functions as native column expressions (STR-*, parts of EXT-*, SRC-*).

Patterns are Java's here; ``java_pattern`` and ``java_replacement`` translate Python's. White space is
Unicode's throughout. Null stays null unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = "(?U)"
#: A line that opens a paragraph of its own (WIN-03). Fixed values.
OWN_PARAGRAPH = r"^(第[0-9零一二三四五六七八九十百千两〇○１２３４５６７８９０]+[章节回部卷篇集幕]|注：|说明：|PS|ps|——|--)"
PARAGRAPH_ENDS = "。！？!?；;…」』”）》】〕』\"'"
INDENT = "　　"


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, named groups in Java's writing."""
    return U + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def java_replacement(text: str) -> str:
    r"""A Python replacement for Java: ``\1`` and ``\g<1>`` refer, ``$`` does not."""
    return re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: "$" + (m[2] or (m[1] if m[1].isdigit() else "{" + m[1] + "}")), text.replace("$", "\\$"))


def valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def replace_all(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: White_Space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Unicode white space stripped from both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def squash(c: Column) -> Column:
    """White space runs to one space, ends stripped."""
    return trim(replace_all(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(trim(c) != "", c)


#: Entities that the native form resolves. Fixed values.
ENTITIES = [("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&")]


def unescape_usual(c: Column) -> Column:
    """The usual entities resolved without leaving the JVM."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


#: Code points of the named entities, and of the numbers 128 to 159, which are read as windows-1252.
NAMED = name2codepoint | {"apos": 39}
WINDOWS = {n: ord(bytes([n]).decode("cp1252", "replace")) for n in range(128, 160)}
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"


def unescape(c: Column) -> Column:
    """All entities, named and numeric, each resolved once, without leaving the JVM."""
    named = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))
    windows = F.create_map(*(F.lit(x) for pair in WINDOWS.items() for x in pair))

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, ENTITY, 1)
        number = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 7)).cast("int")
        code = F.coalesce(windows[number], number, named[name])
        known = F.when((code <= 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), 0xFFFD).otherwise(code)
        char = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
        return F.when((name == "") | code.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(char, F.substr(x, F.length(name) + 2)))

    parts = F.split(c, "&")
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))
    return F.when(c.rlike("&(?:#[0-9xX]|[A-Za-z])[A-Za-z0-9]*;"), whole).otherwise(c)


def clean(c: Column, cleaners: Sequence[tuple[str, str]]) -> Column:
    """STR-06 with Python patterns known beforehand: in order, invalid ones passed over, ends stripped."""
    kept = [(java_pattern(p), java_replacement(r)) for p, r in cleaners if valid(p)]
    return trim(reduce(lambda x, pr: replace_all(x, *pr), kept, c)) if cleaners else c


def clean_by(c: Column, rules: Column) -> Column:
    """STR-06 with rules as data: an array of (pattern, replacement) structs in Java's writing."""
    return trim(F.aggregate(rules, c, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"])))


def lf(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def html_to_text(c: Column) -> Column:
    """STR-02: a fragment's text; block ends become line ends."""
    c = replace_all(c, r"(?is)<(script|style)\b.*?</\1>", "")
    c = replace_all(c, r"(?i)<br\s*/?>", "\n")
    c = replace_all(c, r"(?i)</(p|div|section|article|li|tr|h[1-6])\s*>|<li\b[^>]*>", "\n")
    c = replace_all(c, r"<[^>]+>", "")
    c = lf(unescape(c))
    for pattern, by in ((r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        c = replace_all(c, pattern, by)
    return trim(c)


def html_to_text_job(c: Column, strip: bool = True, entities: bool = True, spaces: bool = True) -> Column:
    """STR-03: the text of a whole page, each stage optional."""
    if strip:
        c = replace_all(c, r"(?is)<(script|style)\b.*?</\1>", "")
        c = replace_all(c, r"(?i)<br\s*/?>|</(p|div|li|h[1-6])\s*>", "\n")
        c = replace_all(c, r"<[^>]+>", "")
    if entities:
        c = unescape(c)
    if spaces:
        c = F.replace(F.replace(lf(c), F.lit("\xa0"), F.lit(" ")), F.lit("　"), F.lit("  "))
        for pattern, by in ((r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
            c = replace_all(c, pattern, by)
        c = trim(c)
    return c


def html_to_text_template(c: Column) -> Column:
    """STR-04: br, p and div only."""
    c = replace_all(c, r"(?is)<(script|style)\b.*?</\1>", "")
    c = replace_all(c, r"(?i)<br\s*/?>|</(p|div)\s*>", "\n")
    c = lf(unescape(replace_all(c, r"<[^>]+>", "")))
    return trim(replace_all(replace_all(c, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


def page_title(html: Column) -> Column:
    """STR-05: the first title element in one line; empty where there is none."""
    return F.coalesce(squash(unescape(replace_all(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", ""))), F.lit(""))


#: Page markers, hints to read on and navigation lines (STR-07). Fixed values.
PAGE_MARKERS = [
    (r"[（(]\s*第[0-9０-９]+\s*/\s*[0-9０-９]+\s*页\s*[)）]", ""),
    (r"(?im)^\s*.*(?:下一页继续阅读|本章未完，请点击下一页继续阅读).*$", ""),
    (r"(?im)^\s*.*(?:点击下一页|下一章|上一章)\s*$", ""),
]


#: Texts without any of these words are without the marker of the same place. Fixed values.
PAGE_MARKER_WORDS = [("页",), ("下一页继续阅读", "本章未完"), ("点击下一页", "下一章", "上一章")]


def without_page_markers(c: Column) -> Column:
    """STR-07; a pattern runs only over texts that hold its words."""


    def step(marker: tuple[str, str], words: Sequence[str]) -> Callable[[Column], Column]:
        pattern, by = java_pattern(marker[0]), marker[1]
        return lambda x: F.when(reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words)), replace_all(x, pattern, by)).otherwise(x)

    for marker, words in zip(PAGE_MARKERS, PAGE_MARKER_WORDS):
        c = let(c, step(marker, words))
    return trim(c)


def tidy(c: Column) -> Column:
    """STR-08: no blanks at line ends, no more than one blank line."""
    return trim(replace_all(replace_all(lf(c), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def without_title(c: Column, title: Column) -> Column:
    """STR-09: without the lines that equal the title, unless nothing else is left."""
    name = trim(F.coalesce(title, F.lit("")))

    def left(x: Column) -> Column:
        rest = trim(F.array_join(F.filter(F.split(x, "\n"), lambda line: trim(line) != name), "\n"))
        return F.when((name == "") | ~F.contains(x, name), x).otherwise(let(rest, lambda r: F.when(r == "", x).otherwise(r)))

    return let(trim(c), left)


def reflow(c: Column) -> Column:
    """WIN-03: lines joined to paragraphs; blank lines gone, each paragraph indented by two wide spaces.

    Whether a line opens a paragraph depends on it and the line before only, so no line waits for another.
    """
    lines = F.filter(F.transform(F.split(trim(lf(c)), "\n"), trim), lambda x: x != "")
    ended = lambda x: F.contains(F.lit(PARAGRAPH_ENDS), F.right(x, F.lit(1)))
    joined = lambda x, before: F.when(ended(before) | x.rlike(OWN_PARAGRAPH), F.concat(F.lit("\n" + INDENT), x)).otherwise(x)
    pieces = let(lines, lambda ls: F.zip_with(ls, F.concat(F.array(F.lit("。")), ls), joined))
    return F.coalesce(F.substr(F.array_join(pieces, ""), F.lit(2)), F.lit(""))


def rule_filters(c: Column, cleaners: Sequence[tuple[str, str]]) -> Column:
    """STR-10: a fragment's text first, then the rule's own replacements."""
    return trim(clean(F.when(c.rlike(r"<[a-zA-Z][^>]*>"), html_to_text(c)).otherwise(c), cleaners))


def content_pipeline(df: DataFrame, content: str, title: str, out: str = "text", rule: Sequence[tuple[str, str]] = (), remote: Sequence[tuple[str, str]] = (), repository: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """STR-11: rule filters, remote cleaners, repository cleaners, page markers, tidy, title, reflow.

    Each stage that needs its input more than once is a projection of its own, so nothing is computed twice.
    """
    stages = (
        lambda c: F.when(c.rlike(r"<[a-zA-Z][^>]*>"), html_to_text(c)).otherwise(c),
        lambda c: tidy(without_page_markers(clean(clean(trim(clean(c, rule)), remote), repository))),
        lambda c: without_title(c, F.col(title)),
        reflow,
    )
    df = df.withColumn(out, F.col(content))
    for stage in stages:
        df = df.withColumn(out, stage(F.col(out)))
    return df


def compare_key(c: Column) -> Column:
    """STR-12: for comparing without case (ß as ss, final sigma as any) and outer space; null counts as blank."""
    return F.translate(F.replace(F.lower(F.upper(trim(F.coalesce(c, F.lit(""))))), F.lit("ß"), F.lit("ss")), "ς", "σ")


def title_match(title: Column, keyword: Column) -> Column:
    """STR-13: exact, contains or other."""
    t, k = compare_key(title), compare_key(keyword)
    return F.when(k == "", "other").when(t == k, "exact").when(F.contains(t, k), "contains").otherwise("other")


def author_match(author: Column, expected: Column) -> Column:
    """STR-14: unspecified, missing, exact, contains or mismatch."""
    a, e = compare_key(author), compare_key(expected)
    return F.when(e == "", "unspecified").when(a == "", "missing").when(a == e, "exact").when(F.contains(a, e) | F.contains(e, a), "contains").otherwise("mismatch")


def truncate(c: Column, n: int) -> Column:
    """STR-15: at most n characters, the last an ellipsis where something is cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def slug(c: Column, default: str = "source") -> Column:
    """STR-16."""
    s = F.lower(replace_all(replace_all(trim(c), r"[^0-9A-Za-z一-鿿]+", "-"), r"^-+|-+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def file_name(c: Column, default: str = "novel") -> Column:
    """STR-17: reserved characters to "_", no outer spaces and dots."""
    s = replace_all(replace_all(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]+', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(s == "", default).otherwise(s)


def key(c: Column, n: int = 24) -> Column:
    """STR-18."""
    return F.substring(replace_all(replace_all(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z一-鿿]+", "-"), r"^-+|-+$", ""), 1, n)


def literal_pattern(c: Column) -> Column:
    """STR-19: a pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def list_argument(c: Column) -> Column:
    """STR-20: a JSON array of texts, or else parts between commas and lines; blanks dropped, order kept."""
    parts = F.coalesce(F.when(trim(c).startswith("["), F.from_json(c, "array<string>")), F.split(c, "[,\n]"))
    return F.array_distinct(F.filter(F.transform(parts, trim), lambda x: x != ""))


def bool_argument(c: Column) -> Column:
    """STR-21: null for what is no yes or no."""
    return F.when(compare_key(c).isin("1", "true", "yes", "y", "on"), True).when(compare_key(c).isin("0", "false", "no", "n", "off"), False)


def int_argument(c: Column, positive: bool = True) -> Column:
    """STR-21: null for what is no whole number of the wanted sign."""
    n = trim(c).try_cast("bigint")
    return F.when(n > 0 if positive else n >= 0, n)


def scope_tokens(c: Column) -> Column:
    """STR-22."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n|,，;；]"), lambda x: F.lower(trim(x))), lambda x: x != "")


def headers(c: Column) -> Column:
    """STR-23 and FLT-11: a map from JSON or "k: v" lines, control entries left out."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(trim(F.substring_index(x, ":", 1)), trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)))))
    m = F.coalesce(F.when(trim(c).startswith("{"), F.from_json(c, "map<string,string>")), pairs)
    return F.map_filter(m, lambda k, v: (k != "") & ~k.startswith("@") & ~F.lower(v).startswith("@js:") & ~F.lower(v).startswith("<js>"))
