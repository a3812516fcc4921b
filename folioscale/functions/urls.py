"""Addresses and stable ids as native column expressions (URL-*, HSH-*, DAT-*, JSN-02)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import file_name, replace_all, slug, trim

PARTS = r"^([A-Za-z][\w+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def normalised(c: Column) -> Column:
    """URL-01: scheme and host lower, no slash at the end, no fragment, query kept; "" for null."""
    c = trim(F.coalesce(c, F.lit("")))
    path = replace_all(F.regexp_extract(c, PARTS, 3), "/+$", "")
    whole = F.concat(F.lower(F.regexp_extract(c, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(c, PARTS, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(c, PARTS, 4))
    return F.when(c == "", "").when(c.rlike(PARTS), whole).otherwise(replace_all(c, "#.*$", ""))


def origin(c: Column) -> Column:
    """URL-05: scheme and host; "" where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1), F.lit(""))


def without_dots(c: Column) -> Column:
    """The path of an address without its "." and ".." parts."""
    head, path, tail = F.regexp_extract(c, r"^([A-Za-z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(c, r"^[A-Za-z][\w+.-]*://[^/?#]*/?([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    ends = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.when(c.rlike(r"^[A-Za-z][\w+.-]*://[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(head, F.lit("/"), F.array_join(ends, "/"), tail)).otherwise(c)


def absolute(url: Column, page: Column, root: Column) -> Column:
    """URL-02: as it is, against the root from "/", or else against the page's folder; "." and ".." are resolved."""
    folder = F.regexp_extract(page, r"^([A-Za-z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.regexp_extract(page, r"^([^?#]*)", 1)
    joined = (
        F.when(url.startswith("//"), F.concat(F.regexp_extract(page, "^([A-Za-z][\\w+.-]*:)", 1), url))
        .when(url.startswith("/"), F.concat(F.when(root.rlike("^https?://"), origin(root)).otherwise(origin(page)), url))
        .when(url.startswith("?"), F.concat(bare, url))
        .when(url.startswith("#"), F.concat(F.regexp_extract(page, r"^([^#]*)", 1), url))
        .otherwise(F.concat(folder, url))
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(F.contains(url, F.lit("://")), url).otherwise(without_dots(joined))


def percent_encoded(c: Column, charset: str = "utf-8") -> Column:
    """URL-03: a request component in a charset (what it lacks becomes "?")."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else quote(x.encode(charset, "replace"), safe=""))

    return run(c)


def request_options(c: Column) -> tuple[Column, Column]:
    """URL-04: (address, options as a map) of ``url,{...}``; no options where they do not parse.

    Options are JSON, or else the same with single quotes, True, False and None.
    """
    text = F.regexp_extract(c, r"(?s),\s*(\{.*\})\s*$", 1)
    literal = replace_all(replace_all(replace_all(replace_all(text, r"(?i)\bTrue\b", "true"), r"(?i)\bFalse\b", "false"), r"(?i)\bNone\b", "null"), r"'((?:[^'\"\\\\])*)'", '"$1"')
    read = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, "map<string,string>"))
    options = F.coalesce(read(text), read(literal))
    has = c.rlike(r"(?s),\s*\{.*\}\s*$") & options.isNotNull() & (F.size(options) > 0)
    return F.when(has, trim(F.regexp_extract(c, r"(?s)^(.*?),\s*\{", 1))).otherwise(c), F.when(has, options)


def request_url(template: str, keyword: Column, base: Column, page: int = 1) -> Column:
    """EXT-23: the holes of a request template filled; unknown ones empty."""
    encoded = F.replace(F.url_encode(keyword), F.lit("+"), F.lit("%20"))
    c: Column = F.lit(template)
    for name, value in (("key", keyword), ("keyword", keyword), ("keyEncoded", encoded), ("key_encoded", encoded), ("page", F.lit(str(page))), ("baseUrl", base), ("base_url", base)):
        c = F.replace(c, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return replace_all(c, r"\{\{[^{}]*\}\}", "")


def _json_text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def source_id(name: Column, url: Column) -> Column:
    """HSH-01: slug, and twelve digits of the hash of name and address as sorted JSON."""
    text = F.concat(F.lit('{"name": '), _json_text(trim(name)), F.lit(', "source_url": '), _json_text(trim(url)), F.lit("}"))
    return F.concat(F.substring(slug(name), 1, 32), F.lit("-"), F.substring(F.sha1(text), 1, 12))


def _json_value(c: Column, kind: T.DataType) -> Column:
    """JSON with ", " and ": " between and keys in order, as the sources of job names write it."""
    if isinstance(kind, T.ArrayType):
        items = F.array_join(F.transform(c, lambda x: _json_value(x, kind.elementType)), ", ")
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("["), items, F.lit("]")))
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(f'"{f.name}": '), _json_value(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))
    if isinstance(kind, T.StringType):
        return F.when(c.isNull(), "null").otherwise(_escaped(c))
    return F.coalesce(c.cast("string"), F.lit("null"))


def _escaped(c: Column) -> Column:
    """A JSON text by Spark's own writer, which escapes as little as Python's does."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def job_id(book: Column, toc: Column, kind: T.DataType) -> Column:
    """HSH-02: the same book with the same chapters is the same job. kind: the type of ``toc``."""
    text = F.concat(F.lit('{"book_name": '), _escaped(F.coalesce(book, F.lit(""))), F.lit(', "toc": '), _json_value(toc, kind), F.lit("}"))
    return F.concat(F.substring(file_name(book), 1, 24), F.lit("-"), F.substring(F.sha1(text), 1, 12))


def short_hash(c: Column, n: int = 10) -> Column:
    """HSH-03: the head of a hash, for repositories, searches and signatures."""
    return F.substring(F.sha1(c), 1, n)


def epoch_text(c: Column) -> Column:
    """DAT-01: epoch seconds, or milliseconds from 1e11, as minutes of the session's zone; other texts unchanged."""
    n = trim(c).try_cast("double")
    return F.when(n.isNull(), c).otherwise(F.date_format(F.timestamp_seconds(F.when(F.abs(n) >= 1e11, n / 1000).otherwise(n)), "yyyy-MM-dd HH:mm"))


def run_id(at: Column) -> Column:
    """DAT-02: a time as the name of a run, in the session's zone."""
    return F.date_format(at, "yyyyMMddHHmmss")


def merged(base: Column, patch: Column) -> Column:
    """MAP-01, one level: the patch's entries win."""
    base, patch = F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(patch, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def merged_json(base: Column, patch: Column, known: Sequence[str] | None = None) -> Column:
    """JSN-02: JSON objects merged at every level, the patch's values winning; keys in order.

    Null bases and patches are empty objects. A patch key that is not among ``known`` fails the query.
    """

    def deep(a: dict, b: dict) -> dict:
        return a | {k: deep(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    @F.pandas_udf("string")
    def run(bases: pd.Series, patches: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(bases, patches):
            a, b = json.loads(a) if isinstance(a, str) else {}, json.loads(b) if isinstance(b, str) else {}
            if known is not None and (odd := sorted(set(b) - set(known))):
                raise ValueError(f"unknown keys: {', '.join(odd)}")
            out.append(json.dumps(deep(a, b), ensure_ascii=False, sort_keys=True))
        return pd.Series(out, dtype=object)

    return run(base, patch)
