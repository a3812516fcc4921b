"""Rules as DataFrame expressions.

A rule that only needs a member path of JSON, a template of such, alternatives and cleaners becomes
native columns; everything else on one payload becomes a single Arrow function that parses the payload
once for all rules (the function is marked non-deterministic, so that no filter on its output makes it
run twice).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import urls
from ..session import ship
from . import language

NATIVE_PATH = re.compile(r"\$?\.?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\d+\])*")


def native(rule: str, json: Column) -> Column | None:
    """The rule as a native expression over a JSON text column, or None where it needs the function."""
    parts = []
    for alt in language.parse(rule):
        if alt.puts or alt.script or "@get:{" in alt.base:
            return None
        if alt.template:
            pieces, at = [], 0
            for m in language.HOLE.finditer(alt.base):
                done = language.folded(m[1])
                if done is None and not NATIVE_PATH.fullmatch(m[1]):
                    return None
                pieces += [F.lit(alt.base[at : m.start()]), F.lit(done) if done is not None else F.coalesce(X.squash(_member(json, m[1])), F.lit(""))]
                at = m.end()
            value = X.squash(X.clean(F.concat(*pieces, F.lit(alt.base[at:])), alt.cleaners))
        elif NATIVE_PATH.fullmatch(alt.base):
            value = X.clean(X.squash(_member(json, alt.base)), alt.cleaners)
        else:
            return None
        parts.append(X.blank_to_null(value))
    return F.coalesce(*parts, F.lit("")) if parts else F.lit("")


def _member(json: Column, path: str) -> Column:
    return F.get_json_object(json, "$." + path.lstrip("$."))


def extract(df: DataFrame, payload: str, rules: dict[str, str], joined: set[str] = frozenset(), kind: str | None = None) -> DataFrame:
    """``df`` with a column for each rule. kind "json" lets simple rules become native expressions."""
    out, rest = {}, {}
    for name, rule in rules.items():
        c = native(rule, F.col(payload)) if kind == "json" and name not in joined else None
        if c is None:
            rest[name] = rule
        else:
            out[name] = c
    df = df.withColumns(out) if out else df
    if not rest:
        return df
    ship(df.sparkSession)
    fields = T.StructType([T.StructField(n, T.StringType()) for n in rest])

    @F.pandas_udf(fields)
    def fused(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            p = language.payload(t)
            rows.append([(p.joined(r) if n in joined else p.scalar(r)) for n, r in rest.items()])
        return pd.DataFrame(rows, columns=list(rest))

    once = fused.asNondeterministic()
    return df.withColumn("_rules", once(F.col(payload))).withColumns({n: F.col(f"_rules.{n}") for n in rest}).drop("_rules")


LIST_PATH = re.compile(r"(\$?\.?(?:[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\d+\])*)?)\[\*\](?:\.(.+))?")


def native_items(rule: str, json: Column) -> Column | None:
    """The items of a list rule over a JSON text column as JSON texts (texts as they are), or None where it needs the function.

    Only a path with one "[*]" and members below it is native; cleaners are applied, null items left out.
    """
    alts = language.parse(rule)
    m = LIST_PATH.fullmatch(alts[0].base) if len(alts) == 1 else None
    if m is None or alts[0].puts or alts[0].script or alts[0].template or (m[2] and not NATIVE_PATH.fullmatch(m[2])):
        return None
    path = m[1].lstrip("$.")
    items = F.from_json(F.get_json_object(json, f"$.{path}" if path else "$"), "array<string>")
    if m[2]:
        items = F.transform(items, lambda x: _member(x, m[2]))
    items = F.filter(items, lambda x: x.isNotNull())
    return F.transform(items, lambda x: X.clean(X.squash(x), alts[0].cleaners)) if alts[0].cleaners else items


def extract_list(df: DataFrame, payload: str, rule: str, name: str = "values", kind: str | None = None) -> DataFrame:
    """EXT-03: ``df`` with an array column of all values as text. kind "json" lets plain paths stay in the JVM."""
    items = native_items(rule, F.col(payload)) if kind == "json" else None
    if items is not None:
        return df.withColumn(name, F.coalesce(F.transform(items, X.squash), F.array().cast("array<string>")))
    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def many(texts: pd.Series) -> pd.Series:
        return pd.Series([[language.text_of(v) for v in language.payload(t).many(rule)] for t in texts], dtype=object)

    return df.withColumn(name, many.asNondeterministic()(F.col(payload)))


HIT = "array<struct<title:string,book_url:string,author:string,cover_url:string,intro:string,kind:string,last_chapter:string,word_count:string,rule_vars:map<string,string>>>"


def _native_hits(df: DataFrame, payload: str, rules: dict[str, str], page: str, root: str) -> DataFrame | None:
    """The hits without the function, where the list and all fields are plain."""
    items = native_items(language.first_rule(rules, language.LIST_NAMES), F.col(payload)) if not rules.get("init") else None
    if items is None:
        return None
    fields = {f: native(language.first_rule(rules, names), F.col("_item")) for f, names in language.HIT_FIELDS.items()}
    if any(c is None for c in fields.values()):
        return None
    keep = [c for c in df.columns if c != payload]
    rows = df.select(*keep, F.posexplode(items).alias("_pos", "_item")).select(*keep, "_pos", *(c.alias(f) for f, c in fields.items())).where("title <> ''")
    where = {f: urls.absolute(F.col(f), F.coalesce(page, F.lit("")), F.lit(root)).alias(f) for f in ("book_url", "cover_url")}
    return rows.select(*keep, F.col("_pos").alias("pos"), *(where.get(f, F.col(f)) for f in fields), F.create_map().cast("map<string,string>").alias("rule_vars"))


def extract_hits(df: DataFrame, payload: str, rules: dict[str, str], page: str, root: str = "", kind: str | None = None) -> DataFrame:
    """EXT-30: a row for each search hit of each payload; the other columns are kept.

    kind "json" lets plain rules stay in the JVM; ``pos`` then counts the items of the list, else the hits.
    """
    done = _native_hits(df, payload, rules, page, root) if kind == "json" else None
    if done is not None:
        return done
    ship(df.sparkSession)

    @F.pandas_udf(HIT)
    def found(texts: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([language.hits(t or "", rules, p or "", root) for t, p in zip(texts, pages)], dtype=object)

    keep = [c for c in df.columns if c != payload]
    return df.withColumn("_hits", found.asNondeterministic()(F.col(payload), F.col(page))).select(*keep, F.posexplode("_hits").alias("pos", "_hit")).select(*keep, "pos", "_hit.*")
