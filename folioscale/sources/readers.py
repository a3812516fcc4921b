"""Readers of rule files, journals and fetched bytes (SRC-01, SRC-02, SRC-06 to SRC-13, SRC-18, SRC-20, SRC-22)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from . import capability

#: Encodings that are tried after the declared one. Fixed values.
CASCADE = ["utf-8", "gb18030", "gbk", "big5"]


def text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """SRC-01: (ref, text) of whole files; a text that is no path is the caller's to give as a row."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("ref"), F.col("value").alias("text"))


def byte_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: (ref, bytes, text), decoded by the cascade."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.col("path").alias("ref"), F.col("content").alias("bytes")).withColumn("text", decoded(F.col("bytes")))


def sniffed(data: Column) -> Column:
    """SRC-06: the charset named in the first 4096 bytes, or else utf-8."""
    found = F.lower(F.regexp_extract(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), r"(?i)charset=[\"']?([\w-]+)", 1))
    return F.when(found == "", "utf-8").otherwise(found)


def decoded(data: Column, declared: Column | None = None) -> Column:
    """SRC-07: the first of declared (or sniffed), utf-8, gb18030, gbk, big5 that decodes strictly; or else utf-8 with replacements."""

    @F.pandas_udf("string")
    def run(blobs: pd.Series, names: pd.Series) -> pd.Series:
        def one(blob: bytes | None, name: str | None) -> str | None:
            if blob is None:
                return None
            for e in [name or "utf-8", *CASCADE]:
                try:
                    return blob.decode(e)
                except (UnicodeDecodeError, LookupError):
                    continue
            return blob.decode("utf-8", "replace")

        return pd.Series([one(b, n) for b, n in zip(blobs, names)], dtype=object)

    return run(data, sniffed(data) if declared is None else declared)


def payload_kind(text: Column) -> Column:
    """SRC-08: json if the whole text parses as it, or else html."""
    return F.when(F.try_parse_json(text).isNotNull(), "json").otherwise("html")


RAW = "map<string,string>"


def source_definitions(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC-09: (pos, source): a row for each source of a JSON object, array or {"sources": [...]}.

    source is a map of the top-level entries, nested ones as JSON text. An entry that is no object has a
    null source; the caller decides whether that is an error.
    """
    whole = X.trim(F.col(text))
    listed = F.get_json_object(whole, "$.sources")
    array = F.when(whole.startswith("["), whole).when(listed.isNotNull(), listed).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    items = F.from_json(array, "array<string>")
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(items).alias("pos", "item")).select(*keep, "pos", F.when(X.trim(F.col("item")).startswith("{"), F.from_json("item", RAW)).alias("source"))


def clean_rules_json(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC-11: (pos, name, pattern, replacement, is_regex, enabled, scope, skipped): rules of a list or of
    rules / items / data / replaceRules. Rules with script replacements or for titles only are skipped, with the reason."""
    whole = X.trim(F.col(text))
    inner = F.coalesce(*(F.get_json_object(whole, f"$.{n}") for n in ("rules", "items", "data", "replaceRules")))
    items = F.from_json(F.when(whole.startswith("["), whole).otherwise(inner), f"array<{RAW}>")
    keep = [c for c in df.columns if c != text]
    r = lambda *names: F.coalesce(*(X.blank_to_null(F.col("r")[n]) for n in names))
    rows = df.select(*keep, F.posexplode(items).alias("pos", "r")).select(
        *keep, "pos", F.coalesce(r("name"), F.lit("")).alias("name"), F.coalesce(r("pattern", "regex"), F.lit("")).alias("pattern"), F.coalesce(F.col("r")["replacement"], F.lit("")).alias("replacement"),
        F.coalesce(X.bool_argument(r("isRegex", "is_regex")), F.lit(True)).alias("is_regex"), F.coalesce(X.bool_argument(r("isEnabled", "enabled")), F.lit(True)).alias("enabled"), X.scope_tokens(r("scope")).alias("scope"),
        F.coalesce(X.bool_argument(r("scopeTitle")), F.lit(False)).alias("_title"), F.coalesce(X.bool_argument(r("scopeContent")), F.lit(True)).alias("_content"),
    )
    script = F.lower(X.trim(F.col("replacement"))).rlike("^(@js:|<js>)")
    return rows.withColumn("skipped", F.when(F.col("pattern") == "", "empty pattern").when(script, "script replacement").when(F.col("_title") & ~F.col("_content"), "title only")).drop("_title", "_content")


def clean_rules_text(df: DataFrame, text: str = "text") -> DataFrame:
    """SRC-12, SRC-13: (pos, pattern, replacement) of lines "pattern##replacement"; blank lines and those from "#" on are none."""
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.posexplode(F.split(X.lf(F.col(text)), "\n")).alias("pos", "line")).where((X.trim(F.col("line")) != "") & ~X.trim(F.col("line")).startswith("#"))
    parts = F.split("line", "##", 2)
    return rows.select(*keep, "pos", X.trim(parts[0]).alias("pattern"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("replacement")).where("pattern <> ''")


def remote_cleaners(df: DataFrame, ref: str, text: str = "text") -> DataFrame:
    """SRC-13, SRC-14: (ref, pos, pattern, replacement): the cleaners of each address, each address read once.

    text: what the address gave, null where it gave nothing (that is remembered like any other answer: no
    cleaners). It is a JSON list or an object's "rules" or "cleaners", or else lines as in SRC-12.
    """
    once = df.select(ref, text).groupBy(ref).agg(F.max(text).alias(text))
    whole = X.trim(F.coalesce(F.col(text), F.lit("")))
    is_json = F.try_parse_json(whole).isNotNull() & whole.rlike(r"^[\[{]")
    listed = F.coalesce(F.when(whole.startswith("["), whole), F.get_json_object(whole, "$.rules"), F.get_json_object(whole, "$.cleaners"))
    rows = once.where(is_json).select(ref, F.posexplode(F.from_json(listed, f"array<{RAW}>")).alias("pos", "r"))
    first = lambda *names: F.coalesce(*(F.col("r")[n] for n in names), F.lit(""))
    from_json = rows.select(ref, "pos", X.trim(first("pattern", "regex")).alias("pattern"), first("replacement", "replace").alias("replacement")).where("pattern <> ''")
    return from_json.unionByName(clean_rules_text(once.where(~is_json), text).select(ref, "pos", "pattern", "replacement"))


def journal_lines(df: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """SRC-18: (pos, corrupt, record) of JSON lines; a last line without an end is torn and left out."""
    keep = [c for c in df.columns if c != text]
    whole = F.regexp_replace(F.col(text), r"[^\n]+\z", "")
    rows = df.select(*keep, F.posexplode(F.split(whole, "\n")).alias("pos", "line")).where(X.trim(F.col("line")) != "")
    got = F.when(F.try_parse_json("line").isNotNull() & X.trim(F.col("line")).startswith("{"), F.from_json("line", schema))
    return rows.select(*keep, "pos", got.isNull().alias("corrupt"), got.alias("record"))


def new_refs(refs: DataFrame, done: DataFrame, now: float, running_seconds: float = 1800.0) -> DataFrame:
    """SRC-22: the (ref, signature) that neither succeeded nor run since less than ``running_seconds``."""
    blocking = done.where((F.col("status") == "succeeded") | ((F.col("status") == "running") & (F.lit(now) - F.col("at") < running_seconds)))
    return refs.join(blocking.select("ref", "signature"), ["ref", "signature"], "left_anti")


def backfilled(current: DataFrame, legacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SRC-20: legacy rows added where no row of their key is there yet."""
    return current.unionByName(legacy.join(current.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def fetched(requests: DataFrame, store: DataFrame, id: str = "id") -> DataFrame:
    """SRC-03: (id, url, text, error): pages of a page store for requests "address,{options}".

    store: (url, bytes, charset), one row for each address; charset may be null. A request that needs a
    browser or a script is refused (FLT-10); the charset of the options wins over the store's, then the
    cascade decides. A body makes a POST, whose page the store holds under "address body".
    """
    address, options = urls.request_options(F.col("url"))
    asked = requests.select(id, address.alias("_address"), options.alias("_options"))
    refusal = capability.request_refusal(F.col("_options"))
    body = X.blank_to_null(F.col("_options")["body"])
    key = F.concat_ws(" ", urls.normalised(F.col("_address")), body)
    asked = asked.select(id, key.alias("_key"), refusal.alias("_refused"), F.col("_options")["charset"].alias("_charset"))
    held = store.select(urls.normalised(F.substring_index("url", " ", 1)).alias("_at"), F.regexp_extract("url", r"^\S+ (.*)$", 1).alias("_body"), F.col("url").alias("_url"), F.col("bytes").alias("_bytes"), F.col("charset").alias("_stored"))
    held = held.select(F.concat_ws(" ", "_at", F.when(F.col("_body") != "", F.col("_body"))).alias("_key"), "_url", "_bytes", "_stored")
    got = asked.join(held, "_key", "left")
    named = F.coalesce(X.blank_to_null(F.col("_charset")), X.blank_to_null(F.col("_stored")), sniffed(F.col("_bytes")))
    error = F.when(F.col("_refused").isNotNull(), F.concat(F.lit("refused: "), F.col("_refused"))).when(F.col("_bytes").isNull(), "page not found")
    return got.withColumn("error", error).select(id, F.col("_url").alias("url"), F.when(F.col("error").isNull(), decoded(F.col("_bytes"), named)).alias("text"), "error")
