"""Extraction over tables of pages: pattern extraction, site presets with fallback, plans and chapters
(EXT-31, EXT-33 to EXT-37, UDF-02)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from ..rules import language
from ..session import ship
from . import toc

#: Rules of three site families (EXT-36): selectors of a chapter's title and content, tried in order. Fixed values.
PRESETS: dict[str, dict[str, str]] = {
    "wordpress-like": {"title": "h1.entry-title@text||.breadcrumb .active@text||h1@text", "content": ".reading-content p@text||.entry-content p@text"},
    "novelpub-like": {"title": ".chapter-title@text||h1@text", "content": "#chapter-container p@text||.chapter-content p@text"},
    "novelfull-like": {"title": "a.chapter-title@text||h2@text||h1@text", "content": "#chapter-content p@text||#chr-content p@text||#content p@text"},
}


def by_pattern(c: Column, pattern: str, groups: int, flags: str = "s") -> Column:
    """EXT-34: of the first match the first non-empty group, or else the whole match; null where nothing matches.

    pattern: Python's writing; flags of i, m and s; groups: how many it has.
    """
    java = f"(?{''.join(f for f in flags if f in 'ims')})" + X.java_pattern(pattern)
    tries = [F.regexp_extract(c, java, g) for g in [*range(1, groups + 1), 0]]
    return F.coalesce(*(F.when(X.trim(t) != "", t) for t in tries))


def with_fallback(df: DataFrame, payload: str, presets: Sequence[dict[str, str]], fields: Sequence[str] = ("title", "content"), needed: str = "content") -> DataFrame:
    """EXT-35, EXT-37: the fields by the first preset that gives the needed one; ``preset`` is its number from 0, null if none does.

    Every payload is parsed once for all presets.
    """
    ship(df.sparkSession)
    kind = ", ".join(["preset int", *(f"`{f}` string" for f in fields)])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            p = language.payload(t)
            for n, rules in enumerate(presets):
                found = p.joined(rules.get(needed, ""))
                if found:
                    rows.append([n, *(found if f == needed else p.scalar(rules.get(f, "")) for f in fields)])
                    break
            else:
                rows.append([None, *("" for _ in fields)])
        return pd.DataFrame(rows, columns=["preset", *fields]).astype({"preset": "Int32"})

    return df.withColumn("_x", run.asNondeterministic()(F.col(payload))).withColumns({f: F.col(f"_x.{f}") for f in ("preset", *fields)}).drop("_x")


def preview(df: DataFrame, html: str, chars: int) -> DataFrame:
    """SRC-21: the title, and the first characters of the markup and of the text of each page, as title, html_preview and text_preview."""
    c = F.col(html)
    return df.withColumns({"title": X.page_title(c), "text_preview": F.substring(X.html_to_text(c), 1, chars), "html_preview": F.substring(c, 1, chars)})


#: Names of the fields of a book page (EXT-31). Fixed values.
BOOK_FIELDS = {"book_name": ("name", "bookName", "title"), "author": ("author",), "intro": ("intro", "desc"), "toc_url": ("tocUrl", "chapterUrl")}


def book_plans(pages: DataFrame, payload: str, url: str, rules: dict[str, str], root: str = "") -> DataFrame:
    """EXT-31: name, author, intro and the address of the chapter list of each book page; without one the page's own."""
    ship(pages.sparkSession)

    @F.pandas_udf("book_name string, author string, intro string, toc_url string")
    def run(texts: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for t, u in zip(texts, at):
            p = language.payload(t).init(rules.get("init", ""))
            got = {f: p.scalar(language.first_rule(rules, names)) for f, names in BOOK_FIELDS.items()}
            rows.append([got["book_name"], got["author"], got["intro"], language.absolute(got["toc_url"], u or "", root) or u])
        return pd.DataFrame(rows, columns=list(BOOK_FIELDS))

    return pages.withColumn("_x", run.asNondeterministic()(F.col(payload), F.col(url))).select("*", "_x.*").drop("_x", payload)


def whole_plans(plans: DataFrame, toc_pages: DataFrame, rules: dict[str, str], root: str = "", book: str = "url", max_pages: int = 200) -> DataFrame:
    """EXT-31 with its chapter list: plans as ``book_plans`` gives them, each with its chapters in order, their number, and an error where it has none.

    toc_pages: (url, html) of the list pages. Rows that only lead about (FLT-07) are left out.
    """
    listed = toc.chapter_lists(plans.select(F.col(book).alias("start"), F.col("toc_url").alias("url")), toc_pages, rules, root, max_pages)
    named = plans.select(F.col(book).alias("start"), F.col("toc_url").alias("_toc"), F.col("book_name").alias("_name"))
    rows = listed.withColumnRenamed("index", "pos").join(named, "start")
    kept = toc.reindexed(toc.without_noise(rows, "start", F.col("start"), F.col("_toc"), F.col("_name")), "start", ["pos"])
    lists = kept.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("index", "title", "url", "rule_vars"))).alias("toc"))
    out = plans.join(lists.withColumnRenamed("start", book), book, "left")
    return out.withColumn("toc_count", F.coalesce(F.size("toc"), F.lit(0))).withColumn("error", F.when(F.col("toc_count") == 0, "no chapter list"))


def chapter_texts(starts: DataFrame, pages: DataFrame, rules: dict[str, str], max_pages: int = 5, repository: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """EXT-33: (start, title, content): the pages of each chapter by their "next" links, joined and cleaned.

    starts: (start, url); pages: (url, html), one row for each address. Rules: title, content, nextContentUrl.
    """
    from ..rules import compile as rule_columns

    wanted = {"title": rules.get("title", ""), "content": rules.get("content", ""), "next": rules.get("nextContentUrl", "")}
    read = rule_columns.extract(pages, "html", wanted, joined={"content"})
    read = read.select(urls.normalised(F.col("url")).alias("url"), "title", "content", F.when(F.col("next") != "", urls.normalised(urls.absolute(F.col("next"), F.col("url"), urls.origin(F.col("url"))))).alias("next"))
    walk = toc.walked(starts.select("start", urls.normalised(F.col("url")).alias("url")), read.select("url", "next"), max_pages)
    joined = toc.joined_pages(walk.join(read.select("url", "title", "content"), "url"), "start", "page", "title", "content")
    return X.content_pipeline(joined.where(F.col("content") != ""), "content", "title", "content", repository=repository)
