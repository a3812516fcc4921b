"""Chapter lists and pages: noise, order, pagination, samples
(FLT-07, FLT-08, WIN-01, WIN-02, WIN-07, EXT-32, EXT-33, AGG-14, AGG-15, JN-04)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from ..rules import language
from ..session import ship, written

#: Labels of order toggles among chapter links. Fixed values.
TOGGLES = ["[正序]", "[倒序]", "正序", "倒序"]


def without_noise(toc: DataFrame, group: str, book_url: Column, toc_url: Column, book_name: Column) -> DataFrame:
    """FLT-07: rows that lead back to the book or its list, repeat its name or toggle the order go, unless all would.

    toc: (group, pos, title, url). Rows without title or url go in any case (FLT-08).
    """
    link = urls.normalised(F.col("url"))
    noise = (link == urls.normalised(book_url)) | (link == urls.normalised(toc_url)) | ((X.compare_key(book_name) != "") & (X.compare_key(F.col("title")) == X.compare_key(book_name))) | X.compare_key(F.col("title")).isin(TOGGLES)
    full = toc.where((X.trim(F.coalesce("title", F.lit(""))) != "") & (X.trim(F.coalesce("url", F.lit(""))) != "")).withColumn("_noise", noise)
    left = F.sum(F.when(F.col("_noise"), 0).otherwise(1)).over(Window.partitionBy(group))
    return full.withColumn("_left", left).where(~F.col("_noise") | (F.col("_left") == 0)).drop("_noise", "_left")


def reindexed(df: DataFrame, group: str, order: Sequence[str], unique: str | None = None) -> DataFrame:
    """WIN-01 and WIN-02: of equal ``unique`` the first in order, then numbered from 0 without gaps."""
    if unique:
        w = Window.partitionBy(group, unique).orderBy(*order)
        df = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df.withColumn("index", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("int"))


def walked(starts: DataFrame, edges: DataFrame, max_pages: int) -> DataFrame:
    """EXT-32, EXT-33: (start, url, page): the pages reached by following "next" links, each once.

    starts: (start, url); edges: (url, next), at most one next for each url. A page that was seen
    before ends its walk. Links are doubled: after k joins a walk is 2^k pages long, so 200 pages take
    eight. Since a page has one next, all pages behind one seen before have been seen as well, and the first
    place of each is kept.
    """
    first = lambda df: df.groupBy("start", "url").agg(F.min("page").alias("page"))
    rows = written(first(starts.select("start", "url", F.lit(0).alias("page"))), "walk")
    links = edges.where("next is not null and next <> '' and url <> next").select(F.col("url").alias("_from"), F.col("next").alias("_to"))
    span, count = 1, -1
    while span < max_pages:
        more = rows.join(links, F.col("url") == F.col("_from")).select("start", F.col("_to").alias("url"), (F.col("page") + span).alias("page")).where(F.col("page") < max_pages)
        rows = written(first(rows.unionByName(more)), "walk")
        count, before = rows.count(), count
        if count == before:
            break
        span *= 2
        if span < max_pages:
            onward = links.select(F.col("_from").alias("_to"), F.col("_to").alias("_on"))
            links = written(links.join(onward, "_to").select("_from", F.col("_on").alias("_to")), "links")
    return rows


def chapter_lists(starts: DataFrame, pages: DataFrame, rules: dict[str, str], root: str = "", max_pages: int = 200) -> DataFrame:
    """EXT-32: (start, index, title, url, rule_vars): the chapters of each book's list, over all its pages.

    starts: (start, url); pages: (url, html), one row for each address. Every page is parsed once; rows without
    title or address go; of equal addresses the first stays; numbers run from 0. The page that repeats ends
    its list.
    """
    ship(starts.sparkSession)
    kind = "chapters array<struct<title: string, url: string, rule_vars: map<string, string>>>, next string"

    @F.pandas_udf(kind)
    def run(texts: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([language.toc(t, rules, u or "", root) for t, u in zip(texts, at)], columns=["chapters", "next"])

    key = urls.normalised(F.col("url")).alias("url")
    read = pages.select(key, run.asNondeterministic()(F.col("html"), F.col("url")).alias("_x")).select("url", "_x.chapters", F.when(F.col("_x.next") != "", urls.normalised(F.col("_x.next"))).alias("next"))
    read = written(read, "toc-pages")
    walk = walked(starts.select("start", key), read.select("url", "next"), max_pages)
    rows = walk.join(read.select("url", "chapters"), "url").select("start", "page", F.posexplode("chapters").alias("pos", "c")).select("start", "page", "pos", "c.*")
    return reindexed(rows, "start", ["page", "pos"], "url").select("start", "index", "title", "url", "rule_vars")


def joined_pages(pages: DataFrame, group: str, order: str, title: str, content: str) -> DataFrame:
    """AGG-14 and AGG-15: the last non-blank title, and the non-blank segments in order with a blank line between.

    The pages of one chapter are few (EXT-33 bounds them).
    """
    filled = X.trim(F.coalesce(content, F.lit(""))) != ""
    parts = F.array_sort(F.collect_list(F.when(filled, F.struct(F.col(order).alias("o"), F.col(content).alias("c")))))
    return pages.groupBy(group).agg(
        F.coalesce(F.max_by(title, F.when(X.trim(F.coalesce(title, F.lit(""))) != "", F.col(order))), F.lit("")).alias("title"),
        F.array_join(F.transform(parts, lambda p: p["c"]), "\n\n").alias("content"),
    )


def samples(df: DataFrame, group: str, order: Sequence[str], size: int = 3) -> DataFrame:
    """WIN-07: of each group's n rows those at 0, n/2 and n-1, filled up in order to ``size``; all if there are no more."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if size <= 1:
        return ranked.where("_pos = 0").drop("_pos", "_n")
    fixed = [F.lit(0), F.floor(F.col("_n") / 2), F.col("_n") - 1][: max(2, min(size, 3))]
    first = F.array_position(F.array(*[f.cast("bigint") for f in fixed]), F.col("_pos").cast("bigint"))
    choice = F.row_number().over(w.orderBy(F.when(first > 0, first).otherwise(len(fixed) + 1), "_pos"))
    return ranked.withColumn("_choice", choice).where(F.col("_choice") <= size).drop("_pos", "_n", "_choice")


def restored(rows: DataFrame, saved: DataFrame, book: str, url: str, index: str, value: str) -> DataFrame:
    """JN-04: ``value`` of the saved row of the same book and equal url, or else of equal index (0 is an index like any other)."""
    by_url = saved.where(F.col(url).isNotNull()).groupBy(book, url).agg(F.min_by(value, index).alias("_by_url"))
    by_index = saved.where(F.col(index).isNotNull()).groupBy(book, index).agg(F.min_by(value, url).alias("_by_index"))
    return rows.join(by_url, [book, url], "left").join(by_index, [book, index], "left").withColumn(value, F.coalesce("_by_url", "_by_index")).drop("_by_url", "_by_index")
