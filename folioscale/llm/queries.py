"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import charset_repair, confusables, encode, entity_match, keyword_spam, leakage, page_body, template_residue
from .site_lines import SiteLines


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job").where(F.col("kind") == "chapter")


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Hits paired with the plan of their book, with a confidence."""
    columns = {"source": "source_id", "author": "author", "intro": "intro", "url": "book_url"}
    return entity_match.match(table(spark, folder, "search_hit"), table(spark, folder, "book_plan"), {"row": "hit_id", "title": "title"} | columns, {"row": "plan_id", "title": "book_name"} | columns)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hits that show the same book as a plan."""
    return p1_matches(spark, folder).select("plan_id", "hit_id")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of job and previews as pages."""
    jobs = _chapters(spark, folder).select(F.lit("job").alias("tab"), F.col("rec_id").alias("row_id"), F.col("source_id").alias("source"), "title", "content", F.lit(None).cast("string").alias("html"))
    previews = table(spark, folder, "fetch_preview").select(F.lit("fetch_preview").alias("tab"), F.col("preview_id").alias("row_id"), F.col("source_id").alias("source"), "title", F.col("text_preview").alias("content"), F.col("html_preview").alias("html"))
    return jobs.unionByName(previews)


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "book_source").select(F.col("source_id").alias("source"), "name")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of chapters and previews that are not story; records of p4_found and p5_found left out."""
    lines = page_body.furniture(_pages(spark, folder), _sites(spark, folder))
    bad = written(p4_found(spark, folder).unionByName(p5_found(spark, folder)).distinct(), "left-out").select(F.lit("job").alias("tab"), F.col("rec_id").alias("row_id"))
    return lines.join(bad, ["tab", "row_id"], "left_anti")


def p2_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every chapter and preview."""
    return page_body.bodies(_pages(spark, folder), _sites(spark, folder))


def _site_lines(spark: SparkSession, folder: str) -> SiteLines:
    return SiteLines(_chapters(spark, folder), source="source_id", job="job_id", chapter="index", content="content", row="rec_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the lines that a source repeats."""
    return _site_lines(spark, folder).marked().withColumnRenamed("row", "rec_id")


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters without the lines that their source repeats."""
    return _site_lines(spark, folder).removed().withColumnRenamed("row", "rec_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter records with template residue, filler or an error page in place of content."""
    jobs = _chapters(spark, folder)
    return template_residue.residue(jobs, "rec_id", "source_id", "title", "url", "content").withColumnRenamed("row", "rec_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter records garbled by a wrong decoding."""
    return charset_repair.garbled(_chapters(spark, folder), "rec_id", "content")


def p5_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled chapter records with their text restored as far as it can be."""
    return charset_repair.garbled(_chapters(spark, folder), "rec_id", "content", restore=True)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and authors with characters that imitate, split, compose or space out."""
    return confusables.deviations(table(spark, folder, "search_hit"), "hit_id", ["title", "author"]).withColumnRenamed("row", "hit_id")


def p7_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and authors in their one form."""
    return confusables.forms(table(spark, folder, "search_hit"), "hit_id", ["title", "author"]).withColumnRenamed("row", "hit_id")


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings grouped by equal skeleton."""
    return confusables.lookalike_groups(table(spark, folder, "search_hit"), "hit_id", ["title", "author"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item."""
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_item")
    return leakage.leaked(docs, "doc_id", "text", items, "item_id", "text").select("item_id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are search-engine bait or bare lists."""
    return keyword_spam.stuffed(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("row", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p7_found": p7_found,
    "p7_forms": p7_forms,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

SQL = {
    "p3_found": r"""
WITH pieces AS (
  SELECT rec_id, source_id, job_id, index, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM job WHERE kind = 'chapter' AND content IS NOT NULL),
keyed AS (
  SELECT rec_id, source_id, {'j': job_id, 'i': index} AS chapter, line_no,
         regexp_replace(regexp_replace(line, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', '', 'g'), '[0-9]+', '0', 'g') AS line FROM pieces),
chapters AS (SELECT source_id, count(DISTINCT chapter) AS n FROM keyed GROUP BY source_id),
lines AS (SELECT source_id, line, count(DISTINCT chapter) AS n FROM keyed WHERE line <> '' GROUP BY source_id, line)
SELECT k.rec_id, k.line_no::INT AS line_no FROM keyed k
JOIN lines l ON l.source_id IS NOT DISTINCT FROM k.source_id AND l.line = k.line
JOIN chapters c ON c.source_id IS NOT DISTINCT FROM k.source_id
WHERE l.n >= 5 AND l.n >= 0.04 * c.n
""",
}
