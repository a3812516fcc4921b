"""Queries over extraction with fallback, attempts, probes and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract, probe, ranking
from ..session import table
from ..sources import readers
from .pages import _H1, PAGES, _pages, _squash
from .search import _CLASS, _HITS, _ORDER, _hits, _order


def preset_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return extract.with_fallback(_pages(spark, folder), "html", [extract.PRESETS[f] for f in ("wordpress-like", "novelpub-like", "novelfull-like")]).select("preview_id", "preset", "title")


def pattern_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("preview_id", extract.by_pattern(F.col("html"), r"<h9>(.*?)</h9>|<h1[^>]*>第(.*?)章|<h1[^>]*>(\d+)", 3).alias("number"))


def book_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Plans as JSON pages, read back by rules."""
    plans = table(spark, folder, "book_plan")
    body = F.to_json(F.struct(F.struct("book_name", "author", "intro", "toc_url").alias("book")))
    rules = {"init": "$.book", "name": "book_name", "author": "author", "intro": "intro##。.*$", "tocUrl": "toc_url"}
    return extract.book_plans(plans.select("plan_id", F.col("book_url").alias("url"), body.alias("body")), "body", "url", rules).drop("url")


def chapter_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of two pages each, walked, joined and cleaned."""
    src = _pages(spark, folder).groupBy("url").agg(F.min_by("html", "preview_id").alias("html"))
    first = src.select("url", F.concat("html", F.lit('<a id="next" href="?p=2">next</a>')).alias("html"))
    second = src.select(F.concat("url", F.lit("?p=2")).alias("url"), F.lit("<h1></h1><p>第二页。</p>").alias("html"))
    got = extract.chapter_texts(src.select(F.col("url").alias("start"), "url"), first.unionByName(second), {"title": "h1@text", "content": "p@text", "nextContentUrl": "#next@href"})
    return got.select(F.col("start").alias("url"), "title", F.col("content").endswith("第二页。").alias("whole"))


def candidate_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Of each keyword's hits in rank order those that would be tried until one with a known length succeeds."""
    ok = F.coalesce("supports_download", F.lit(False)) & F.col("word_count").isNotNull()
    return probe.attempts(_hits(spark, folder).where("match_keyword is not null"), "match_keyword", _order(), ok, 4).select("match_keyword", "attempt_index", "hit_id", "outcome")


def attempt_status(spark: SparkSession, folder: str) -> DataFrame:
    return probe.run_status(candidate_attempts(spark, folder), "match_keyword")


def probe_stages(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hit").groupBy("source_id").agg(F.count("*").alias("n"))
    plans = table(spark, folder, "book_plan").groupBy("source_id").agg(F.count("*").alias("n"))
    texts = table(spark, folder, "job").where("kind = 'chapter'").groupBy("source_id").agg(F.max(F.length("content")).alias("length"))
    return probe.probe_events(table(spark, folder, "book_source").select("source_id", "supports_search", "supports_download"), hits, plans, texts, 200)


def search_time_budget(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = table(spark, folder, "search_hit").select("match_keyword", "source_id").distinct().join(table(spark, folder, "search_source_stats").select("source_id", F.coalesce(F.round("avg_duration_ms"), F.lit(0.0)).alias("ms")), "source_id")
    return probe.within_time(outcomes, "match_keyword", ["source_id"], "ms", 9000.0)


def search_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How the search for each keyword went on the recorded times of the sources, nine seconds at most."""
    exact = F.count_if(X.title_match(F.col("title"), F.col("match_keyword")) == "exact")
    hits = table(spark, folder, "search_hit").where("match_keyword is not null").groupBy("match_keyword", "source_id").agg(F.count("*").alias("hits"), exact.alias("exact"))
    timed = search_time_budget(spark, folder).join(hits, ["match_keyword", "source_id"], "left").withColumn("error", F.when(F.coalesce("hits", F.lit(0)) == 0, "no hits")).withColumn("hits", F.when(F.col("progress") == "completed", F.col("hits")).otherwise(0))
    runs = timed.groupBy("match_keyword").agg(F.count("*").alias("sources")).withColumn("skipped_sources", F.lit(0).cast("bigint"))
    return probe.run_summary(timed, "match_keyword", runs, (F.col("progress") == "completed") & (F.col("exact") >= 3))


def search_index(spark: SparkSession, folder: str) -> DataFrame:
    """The kept searches, newest first, numbered."""
    kept = probe.cached(table(spark, folder, "search_hit").where("match_keyword is not null").withColumnRenamed("found_at", "at"), "match_keyword", ["hit_id"])
    return ranking.positions(probe.searches(kept), [-F.unix_micros("at"), F.col("search_id")]).select("position", "search_id", "items")


def remote_cleaners(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaners of every source's address, as a list, an object, lines or nothing."""
    w, name = F.col("weight") % 4, F.coalesce("name", F.lit("none"))
    rule = F.array(F.struct(name.alias("pattern"), F.lit("-").alias("replacement")), F.struct(F.lit("").alias("pattern"), F.lit("x").alias("replacement")))
    text = F.when(w == 0, F.to_json(rule)).when(w == 1, F.to_json(F.struct(rule.alias("cleaners")))).when(w == 2, F.concat(name, F.lit("##-\n# no\n##x")))
    return readers.remote_cleaners(table(spark, folder, "book_source").select(F.col("source_id").alias("ref"), text.alias("text")), "ref")


def search_cache(spark: SparkSession, folder: str) -> DataFrame:
    return probe.cached(table(spark, folder, "search_hit").where("match_keyword is not null"), "match_keyword", ["hit_id"]).select("search_id", "item", "hit_id")


QUERIES = {f.__name__: f for f in (preset_fallback, pattern_extract, book_pages, chapter_pages, candidate_attempts, attempt_status, probe_stages, search_time_budget, search_summary, search_index, remote_cleaners, search_cache)}

_P = r"regexp_extract_all(regexp_extract(html, '(?s)<div id=\"content\">(.*)', 1), '(?s)<p>(.*?)(?:</p>|$)', 1)"
_FULL = f"len(list_filter({_P}, lambda p: regexp_matches(regexp_replace(p, '<[^>]+>', '', 'g'), '[^\\s\\p{{Z}}]'))) > 0"
_ATTEMPTS = f"""SELECT match_keyword, attempt_index, hit_id, CASE WHEN ok THEN 'started' ELSE 'failed' END AS outcome FROM (
 SELECT *, coalesce(max(ok::INT) OVER (PARTITION BY match_keyword ORDER BY attempt_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT *, dl AND word_count IS NOT NULL AS ok, (row_number() OVER (PARTITION BY match_keyword ORDER BY {_ORDER}) - 1)::INT AS attempt_index FROM ({_HITS}) WHERE match_keyword IS NOT NULL) WHERE attempt_index < 4) WHERE before = 0"""
_TIMED = "SELECT match_keyword, source_id, ms, CASE WHEN done <= 9000 THEN 'completed' WHEN done - ms < 9000 THEN 'timed_out' ELSE 'unsearched' END AS progress FROM (SELECT *, sum(ms) OVER (PARTITION BY match_keyword ORDER BY source_id) AS done FROM (SELECT DISTINCT h.match_keyword, h.source_id, coalesce(round(avg_duration_ms), 0) AS ms FROM search_hit h JOIN search_source_stats USING (source_id)))"
_SEARCH_ID = "substr(regexp_replace(regexp_replace(match_keyword, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) || '-' || substr(sha1(match_keyword), 1, 10)"
SQL = {
    "search_summary": f"""
WITH h AS (SELECT match_keyword, source_id, count(*) AS hits, count(*) FILTER (WHERE {_CLASS} = 'exact') AS exact FROM search_hit WHERE match_keyword IS NOT NULL GROUP BY ALL),
r AS (SELECT t.match_keyword, count(*) AS n, count(*) FILTER (WHERE progress = 'completed') AS done, count(*) FILTER (WHERE progress = 'completed' AND coalesce(hits, 0) = 0) AS bad, count(*) FILTER (WHERE progress = 'timed_out') AS late, coalesce(sum(CASE WHEN progress = 'completed' THEN hits ELSE 0 END), 0)::BIGINT AS total, max(progress = 'completed' AND coalesce(exact, 0) >= 3) AS stopped
 FROM ({_TIMED}) t LEFT JOIN h ON h.match_keyword IS NOT DISTINCT FROM t.match_keyword AND h.source_id = t.source_id WHERE t.match_keyword IS NOT NULL GROUP BY t.match_keyword)
SELECT match_keyword, n AS candidate_sources, 0::BIGINT AS skipped_sources, done + late AS searched_sources, done AS completed_sources, greatest(0, done - bad) AS successful_sources, late AS timed_out_source_count, n - done - late AS unsearched_source_count, late > 0 OR stopped AS partial, late = 0 AND stopped AS early_stopped,
 CASE WHEN late > 0 THEN 'time_budget' WHEN stopped THEN 'exact_match_limit' ELSE '' END AS stop_reason, total AS result_count FROM r""",
    "search_index": f"SELECT row_number() OVER (ORDER BY seen DESC, search_id) AS position, search_id, items FROM (SELECT {_SEARCH_ID} AS search_id, max(found_at) AS seen, count(*) AS items FROM search_hit WHERE match_keyword IS NOT NULL GROUP BY 1)",
    "remote_cleaners": "SELECT source_id AS ref, 0 AS pos, coalesce(name, 'none') AS pattern, '-' AS replacement FROM book_source WHERE weight % 4 < 3 AND trim(coalesce(name, 'none')) <> ''",
    "preset_fallback": f"SELECT preview_id, CASE WHEN {_FULL} THEN 2 END::INT AS preset, CASE WHEN {_FULL} THEN {_H1} ELSE '' END AS title FROM ({PAGES})",
    "pattern_extract": r"SELECT preview_id, nullif(coalesce(nullif(regexp_extract(html, '(?s)<h1[^>]*>第(.*?)章', 1), ''), regexp_extract(html, '(?s)<h1[^>]*>(\d+)', 1)), '') AS number FROM (" + PAGES + ")",
    "book_pages": f"SELECT plan_id, coalesce({_squash('book_name')}, '') AS book_name, coalesce({_squash('author')}, '') AS author, regexp_replace(coalesce({_squash('intro')}, ''), '。.*$', '') AS intro, coalesce(nullif(toc_url, ''), book_url) AS toc_url FROM book_plan",
    "chapter_pages": f"SELECT url, {_H1} AS title, true AS whole FROM (SELECT url, arg_min(html, preview_id) AS html FROM ({PAGES}) GROUP BY url)",
    "candidate_attempts": _ATTEMPTS,
    "attempt_status": f"SELECT match_keyword, count(*) AS attempts, CASE WHEN count(*) FILTER (WHERE outcome = 'started') > 0 THEN 'started' ELSE 'exhausted' END AS status FROM ({_ATTEMPTS}) GROUP BY match_keyword",
    "probe_stages": """
WITH x AS (SELECT s.source_id, CASE WHEN NOT coalesce(supports_search, false) THEN 'unsupported' WHEN coalesce(h.n, 0) > 0 THEN 'healthy' ELSE 'broken' END AS a, coalesce(supports_download, false) AS d, coalesce(p.n, 0) AS pn, coalesce(t.l, 0) AS l
 FROM book_source s LEFT JOIN (SELECT source_id, count(*) AS n FROM search_hit GROUP BY 1) h USING (source_id) LEFT JOIN (SELECT source_id, count(*) AS n FROM book_plan GROUP BY 1) p USING (source_id) LEFT JOIN (SELECT source_id, max(length(content)) AS l FROM job WHERE kind = 'chapter' GROUP BY 1) t USING (source_id)),
y AS (SELECT *, CASE WHEN a = 'healthy' THEN CASE WHEN NOT d THEN 'unsupported' WHEN pn > 0 THEN 'healthy' ELSE 'broken' END END AS b FROM x)
SELECT source_id, 'search' AS stage, a AS state FROM y UNION ALL SELECT source_id, 'preflight', b FROM y WHERE b IS NOT NULL UNION ALL SELECT source_id, 'download', CASE WHEN l >= 200 THEN 'healthy' ELSE 'broken' END FROM y WHERE b = 'healthy'""",
    "search_time_budget": "SELECT match_keyword, source_id, ms, CASE WHEN done <= 9000 THEN 'completed' WHEN done - ms < 9000 THEN 'timed_out' ELSE 'unsearched' END AS progress FROM (SELECT *, sum(ms) OVER (PARTITION BY match_keyword ORDER BY source_id) AS done FROM (SELECT DISTINCT h.match_keyword, h.source_id, coalesce(round(avg_duration_ms), 0) AS ms FROM search_hit h JOIN search_source_stats USING (source_id)))",
    "search_cache": "SELECT substr(regexp_replace(regexp_replace(match_keyword, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) || '-' || substr(sha1(match_keyword), 1, 10) AS search_id, (row_number() OVER (PARTITION BY match_keyword ORDER BY hit_id) - 1)::INT AS item, hit_id FROM search_hit WHERE match_keyword IS NOT NULL",
}
