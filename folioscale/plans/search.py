"""Queries over search hits, sources and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import present, ranking, toc
from ..session import table
from ..sources import capability
from . import jobs

STATS = ("attempts", "successes", "failures", "timeouts", "avg_duration_ms", "avg_success_ms", "last_success_at", "last_failure_at")
#: The tables' names of site families, and ours.
TABLE_FAMILIES = {"generic": "generic_html", "novelpub-like": "novelpub_like", "wordpress-like": "wordpress_madara_like", "novelfull-like": "novelfull_like", "json_api": "json_api"}
#: Clean rules of the demonstration query: (repo, seq, pattern, replacement, scope).
RULES = [(1, 0, "一", "", []), (1, 1, "二", "x", ["moyu"]), (1, 2, "三", "", ["re:^(shiye|dengxia)"]), (1, 3, "四", "", ["re:("]), (2, 0, "一", "", []), (2, 1, "五", "", ["文学", "example"])]


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "book_source").select("source_id", "supports_download")
    return table(spark, folder, "search_hit").join(known, "source_id", "left")


def _order() -> list:
    return [*ranking.hit_order(F.col("title"), F.col("author"), F.col("match_keyword"), F.coalesce("supports_download", F.lit(False))), F.col("hit_id")]


def search_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The five best hits of every keyword."""
    return ranking.first_per_group(_hits(spark, folder), ["match_keyword"], _order(), 5).select("match_keyword", "rank", "hit_id", X.title_match(F.col("title"), F.col("match_keyword")).alias("title_match"))


def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """LIM-02: the twenty best hits, with how many there are."""
    return present.page(_hits(spark, folder), _order(), 0, 20).select("hit_id", "title", F.col("total").alias("result_count"))


def search_per_source_limit(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.first_per_group(table(spark, folder, "search_hit"), ["source_id", "match_keyword"], [F.col("hit_id")], 3).select("source_id", "match_keyword", "hit_id", "rank")


def _extractor(family: Column) -> Column:
    """The extractor of the tables' names of families."""
    names = F.create_map(*(F.lit(x) for pair in TABLE_FAMILIES.items() for x in pair))
    return F.element_at(capability.preferred_extractors(F.coalesce(names[family], F.lit("generic_html"))), 1)


def source_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The searchable sources in the order in which they are asked."""
    df = table(spark, folder, "book_source").where("enabled and supports_search").join(table(spark, folder, "search_source_stats").drop("updated_at"), "source_id", "left")
    stats = {k: F.col(k) for k in STATS}
    order = ranking.priority_order(ranking.runtime_state(stats), F.col("supports_download"), stats, F.when(F.col("template_family").isNotNull(), _extractor(F.col("template_family"))))
    return ranking.positions(df, [*order, F.col("source_id")]).select("position", "source_id")


def search_skips(spark: SparkSession, folder: str) -> DataFrame:
    """Why a source is not searched; null where it is. Sources that have only failed count as unsupported here."""
    df = table(spark, folder, "book_source").join(table(spark, folder, "search_source_stats").select("source_id", "attempts", "successes", "failures"), "source_id", "left")
    state = F.when((F.col("failures") > 0) & (F.col("successes") == 0), "unsupported").otherwise("healthy")
    summary = ranking.stage_summary(F.concat(F.lit("失败 "), F.col("failures").cast("string")), F.lit(None), state)
    return df.select("source_id", ranking.search_skip_reason(F.col("supports_search"), F.col("issues"), state, summary).alias("reason"))


def identity_check(spark: SparkSession, folder: str) -> DataFrame:
    """Of the hits on a planned page what is not the plan's title or author."""
    hits = table(spark, folder, "search_hit").select("hit_id", "book_url", "title", "author")
    plans = table(spark, folder, "book_plan").select("plan_id", "book_url", F.col("book_name").alias("expected_title"), F.col("author").alias("expected_author"))
    got = hits.join(plans, "book_url")
    return got.select("hit_id", "plan_id", ranking.identity_mismatch(F.col("title"), F.col("author"), F.col("expected_title"), F.col("expected_author")).alias("mismatch"))


def candidate_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked candidates of every keyword, the author of the first plan of that name being expected."""
    expected = table(spark, folder, "book_plan").groupBy(F.col("book_name").alias("match_keyword")).agg(F.min_by("author", "plan_id").alias("expected"))
    hits = table(spark, folder, "search_hit").join(expected, "match_keyword", "left")
    sources = table(spark, folder, "book_source").select("source_id", "name", "supports_download", "issues", _extractor(F.col("template_family")).alias("extractor"))
    searched = table(spark, folder, "search_source_stats").select("source_id", ranking.runtime_state({k: F.col(k) for k in STATS}).alias("search"))
    health = jobs.health_by_stage(spark, folder).drop("search").join(searched, "source_id", "left")
    got = ranking.candidates(hits, sources, health, author=F.col("expected"))
    return got.select("match_keyword", "position", "hit_id", "title_match", "author_match", "search_state", "preflight_state", "download_state", "skip_reason")


def search_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """For each keyword the sources that are asked until three exact titles are found."""
    exact = F.count_if(X.title_match(F.col("title"), F.col("match_keyword")) == "exact").alias("exact")
    outcomes = table(spark, folder, "search_hit").groupBy("match_keyword", "source_id").agg(exact, F.count("*").alias("hits"))
    return ranking.early_stop(outcomes, "match_keyword", ["source_id"], "exact", 3)


def search_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Of each keyword's run: sources asked, hits, sources with an exact hit."""
    exact = X.title_match(F.col("title"), F.col("match_keyword")) == "exact"
    per = table(spark, folder, "search_hit").groupBy("match_keyword", "source_id").agg(F.count("*").alias("hits"), F.count_if(exact).alias("exact"))
    return per.groupBy("match_keyword").agg(F.count("*").alias("sources"), F.sum("hits").alias("hits"), F.count_if(F.col("exact") > 0).alias("successful"), F.max(F.when(F.col("exact") > 0, F.col("source_id"))).alias("last_successful"))


def author_classes(spark: SparkSession, folder: str) -> DataFrame:
    hits, plans = table(spark, folder, "search_hit"), table(spark, folder, "book_plan").groupBy("book_name").agg(F.min_by("author", "plan_id").alias("expected"))
    return hits.join(plans, hits["title"] == plans["book_name"]).select("hit_id", X.author_match(F.col("author"), F.col("expected")).alias("author_match"))


def toc_clean(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "book_plan").select("plan_id", "book_url", "toc_url", "book_name", F.posexplode("toc").alias("pos", "c")).select("*", F.col("c.title").alias("title"), F.col("c.url").alias("url")).drop("c")
    kept = toc.without_noise(rows, "plan_id", F.col("book_url"), F.col("toc_url"), F.col("book_name"))
    return toc.reindexed(kept, "plan_id", ["pos"], "url").select("plan_id", "index", "title", "url")


def next_pages(spark: SparkSession, folder: str) -> DataFrame:
    """From each plan's first chapter along the links to the next one, five pages at most."""
    plans = table(spark, folder, "book_plan").where("size(toc) > 0")
    edges = plans.select(F.posexplode(F.expr("transform(toc, (x, i) -> struct(x.url as url, get(toc, i + 1).url as next))")).alias("pos", "e")).select("e.url", "e.next").groupBy("url").agg(F.min("next").alias("next"))
    starts = plans.select(F.col("plan_id").alias("start"), F.expr("get(toc, 0).url").alias("url"))
    return toc.walked(starts, edges, 5).select(F.col("start").alias("plan_id"), "page", "url")


def toc_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The chapters of every plan read back from list pages of seven entries that lead on to each other."""
    plans = table(spark, folder, "book_plan").where("size(toc) > 0 and toc_url is not null").groupBy(F.regexp_replace("toc_url", "#.*$", "").alias("toc_url")).agg(F.min_by("toc", "plan_id").alias("toc"))
    cut = plans.select("toc_url", F.posexplode(F.expr("transform(sequence(0, size(toc) - 1, 7), i -> slice(toc, i + 1, 7))")).alias("page", "part"), F.size("toc").alias("n"))
    at = lambda page: F.concat("toc_url", F.lit("?list="), page.cast("string"))
    body = F.to_json(F.struct(F.expr("transform(part, c -> struct(c.title as title, c.url as url))").alias("list"), F.when((F.col("page") + 1) * 7 < F.col("n"), at(F.col("page") + 1)).alias("next")))
    pages = cut.select(at(F.col("page")).alias("url"), body.alias("html"))
    starts = plans.select(F.col("toc_url").alias("start"), F.concat("toc_url", F.lit("?list=0")).alias("url"))
    got = toc.chapter_lists(starts, pages, {"chapterList": "$.list[*]", "chapterName": "title", "chapterUrl": "url", "nextTocUrl": "$.next"})
    return got.select(F.col("start").alias("toc_url"), "index", "title", "url")


def sample_positions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "book_plan").select("plan_id", F.posexplode("toc").alias("pos", "c")).select("plan_id", "pos", F.col("c.url").alias("url"))
    return toc.samples(rows, "plan_id", ["pos"], 3)


def source_listing(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.when(F.col("enabled"), 0).otherwise(1), F.coalesce("name", F.lit("")), F.col("source_id")]
    return present.page(table(spark, folder, "book_source").select("source_id", "name", "enabled"), order, 5, 10).drop("enabled")


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "book_source").groupBy("template_family").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), F.count_if("supports_search").alias("search"), F.count_if("supports_download").alias("download"), F.sum(F.size("issues")).alias("issues"))


def clean_rule_scope(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "repo int, seq int, pattern string, replacement string, scope array<string>")
    return capability.in_scope(rules, table(spark, folder, "book_source"), ["source_id", "name", "base_url"])


def page_window(spark: SparkSession, folder: str) -> DataFrame:
    return present.page(table(spark, folder, "search_hit").select("hit_id", "title"), [F.col("hit_id").desc()], 40, 25)


def response_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Of each keyword's hits those that fit 400 characters of JSON."""
    rows = table(spark, folder, "search_hit").where("match_keyword is not null").select("match_keyword", "hit_id", "source_id")
    return present.within_budget(rows, "match_keyword", [F.col("hit_id")], 400)


QUERIES = {
    f.__name__: f
    for f in (search_rank, search_topk, search_per_source_limit, source_priority, search_skips, identity_check, candidate_resolution, search_early_stop, search_run_summary, author_classes, toc_clean, toc_pages, next_pages, sample_positions, source_listing, source_counts, clean_rule_scope, page_window, response_budget)
}

WS = r"[\s\x{0B}\x{85}\p{Z}]"


def _cmp(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g'))"


_CLASS = f"CASE WHEN {_cmp('match_keyword')} = '' THEN 'other' WHEN {_cmp('title')} = {_cmp('match_keyword')} THEN 'exact' WHEN contains({_cmp('title')}, {_cmp('match_keyword')}) THEN 'contains' ELSE 'other' END"
_RANK = "CASE {} WHEN 'exact' THEN 0 WHEN 'contains' THEN 1 ELSE 2 END"
_STATE = "CASE WHEN coalesce(successes, 0) + coalesce(failures, 0) = 0 THEN 'unknown' WHEN coalesce(failures, 0) = 0 THEN 'healthy' WHEN successes > 0 AND failures <= successes THEN 'degraded' ELSE 'broken' END"
_RANKED = "CASE {} WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 WHEN 'unknown' THEN 2 WHEN 'broken' THEN 3 WHEN 'unsupported' THEN 4 ELSE 5 END"
_EXTRACTOR = "CASE template_family WHEN 'novelpub-like' THEN 0 WHEN 'wordpress-like' THEN 0 WHEN 'novelfull-like' THEN 0 ELSE 1 END"
_HITS = f"SELECT h.*, coalesce(s.supports_download, false) AS dl, {_CLASS} AS cls FROM search_hit h LEFT JOIN book_source s USING (source_id)"
_ORDER = f"{_RANK.format('cls')}, CASE WHEN dl THEN 0 ELSE 1 END, lower(coalesce(title, '')), lower(coalesce(author, '')), hit_id"

SQL = {
    "search_rank": f"SELECT match_keyword, rank::INT AS rank, hit_id, cls AS title_match FROM (SELECT *, row_number() OVER (PARTITION BY match_keyword ORDER BY {_ORDER}) AS rank FROM ({_HITS})) WHERE rank <= 5",
    "search_topk": f"SELECT hit_id, title, (SELECT count(*) FROM search_hit) AS result_count FROM ({_HITS}) ORDER BY {_ORDER} LIMIT 20",
    "search_per_source_limit": "SELECT source_id, match_keyword, hit_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id, match_keyword ORDER BY hit_id) AS rank FROM search_hit) WHERE rank <= 3",
    "source_priority": f"""
SELECT row_number() OVER (ORDER BY {_RANKED.format(f"({_STATE})")}, CASE WHEN supports_download THEN 0 ELSE 1 END, {_EXTRACTOR}, history, penalty, speed, recency, source_id) AS position, source_id
FROM (SELECT *, CASE history WHEN 0 THEN timeouts * 2 + greatest(0, failures - successes) WHEN 1 THEN 0 ELSE timeouts * 2 + failures END AS penalty,
             CASE history WHEN 0 THEN coalesce(nullif(avg_success_ms, 0), nullif(avg_duration_ms, 0), 'infinity'::DOUBLE) WHEN 1 THEN 'infinity'::DOUBLE ELSE coalesce(nullif(avg_duration_ms, 0), 'infinity'::DOUBLE) END AS speed,
             CASE history WHEN 0 THEN -coalesce(last_success_at, 0) WHEN 1 THEN 0 ELSE coalesce(last_failure_at, 0) END AS recency
      FROM (SELECT b.*, t.* EXCLUDE (source_id, updated_at), CASE WHEN t.source_id IS NULL THEN 1 WHEN successes > 0 THEN 0 ELSE 2 END AS history FROM book_source b LEFT JOIN search_source_stats t ON b.source_id = t.source_id WHERE enabled AND supports_search))""",
    "search_skips": "SELECT b.source_id, CASE WHEN NOT coalesce(supports_search, false) THEN CASE WHEN array_to_string(coalesce(issues, []), '；') <> '' THEN array_to_string(issues, '；') ELSE '当前书源不支持 route A 搜索' END WHEN failures > 0 AND successes = 0 THEN '失败 ' || failures END AS reason FROM book_source b LEFT JOIN search_source_stats t ON b.source_id = t.source_id",
    "identity_check": f"SELECT hit_id, plan_id, CASE WHEN {_cmp('book_name')} <> '' AND {_cmp('title')} <> {_cmp('book_name')} THEN 'title' WHEN {_cmp('p.author')} <> '' AND {_cmp('h.author')} <> {_cmp('p.author')} THEN 'author' END AS mismatch FROM search_hit h JOIN book_plan p USING (book_url)",
    "candidate_resolution": f"""
WITH x AS (SELECT book_name, arg_min_null(author, plan_id) AS expected FROM book_plan GROUP BY book_name),
st AS (SELECT source_id, {_STATE} AS search FROM search_source_stats),
j AS (SELECT h.*, s.supports_download, list_slice(coalesce(s.issues, []), 1, 3) AS issues, s.name, CASE WHEN s.source_id IS NULL THEN 2 ELSE {_EXTRACTOR} END AS extractor, {_CLASS} AS title_match,
  CASE WHEN {_cmp('x.expected')} = '' THEN 'unspecified' WHEN {_cmp('h.author')} = '' THEN 'missing' WHEN {_cmp('h.author')} = {_cmp('x.expected')} THEN 'exact' WHEN contains({_cmp('h.author')}, {_cmp('x.expected')}) OR contains({_cmp('x.expected')}, {_cmp('h.author')}) THEN 'contains' ELSE 'mismatch' END AS author_match,
  coalesce(st.search, 'unknown') AS search_state, coalesce(b.preflight, 'unknown') AS preflight_state, coalesce(b.download, 'unknown') AS download_state
  FROM search_hit h LEFT JOIN x ON x.book_name = h.match_keyword LEFT JOIN book_source s ON s.source_id = h.source_id LEFT JOIN st ON st.source_id = h.source_id LEFT JOIN ({jobs.BY_STAGE}) b ON b.source_id = h.source_id),
k AS (SELECT *, CASE WHEN trim(coalesce(book_url, '')) = '' THEN '搜索结果缺少 book_url，无法自动下载' WHEN NOT coalesce(supports_download, false) OR preflight_state = 'unsupported' OR download_state = 'unsupported' THEN CASE WHEN preflight_state = 'unsupported' OR download_state = 'unsupported' THEN '静态规则不支持' WHEN array_to_string(issues, '；') <> '' THEN array_to_string(issues, '；') ELSE '书源当前不支持 TXT 下载' END END AS skip_reason FROM j),
r AS (SELECT *, {_RANK.format('title_match')} AS o1, CASE author_match WHEN 'exact' THEN 0 WHEN 'contains' THEN 1 WHEN 'unspecified' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END AS o2, {_RANKED.format('preflight_state')} AS o3, {_RANKED.format('download_state')} AS o4, {_RANKED.format('search_state')} AS o6, len(issues) AS o7, {_cmp('title')} AS o8, {_cmp('author')} AS o9, {_cmp("coalesce(CASE WHEN trim(source_name) <> '' THEN source_name END, name, source_id)")} AS o10 FROM k),
d AS (SELECT *, row_number() OVER (PARTITION BY coalesce(source_id, ''), trim(coalesce(book_url, '')), o8, o9, coalesce(match_keyword, '') ORDER BY o1, o2, o3, o4, extractor, o6, o7, o8, o9, o10, hit_id) AS n FROM r)
SELECT match_keyword, row_number() OVER (PARTITION BY match_keyword ORDER BY (skip_reason IS NOT NULL)::INT, o1, o2, o3, o4, extractor, o6, o7, o8, o9, o10, hit_id)::INT AS position, hit_id, title_match, author_match, search_state, preflight_state, download_state, skip_reason FROM d WHERE n = 1""",
    "search_early_stop": f"""
SELECT * FROM (SELECT *, coalesce(sum(exact) OVER (PARTITION BY match_keyword ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS hits_before
FROM (SELECT match_keyword, source_id, count(*) FILTER (WHERE cls = 'exact') AS exact, count(*) AS hits FROM ({_HITS}) GROUP BY ALL)) WHERE hits_before < 3""",
    "search_run_summary": f"SELECT match_keyword, count(*) AS sources, sum(hits)::BIGINT AS hits, count(*) FILTER (WHERE exact > 0) AS successful, max(CASE WHEN exact > 0 THEN source_id END) AS last_successful FROM (SELECT match_keyword, source_id, count(*) AS hits, count(*) FILTER (WHERE cls = 'exact') AS exact FROM ({_HITS}) GROUP BY ALL) GROUP BY ALL",
    "author_classes": f"""
SELECT hit_id, CASE WHEN {_cmp('expected')} = '' THEN 'unspecified' WHEN {_cmp('author')} = '' THEN 'missing' WHEN {_cmp('author')} = {_cmp('expected')} THEN 'exact' WHEN contains({_cmp('author')}, {_cmp('expected')}) OR contains({_cmp('expected')}, {_cmp('author')}) THEN 'contains' ELSE 'mismatch' END AS author_match
FROM (SELECT h.hit_id, h.author, p.expected FROM search_hit h JOIN (SELECT book_name, first(author ORDER BY plan_id) AS expected FROM book_plan GROUP BY book_name) p ON h.title = p.book_name)""",
    "toc_clean": f"""
WITH x AS (SELECT plan_id, book_url, toc_url, book_name, n, t.title AS title, t.url AS url FROM (SELECT *, unnest(toc) AS t, generate_subscripts(toc, 1) AS n FROM book_plan)),
f AS (SELECT * FROM x WHERE trim(coalesce(title, '')) <> '' AND trim(coalesce(url, '')) <> ''),
g AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') IN (regexp_replace(regexp_replace(book_url, '#.*$', ''), '/+$', ''), regexp_replace(regexp_replace(toc_url, '#.*$', ''), '/+$', '')) OR ({_cmp('book_name')} <> '' AND {_cmp('title')} = {_cmp('book_name')}) OR {_cmp('title')} IN ('[正序]', '[倒序]', '正序', '倒序') AS noise FROM f),
k AS (SELECT *, count(*) FILTER (WHERE NOT noise) OVER (PARTITION BY plan_id) AS kept FROM g),
u AS (SELECT *, row_number() OVER (PARTITION BY plan_id, url ORDER BY n) AS c FROM k WHERE NOT noise OR kept = 0)
SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY n) - 1)::INT AS index, title, url FROM u WHERE c = 1""",
    "next_pages": """
WITH RECURSIVE e AS (SELECT url, min(next) AS next FROM (SELECT t.url AS url, toc[n + 1].url AS next FROM (SELECT toc, unnest(toc) AS t, generate_subscripts(toc, 1) AS n FROM book_plan)) GROUP BY url),
w AS (SELECT plan_id, 0 AS page, toc[1].url AS url, [toc[1].url] AS seen FROM book_plan WHERE len(toc) > 0
 UNION ALL SELECT w.plan_id, w.page + 1, e.next, list_append(w.seen, e.next) FROM w JOIN e ON w.url = e.url WHERE e.next IS NOT NULL AND w.page < 4 AND NOT list_contains(w.seen, e.next))
SELECT plan_id, page, url FROM w""",
    "toc_pages": f"""
WITH p AS (SELECT regexp_replace(toc_url, '#.*$', '') AS toc_url, arg_min_null(toc, plan_id) AS toc FROM book_plan WHERE len(toc) > 0 AND toc_url IS NOT NULL GROUP BY 1),
x AS (SELECT toc_url, n, {{sq}} FROM (SELECT *, unnest(toc) AS t, generate_subscripts(toc, 1) AS n FROM p)),
u AS (SELECT *, row_number() OVER (PARTITION BY toc_url, url ORDER BY n) AS c FROM x WHERE title <> '' AND url <> '')
SELECT toc_url, (row_number() OVER (PARTITION BY toc_url ORDER BY n) - 1)::INT AS index, title, url FROM u WHERE c = 1""".replace("{{sq}}", r"trim(regexp_replace(t.title, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS title, t.url AS url").replace("{sq}", r"trim(regexp_replace(t.title, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g')) AS title, t.url AS url"),
    "sample_positions": "SELECT plan_id, pos, url FROM (SELECT plan_id, (n - 1)::INT AS pos, t.url AS url, len(toc) AS k FROM (SELECT plan_id, toc, unnest(toc) AS t, generate_subscripts(toc, 1) AS n FROM book_plan)) WHERE k <= 3 OR pos IN (0, k // 2, k - 1)",
    "source_listing": "SELECT source_id, name, total, (total > 15) AS has_more, CASE WHEN total > 15 THEN 15 END AS next_offset, greatest(0, total - 15)::BIGINT AS omitted FROM (SELECT source_id, name, enabled FROM book_source ORDER BY CASE WHEN enabled THEN 0 ELSE 1 END, coalesce(name, ''), source_id LIMIT 10 OFFSET 5), (SELECT count(*) AS total FROM book_source)",
    "source_counts": "SELECT template_family, count(*) AS sources, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE supports_search) AS search, count(*) FILTER (WHERE supports_download) AS download, sum(len(issues))::BIGINT AS issues FROM book_source GROUP BY template_family",
    "clean_rule_scope": """
WITH s AS (SELECT source_id, lower(concat_ws(chr(10), source_id, name, base_url)) AS txt FROM book_source), r(repo, seq, pattern, replacement, scope) AS (VALUES (1, 0, '一', '', NULL), (1, 1, '二', 'x', 'moyu'), (1, 2, '三', '', 're:^(shiye|dengxia)'), (2, 0, '一', '', NULL), (2, 1, '五', '', '文学'), (2, 1, '五', '', 'example')),
m AS (SELECT DISTINCT source_id, repo, seq, pattern, replacement FROM s, r WHERE scope IS NULL OR CASE WHEN starts_with(scope, 're:') THEN regexp_matches(txt, substr(scope, 4)) ELSE contains(txt, scope) END)
SELECT source_id, repo, seq, pattern, replacement FROM (SELECT *, row_number() OVER (PARTITION BY source_id, pattern, replacement ORDER BY repo, seq) AS n FROM m) WHERE n = 1""",
    "page_window": "SELECT hit_id, title, total, (total > 65) AS has_more, CASE WHEN total > 65 THEN 65 END AS next_offset, greatest(0, total - 65)::BIGINT AS omitted FROM (SELECT hit_id, title FROM search_hit ORDER BY hit_id DESC LIMIT 25 OFFSET 40), (SELECT count(*) AS total FROM search_hit)",
    "response_budget": """
SELECT match_keyword, hit_id, source_id, used FROM (SELECT *, sum(size) OVER (PARTITION BY match_keyword ORDER BY hit_id)::BIGINT AS used, row_number() OVER (PARTITION BY match_keyword ORDER BY hit_id) AS n
FROM (SELECT match_keyword, hit_id, source_id, length('{"match_keyword":"","hit_id":,"source_id":""}') + length(replace(replace(match_keyword, '\\', '\\\\'), '"', '\\"')) + length(hit_id::VARCHAR) + length(source_id) AS size FROM search_hit WHERE match_keyword IS NOT NULL)) WHERE used <= 400 OR n <= 1""",
}
