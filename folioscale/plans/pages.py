"""Queries over pages and texts: rules, cleaning, reflow, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from ..operators import extract
from ..rules import compile as rules
from ..session import table

WS = r"[\s\x{0B}\x{85}\p{Z}]"
#: Cleaners of the demonstration queries: (pattern, replacement) in Python's writing.
CLEANERS = [(r"（[上下]）", ""), (r"第(\d+)章", r"<\1>"), (r"[。！？]{2,}", "。"), ("(", "never: no pattern"), (r"\s{3,}", " ")]


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Previews of pages; a tag that the cut went through is dropped."""
    return table(spark, folder, "fetch_preview").where("html_preview is not null").select("preview_id", "url", F.regexp_replace("html_preview", "<[^>]*$", "").alias("html"))


def page_title(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("preview_id", X.page_title(F.col("html")).alias("title"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("preview_id", X.html_to_text(F.col("html")).alias("text"))


def page_text_job(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("preview_id", X.html_to_text_job(F.col("html")).alias("text"))


def page_text_template(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("preview_id", X.html_to_text_template(F.col("html")).alias("text"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    got = rules.extract_list(_pages(spark, folder), "html", "a@href", "links")
    return got.select("preview_id", "url", F.posexplode("links").alias("pos", "link")).select("preview_id", "pos", "link", urls.absolute(F.col("link"), F.col("url"), urls.origin(F.col("url"))).alias("target"))


def rule_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes, alternatives, cleaners, templates and variables of one parse of each page."""
    fields = {
        "heading": "h1@text", "box": "tag.div.0@class", "last_box": "div.-1@id", "either": "h9@text||class.top&&a@text", "short": "h1@text##^第.*?章\\s*", "line": "[{{h1@text}}]",
        "kept": "@put:{h:h1@text}title@text##_.*$", "again": "@get:{h}!", "pick": "div[1,0]@class", "span": "div[0:1]@class", "others": "div!0@class",
    }
    return rules.extract(_pages(spark, folder), "html", fields, joined={"pick", "span", "others"}).select("preview_id", *fields)


def rule_json_path(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").where("props is not null").select("event_id", "props")
    return rules.extract(df, "props", {"k": "$.k", "either": "$.none||k", "line": "<{{k}}>{{'a'+'b'}}", "cleaned": "k##[0-4]##x"}, kind="json").drop("props")


def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hit")
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("title").alias("name"), "author", F.col("book_url").alias("bookUrl"), "kind")).alias("items")).alias("data")))
    got = rules.extract_hits(hits.select("hit_id", F.col("book_url").alias("page"), body.alias("body")), "body", {"bookList": "$.data.items[*]", "name": "name", "author": "author", "bookUrl": "bookUrl", "kind": "kind"}, "page", kind="json")
    return got.select("hit_id", "title", "author", "book_url", "kind")


def rule_toc_items(spark: SparkSession, folder: str) -> DataFrame:
    plans = table(spark, folder, "book_plan").where("toc is not null").select("plan_id", F.to_json(F.struct("toc")).alias("body"))
    got = rules.extract_list(plans, "body", "$.toc[*].title", "titles", kind="json")
    return got.select("plan_id", F.posexplode("titles").alias("pos", "title"))


def preview_scan(spark: SparkSession, folder: str) -> DataFrame:
    """What a look at a page shows: title, and the first 200 characters of its markup and of its text."""
    return extract.preview(_pages(spark, folder), "html", 200).select("preview_id", "title", "html_preview", "text_preview")


def inline_cleaners(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", X.clean(F.col("text"), CLEANERS).alias("text"))


def data_cleaners(spark: SparkSession, folder: str) -> DataFrame:
    """The same cleaners as rows."""
    rows = [(n, X.java_pattern(p), X.java_replacement(r)) for n, (p, r) in enumerate(CLEANERS) if X.valid(p)]
    held = spark.createDataFrame(rows, "seq int, pattern string, replacement string").groupBy().agg(F.array_sort(F.collect_list(F.struct("seq", "pattern", "replacement"))).alias("cleaners"))
    return table(spark, folder, "documents").where("text is not null").crossJoin(held).select("doc_id", X.clean_by(F.col("text"), F.col("cleaners")).alias("text"))


def page_markers(spark: SparkSession, folder: str) -> DataFrame:
    return _chapters(spark, folder).select("rec_id", X.tidy(X.without_page_markers(F.col("content"))).alias("text"))


def _chapters(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job").where("kind = 'chapter' and content is not null").select("rec_id", "title", "content")


def duplicate_title(spark: SparkSession, folder: str) -> DataFrame:
    return _chapters(spark, folder).where("title is not null").select("rec_id", X.without_title(X.lf(F.col("content")), F.col("title")).alias("text"))


def paragraph_reflow(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", X.reflow(F.col("text")).alias("text"))


def content_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    got = X.content_pipeline(_chapters(spark, folder).where("title is not null"), "content", "title", rule=[("录入：.*", "")], repository=[("（[上下]）", "")])
    return got.select("rec_id", "text")


def url_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_hit").select("hit_id", urls.normalised(F.col("book_url")).alias("url"), urls.origin(F.col("book_url")).alias("origin"))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    name, url = F.coalesce("name", F.lit("")), F.coalesce("base_url", F.lit(""))
    return table(spark, folder, "book_source").select(F.col("source_id").alias("given_id"), urls.source_id(name, url).alias("source_id"), F.md5(url).alias("md5"), urls.short_hash(url).alias("short"), X.slug(name).alias("slug"), X.file_name(name).alias("file"), X.key(url).alias("key"))


def request_urls(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_hit")
    return hits.select("hit_id", urls.request_url("{{baseUrl}}/s?q={{key}}&p={{page}}{{unknown}}", F.col("match_keyword"), urls.origin(F.col("book_url"))).alias("request"))


def truncated(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_hit").select("hit_id", X.truncate(F.col("intro"), 24).alias("intro"))


def epoch_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_source_stats").select("source_id", urls.epoch_text(F.col("last_success_at").cast("decimal(20,3)").cast("string")).alias("seconds"), urls.epoch_text((F.col("updated_at") * 1000).cast("bigint").cast("string")).alias("millis"), urls.epoch_text(F.col("source_id")).alias("other"))


def payload_kinds(spark: SparkSession, folder: str) -> DataFrame:
    from ..sources import readers

    a = table(spark, folder, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("text"))
    b = table(spark, folder, "fetch_preview").select(F.concat(F.lit("p"), F.col("preview_id").cast("string")).alias("id"), F.col("html_preview").alias("text"))
    return a.unionByName(b).where("text is not null").select("id", readers.payload_kind(F.col("text")).alias("kind"))


def text_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes in another charset, decoded by the cascade."""
    from ..sources import readers

    df = table(spark, folder, "search_hit").where("title is not null").select("hit_id", "title")

    @F.pandas_udf("binary")
    def gb(s):
        return s.map(lambda t: t.encode("gb18030"))

    return df.select("hit_id", readers.decoded(gb("title"), F.lit("gb18030")).alias("title"))


QUERIES = {
    f.__name__: f
    for f in (page_title, page_text, page_text_job, page_text_template, page_links, rule_fields, rule_json_path, rule_hits, rule_toc_items, preview_scan, inline_cleaners, data_cleaners, page_markers, duplicate_title, paragraph_reflow, content_pipeline, url_normalise, stable_ids, request_urls, truncated, epoch_format, payload_kinds, text_roundtrip)
}


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squash(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def _entities(x: str) -> str:
    return reduce(lambda s, e: "replace({}, '{}', '{}')".format(s, e[0], e[1].replace("'", "''")), X.ENTITIES, x)


def _lf(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _each(x: str, *steps: tuple[str, str]) -> str:
    return reduce(lambda s, p: f"regexp_replace({s}, '{p[0]}', {p[1]}, 'g')", steps, x)


PAGES = "SELECT preview_id, url, regexp_replace(html_preview, '<[^>]*$', '') AS html FROM fetch_preview WHERE html_preview IS NOT NULL"
CHAPTERS = "SELECT rec_id, title, content FROM job WHERE kind = 'chapter' AND content IS NOT NULL"
_NL = "chr(10)"
_STRIP = ((r"(?is)<script\b.*?</script>", "''"), (r"(?is)<style\b.*?</style>", "''"))
_TEXT = _trim(_each(_lf(_entities(_each("html", *_STRIP, (r"(?i)<br\s*/?>", _NL), (r"(?i)</(p|div|section|article|li|tr|h[1-6])\s*>|<li\b[^>]*>", _NL), ("<[^>]+>", "''")))), (r"[ \t]*\n[ \t]*", _NL), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")))
_TEXT_JOB = _trim(_each(f"replace(replace({_lf(_entities(_each('html', *_STRIP, (r'(?i)<br\s*/?>|</(p|div|li|h[1-6])\s*>', _NL), ('<[^>]+>', "''"))))}, chr(160), ' '), chr(12288), '  ')", (r"[ \t]+\n", _NL), (r"\n{3,}", "chr(10) || chr(10)")))
_TEXT_TEMPLATE = _trim(_each(_lf(_entities(_each("html", *_STRIP, (r"(?i)<br\s*/?>|</(p|div)\s*>", _NL), ("<[^>]+>", "''")))), (r"[ \t]*\n[ \t]*", _NL), (r"\n{3,}", "chr(10) || chr(10)")))
_H1 = _squash(_entities(r"regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"))
_HEAD = _squash(_entities(r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')"))
_DIVS = r"regexp_extract_all(html, '<div[^>]*>')"
_ATTR = "regexp_extract({}, '{}=\"([^\"]*)\"', 1)"
_CLEAN = _trim(_each("text", ("（[上下]）", "''"), (r"第(\p{Nd}+)章", r"'<\1>'"), ("[。！？]{2,}", "'。'"), (WS + "{3,}", "' '")))
_MARKERS = [(r"[（(]" + WS + r"*第[0-9０-９]+" + WS + r"*/" + WS + r"*[0-9０-９]+" + WS + r"*页" + WS + r"*[)）]", "''"), (r"(?im)^" + WS + r"*.*(?:下一页继续阅读|本章未完，请点击下一页继续阅读).*$", "''"), (r"(?im)^" + WS + r"*.*(?:点击下一页|下一章|上一章)" + WS + r"*$", "''")]


def _tidy(x: str) -> str:
    return _trim(_each(_lf(x), (r"[ \t]+\n", _NL), (r"\n{3,}", "chr(10) || chr(10)")))


def _untitled(x: str, title: str = "title") -> str:
    kept = f"array_to_string(list_filter(string_split({_trim(x)}, chr(10)), lambda x: {_trim('x')} <> {_trim(title)}), chr(10))"
    return f"CASE WHEN {_trim(title)} = '' OR {_trim(kept)} = '' THEN {_trim(x)} ELSE {_trim(kept)} END"


def _reflowed(source: str, key: str) -> str:
    """SQL that reflows ``text`` of ``source`` with window functions."""
    ends = f"[{X.PARAGRAPH_ENDS}]$".replace("'", "''")
    return f"""
WITH src AS ({source}),
lines AS (SELECT {key}, n, {_trim('line')} AS line FROM (
  SELECT {key}, unnest(string_split({_trim(_lf('text'))}, chr(10))) AS line, generate_subscripts(string_split({_trim(_lf('text'))}, chr(10)), 1) AS n FROM src)),
kept AS (SELECT * FROM lines WHERE line <> ''),
marked AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR regexp_matches(lag(line) OVER w, '{ends}') OR regexp_matches(line, '{X.OWN_PARAGRAPH}') THEN 1 ELSE 0 END AS opens
  FROM kept WINDOW w AS (PARTITION BY {key} ORDER BY n)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY n) AS p FROM marked),
paragraphs AS (SELECT {key}, p, '　　' || string_agg(line, '' ORDER BY n) AS paragraph FROM numbered GROUP BY {key}, p),
texts AS (SELECT {key}, string_agg(paragraph, chr(10) ORDER BY p) AS text FROM paragraphs GROUP BY {key})
SELECT src.{key} AS {key}, coalesce(texts.text, '') AS text FROM src LEFT JOIN texts USING ({key})"""


_NORMAL_URL = """CASE WHEN trim(coalesce({u}, '')) = '' THEN '' ELSE lower(regexp_extract(trim({u}), '^([A-Za-z][\\w+.-]*)://', 1)) || '://' || lower(regexp_extract(trim({u}), '://([^/?#]*)', 1))
 || coalesce(nullif(regexp_replace(regexp_extract(trim({u}), '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(trim({u}), '^[^?#]*(\\?[^#]*)?', 1) END"""
_ORIGIN = "regexp_extract({u}, '^([A-Za-z][\\w+.-]*://[^/?#]*)', 1)"

SQL = {
    "page_title": f"SELECT preview_id, {_HEAD} AS title FROM ({PAGES})",
    "page_text": f"SELECT preview_id, {_TEXT} AS text FROM ({PAGES})",
    "page_text_job": f"SELECT preview_id, {_TEXT_JOB} AS text FROM ({PAGES})",
    "page_text_template": f"SELECT preview_id, {_TEXT_TEMPLATE} AS text FROM ({PAGES})",
    "page_links": f"""SELECT preview_id, (pos - 1)::INT AS pos, link, CASE WHEN link = '' THEN '' WHEN contains(link, '://') THEN link WHEN starts_with(link, '/') THEN {_ORIGIN.format(u='url')} || link ELSE regexp_extract(url, '^([^?#]*/)', 1) || link END AS target
FROM (SELECT preview_id, url, unnest(links) AS link, generate_subscripts(links, 1) AS pos FROM (SELECT *, regexp_extract_all(html, '<a\\b[^>]*href="([^"]*)"[^>]*>', 1) AS links FROM ({PAGES})))""",
    "rule_fields": f"""SELECT preview_id, {_H1} AS heading, {_ATTR.format(_DIVS + '[1]', 'class')} AS box, {_ATTR.format(_DIVS + '[-1]', 'id')} AS last_box,
 {_squash(_entities(r"regexp_replace(regexp_extract(html, '(?s)<a[^>]*>(.*?)</a>', 1), '<[^>]+>', '', 'g')"))} AS either, {_trim(f"regexp_replace({_H1}, '^第.*?章{WS}*', '')")} AS short,
 '[' || {_H1} || ']' AS line, {_trim(f"regexp_replace({_HEAD}, '_.*$', '')")} AS kept, {_H1} || '!' AS again,
 array_to_string(list_filter([{_ATTR.format(_DIVS + '[2]', 'class')}, {_ATTR.format(_DIVS + '[1]', 'class')}], lambda x: x <> ''), chr(10)) AS pick,
 array_to_string(list_filter(list_transform({_DIVS}[1:2], lambda d: {_ATTR.format('d', 'class')}), lambda x: x <> ''), chr(10)) AS span,
 array_to_string(list_filter(list_transform({_DIVS}[2:], lambda d: {_ATTR.format('d', 'class')}), lambda x: x <> ''), chr(10)) AS others FROM ({PAGES})""",
    "rule_json_path": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS either, '<' || json_extract_string(props, '$.k') || '>ab' AS line, regexp_replace(json_extract_string(props, '$.k'), '[0-4]', 'x', 'g') AS cleaned FROM events WHERE props IS NOT NULL",
    "preview_scan": f"SELECT preview_id, {_HEAD} AS title, left(html, 200) AS html_preview, left({_TEXT}, 200) AS text_preview FROM ({PAGES})",
    "rule_hits": f"SELECT hit_id, {_squash('title')} AS title, coalesce({_squash('author')}, '') AS author, coalesce({_squash('book_url')}, '') AS book_url, coalesce({_squash('kind')}, '') AS kind FROM search_hit WHERE {_squash('title')} <> ''",
    "rule_toc_items": f"SELECT plan_id, (n - 1)::INT AS pos, {_squash('t.title')} AS title FROM (SELECT plan_id, unnest(toc) AS t, generate_subscripts(toc, 1) AS n FROM book_plan)",
    "inline_cleaners": f"SELECT doc_id, {_CLEAN} AS text FROM documents WHERE text IS NOT NULL",
    "data_cleaners": f"SELECT doc_id, {_CLEAN} AS text FROM documents WHERE text IS NOT NULL",
    "page_markers": f"SELECT rec_id, {_tidy(_trim(_each('content', *_MARKERS)))} AS text FROM ({CHAPTERS})",
    "duplicate_title": f"SELECT rec_id, {_untitled(_lf('content'))} AS text FROM ({CHAPTERS}) WHERE title IS NOT NULL",
    "paragraph_reflow": _reflowed("SELECT doc_id, text FROM documents WHERE text IS NOT NULL", "doc_id"),
    "content_pipeline": _reflowed(
        f"SELECT rec_id, {_untitled('t')} AS text FROM (SELECT rec_id, title, {_tidy(_trim(_each(_trim(_each(_trim(_each('raw', ('录入：.*', "''"))), ('（[上下]）', "''"))), *_MARKERS)))} AS t FROM (SELECT rec_id, title, CASE WHEN regexp_matches(content, '<[a-zA-Z][^>]*>') THEN {_TEXT.replace('html', 'content')} ELSE content END AS raw FROM ({CHAPTERS}) WHERE title IS NOT NULL))", "rec_id"
    ),
    "url_normalise": f"SELECT hit_id, {_NORMAL_URL.format(u='book_url')} AS url, coalesce({_ORIGIN.format(u='book_url')}, '') AS origin FROM search_hit",
    "stable_ids": r"""
SELECT given_id, substr(slug, 1, 32) || '-' || substr(sha1('{"name": "' || trim(name) || '", "source_url": "' || trim(url) || '"}'), 1, 12) AS source_id, md5(url) AS md5, substr(sha1(url), 1, 10) AS short, slug,
 coalesce(nullif(regexp_replace(regexp_replace(name, '[\\/:*?"<>|]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'novel') AS file, substr(regexp_replace(regexp_replace(url, '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24) AS key
FROM (SELECT source_id AS given_id, name, url, coalesce(nullif(lower(regexp_replace(regexp_replace(trim(name), '[^0-9A-Za-z一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'source') AS slug
      FROM (SELECT source_id, coalesce(name, '') AS name, coalesce(base_url, '') AS url FROM book_source))""",
    "request_urls": f"SELECT hit_id, coalesce({_ORIGIN.format(u='book_url')}, '') || '/s?q=' || coalesce(match_keyword, '') || '&p=1' AS request FROM search_hit",
    "truncated": "SELECT hit_id, CASE WHEN length(intro) <= 24 THEN intro ELSE substr(intro, 1, 23) || '…' END AS intro FROM search_hit",
    "epoch_format": "SELECT source_id, strftime(make_timestamp((last_success_at * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS seconds, strftime(make_timestamp((updated_at * 1000000)::BIGINT), '%Y-%m-%d %H:%M') AS millis, source_id AS other FROM search_source_stats",
    "payload_kinds": "SELECT 'e' || event_id AS id, CASE WHEN json_valid(props) THEN 'json' ELSE 'html' END AS kind FROM events WHERE props IS NOT NULL UNION ALL SELECT 'p' || preview_id, CASE WHEN json_valid(html_preview) THEN 'json' ELSE 'html' END FROM fetch_preview WHERE html_preview IS NOT NULL",
    "text_roundtrip": "SELECT hit_id, title FROM search_hit WHERE title IS NOT NULL",
}
