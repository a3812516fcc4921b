"""Queries over source definitions and rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import capability, readers

#: Rule texts of the tables' site families, for definitions made of the table of sources.
RULE_TEXTS = {"novelpub-like": ".novel-list .novel-item a@text", "wordpress-like": "li.wp-manga-chapter a@text", "novelfull-like": "#list-chapter li a@text", "json_api": "$.data[*].name", "generic": "div.hit a@text"}


def _text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


def _definitions(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, text): the registered sources in the writing of the sources' own files; their weight says which odd features each has."""
    w = F.col("weight")
    rule = F.create_map(*(F.lit(x) for pair in RULE_TEXTS.items() for x in pair))[F.col("template_family")]
    text = lambda script, browser: F.when(w % script == 0, "<js>x</js>").when(w % browser == 0, F.lit('{"webView": true}')).otherwise(rule)
    block = F.struct(F.lit("div").alias("list"), text(11, 13).alias("name"))
    return table(spark, folder, "book_source").select(
        "source_id",
        F.to_json(
            F.struct(
                F.col("name").alias("bookSourceName"), F.col("base_url").alias("bookSourceUrl"), F.when(F.col("supports_search"), F.lit("/s?q={{key}}")).alias("searchUrl"), F.when(F.col("supports_search"), F.to_json(block)).alias("ruleSearch"),
                rule.alias("ruleBookInfo"), F.when(F.col("supports_download"), rule).alias("ruleToc"), F.to_json(F.struct(text(17, 19).alias("content"))).alias("ruleContent"), (w % 7 == 0).alias("enableJs"), (w % 10 == 3).alias("singleUrl"), F.when(w % 10 == 1, "https://login.example").when(w % 10 == 9, "ask the owner").alias("loginUrl"),
                F.when(w % 10 == 8, "lib()").alias("jsLib"), F.when(w % 12 == 5, "web()").alias("webJs"), "enabled",
            )
        ).alias("text"),
    )


def _imported(spark: SparkSession, folder: str) -> DataFrame:
    df = readers.source_definitions(_definitions(spark, folder).withColumnRenamed("source_id", "registered")).where("source is not null")
    return capability.strategy(capability.family(capability.capability(capability.normalised(df))))


def source_import(spark: SparkSession, folder: str) -> DataFrame:
    """The definitions normalised, with capability, family and strategy."""
    return _imported(spark, folder).select(F.col("registered").alias("source_id"), "name", "enabled", "supports_search", "supports_download", F.array_join("issues", "; ").alias("issues"), "template_family", F.array_join("preferred_extractors", ",").alias("extractors"), "search_mode", "download_mode", "has_login_flow")


def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    return capability.import_counts(_imported(spark, folder))


def _rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, text): for each source a rule file about its name; which kinds of rules it holds follows from the weight."""
    w = F.col("weight")
    rule = lambda pattern, **more: F.struct(pattern.alias("pattern"), *((F.lit(v) if not isinstance(v, Column) else v).alias(k) for k, v in more.items()))
    rows = F.array(
        rule(F.coalesce("name", F.lit("")), name="own name", replacement="", isRegex=False, enabled=w % 2 == 0, scope=F.when(w % 3 == 0, F.col("source_id"))),
    )
    script = F.array(rule(F.lit("x"), name="script", replacement="@js:y", isRegex=True, enabled=F.lit(True), scope=F.lit(None).cast("string")))
    both = F.when(w % 5 == 0, F.concat(rows, script)).otherwise(rows)
    return table(spark, folder, "book_source").select("source_id", F.to_json(F.struct(both.alias("rules"))).alias("text"))


def clean_rules_json(spark: SparkSession, folder: str) -> DataFrame:
    return readers.clean_rules_json(_rule_files(spark, folder)).withColumn("scope", F.array_join("scope", ","))


def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return capability.repository_counts(readers.clean_rules_json(_rule_files(spark, folder)), ["source_id"])


def clean_rules_text(spark: SparkSession, folder: str) -> DataFrame:
    """Rule lines about every source: a comment, its name, its family by a replacement."""
    lines = F.concat(F.lit("# "), F.col("source_id"), F.lit("\n"), F.coalesce("name", F.lit("")), F.lit("##\n\n"), F.col("template_family"), F.lit("##f##g\n##gone"))
    return readers.clean_rules_text(table(spark, folder, "book_source").select("source_id", lines.alias("text")))


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The journal written as JSON lines, a file for each job, every fortieth line torn, and read back."""
    one = F.to_json(F.struct("kind", "index"))
    line = F.when(F.col("rec_id") % 40 == 0, F.lit('{"kind": "tor')).otherwise(one)
    files = table(spark, folder, "job").where("job_id is not null").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
    return readers.journal_lines(files, "kind string, index int").select("job_id", "pos", "corrupt", "record.kind", F.coalesce("record.index", F.lit(-1)).alias("index"))


def page_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Every preview asked for in one of four ways from a store of encoded pages."""
    previews = table(spark, folder, "fetch_preview").where("url is not null")
    store = previews.groupBy("url").agg(F.max_by("text_preview", "preview_id").alias("t")).select("url", F.encode("t", "utf-8").alias("bytes"), F.lit(None).cast("string").alias("charset"))
    n = F.col("preview_id") % 4
    asked = previews.select("preview_id", F.concat("url", F.when(n == 0, "").when(n == 1, F.lit(',{"charset": "utf-8"}')).when(n == 2, F.lit(',{"webView": true}')).otherwise(F.lit(',{"js": "x"}'))).alias("url"))
    return readers.fetched(asked, store, "preview_id").select("preview_id", F.sha1("text").alias("text"), "error")


QUERIES = {f.__name__: f for f in (source_import, import_counts, clean_rules_json, rule_counts, clean_rules_text, journal_lines, page_fetch)}

_RULE = "CASE template_family WHEN 'novelpub-like' THEN 0 WHEN 'wordpress-like' THEN 1 WHEN 'novelfull-like' THEN 2 WHEN 'json_api' THEN 3 ELSE 4 END"
_SOURCES = f"""SELECT *, list_filter([CASE WHEN single AND NOT s THEN '检测到 singleUrl 单链接/RSS 源，当前不支持按书名搜索下载' END, CASE WHEN js THEN '该源启用了 enableJs，当前路线 A 不支持 JS 执行' END, CASE WHEN sj THEN 'ruleSearch 含 JS 规则，当前无法按书名搜索' END, CASE WHEN sw THEN '搜索规则依赖 webView/浏览器渲染，当前服务端模式不支持' END,
 CASE WHEN cj THEN 'ruleContent 含 JS 规则，当前无法稳定抓目录/正文并下载 TXT' END, CASE WHEN wj THEN '检测到 webJs/browser 脚本，当前服务端模式不支持 webView' END, CASE WHEN cw THEN 'ruleContent 依赖 webView/浏览器渲染，当前服务端模式不支持 TXT 下载' END, CASE WHEN lib THEN '检测到 jsLib 脚本库；当前纯 Python 路线不会执行其中的 JS 辅助逻辑' END, CASE WHEN login THEN '检测到 loginUrl/loginUi 登录或脚本流程；当前路线 A 不支持登录态与脚本登录' END,
 CASE WHEN NOT s THEN '缺少 searchUrl 或 ruleSearch，无法按书名搜索' END, CASE WHEN NOT d THEN '缺少 ruleBookInfo/ruleToc/ruleContent，无法自动抓目录并下载 TXT' END], lambda x: x IS NOT NULL) AS problems,
 s AND NOT js AND NOT sj AND NOT sw AS can_search, d AND NOT js AND NOT cj AND NOT cw AND NOT wj AS can_download,
 CASE WHEN single THEN 'single_url' WHEN sw OR cw OR wj THEN 'webview_dynamic' WHEN js OR sj OR cj THEN 'javascript_dynamic' WHEN login THEN 'authenticated_html' WHEN rule = 0 THEN 'novelpub_like' WHEN rule = 1 THEN 'wordpress_madara_like' WHEN rule = 2 THEN 'novelfull_like' WHEN rule = 3 THEN 'json_api' ELSE 'generic_html' END AS family
FROM (SELECT source_id, coalesce(nullif(trim(name), ''), '未命名书源') AS name, enabled, {_RULE} AS rule, coalesce(supports_search, false) AS s, coalesce(supports_download, false) AS d, weight % 7 = 0 AS js, weight % 10 = 3 AS single, weight % 10 = 1 AS login, weight % 10 = 8 AS lib, weight % 12 = 5 AS wj,
 coalesce(supports_search, false) AND weight % 11 = 0 AS sj, coalesce(supports_search, false) AND weight % 11 <> 0 AND weight % 13 = 0 AS sw, weight % 17 = 0 AS cj, weight % 17 <> 0 AND weight % 19 = 0 AS cw FROM book_source)"""
SQL = {
    "source_import": f"""SELECT source_id, name, enabled, can_search AS supports_search, can_download AS supports_download, array_to_string(problems, '; ') AS issues, family AS template_family,
 CASE family WHEN 'javascript_dynamic' THEN 'javascript_dynamic,' WHEN 'webview_dynamic' THEN 'webview_dynamic,' WHEN 'wordpress_madara_like' THEN 'template_wordpress_madara_like,' WHEN 'novelfull_like' THEN 'template_novelfull_like,' WHEN 'novelpub_like' THEN 'template_novelpub_like,' ELSE '' END || 'fallback_rule' AS extractors,
 CASE WHEN single THEN 'single_url' WHEN sw THEN 'unsupported_webview' WHEN NOT can_search AND (js OR sj) THEN 'unsupported_js' WHEN NOT can_search THEN 'missing_rules' ELSE 'keyword_search' END AS search_mode,
 CASE WHEN can_download THEN 'chapter_list' WHEN cw OR wj THEN 'unsupported_webview' WHEN js OR cj THEN 'unsupported_js' ELSE 'missing_rules' END AS download_mode, login AS has_login_flow FROM ({_SOURCES})""",
    "import_counts": f"SELECT count(*) AS imported, count(*) FILTER (WHERE can_search) AS search, count(*) FILTER (WHERE can_download) AS download FROM ({_SOURCES})",
    "clean_rules_json": """
SELECT source_id, 0 AS pos, 'own name' AS name, coalesce(name, '') AS pattern, '' AS replacement, false AS is_regex, weight % 2 = 0 AS enabled, CASE WHEN weight % 3 = 0 THEN source_id ELSE '' END AS scope, CASE WHEN trim(coalesce(name, '')) = '' THEN 'empty pattern' END AS skipped FROM book_source
UNION ALL SELECT source_id, 1, 'script', 'x', '@js:y', true, true, '', 'script replacement' FROM book_source WHERE weight % 5 = 0""",
    "rule_counts": "SELECT source_id, (trim(coalesce(name, '')) <> '')::BIGINT AS rules, (trim(coalesce(name, '')) <> '' AND weight % 2 = 0)::BIGINT AS enabled, (trim(coalesce(name, '')) <> '' AND weight % 3 = 0)::BIGINT AS scoped, (trim(coalesce(name, '')) = '')::BIGINT + (weight % 5 = 0)::BIGINT AS skipped FROM book_source",
    "clean_rules_text": "SELECT source_id, 1 AS pos, trim(name) AS pattern, '' AS replacement FROM book_source WHERE trim(coalesce(name, '')) <> '' UNION ALL SELECT source_id, 3, template_family, 'f##g' FROM book_source WHERE template_family <> ''",
    "journal_lines": "SELECT job_id, (row_number() OVER (PARTITION BY job_id ORDER BY rec_id) - 1)::INT AS pos, rec_id % 40 = 0 AS corrupt, CASE WHEN rec_id % 40 <> 0 THEN kind END AS kind, CASE WHEN rec_id % 40 <> 0 THEN coalesce(index, -1) ELSE -1 END AS index FROM job WHERE job_id IS NOT NULL",
    "page_fetch": "SELECT preview_id, CASE WHEN preview_id % 4 < 2 THEN sha1(t) END AS text, CASE preview_id % 4 WHEN 2 THEN 'refused: webView' WHEN 3 THEN 'refused: js' ELSE CASE WHEN t IS NULL THEN 'page not found' END END AS error FROM fetch_preview JOIN (SELECT url, arg_max_null(text_preview, preview_id) AS t FROM (SELECT * FROM fetch_preview WHERE url IS NOT NULL) GROUP BY url) USING (url)",
}
