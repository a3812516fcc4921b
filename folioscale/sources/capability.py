"""What a source can do, from its definition alone (CLS-01 to CLS-06, FLT-04 to FLT-06, FLT-09, FLT-10, JN-05, SET-03, AGG-07, AGG-08).

A definition is a map of texts as ``readers.source_definitions`` gives it, rule blocks as JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls

#: Names of a field in definitions, first non-blank first. Fixed values.
ALIASES = {
    "name": ("bookSourceName", "sourceName", "name", "title"), "source_url": ("bookSourceUrl", "sourceUrl", "url"), "group": ("bookSourceGroup", "sourceGroup", "group"),
    "search_url": ("searchUrl",), "explore_url": ("exploreUrl",), "clean_rule_url": ("cleanRuleUrl", "ruleCleanUrl", "defaultRuleUrl", "cleanUrl"), "login_url": ("loginUrl",), "header": ("header",),
    "rule_search": ("ruleSearch",), "rule_book_info": ("ruleBookInfo",), "rule_toc": ("ruleToc",), "rule_content": ("ruleContent",), "rule_explore": ("ruleExplore",),
}
UNNAMED = "未命名书源"
BLOCKS = ("rule_search", "rule_book_info", "rule_toc", "rule_content", "rule_explore")
DOWNLOAD_BLOCKS = {"rule_book_info": "ruleBookInfo", "rule_toc": "ruleToc", "rule_content": "ruleContent"}
#: Marks of scripts, browsers and logins, in lower case. Fixed values.
SCRIPT = ("<js>", "@js:")
BROWSER = ('"webview":true', '"webview": true', "'webview':true", "'webview': true")
CALLS = ("function", "=>", "java.", "eval(")
#: What stands in the way of a source, in order. Fixed values.
ISSUES = {
    "single": "检测到 singleUrl 单链接/RSS 源，当前不支持按书名搜索下载", "enable_js": "该源启用了 enableJs，当前路线 A 不支持 JS 执行", "search_js": "ruleSearch 含 JS 规则，当前无法按书名搜索", "search_webview": "搜索规则依赖 webView/浏览器渲染，当前服务端模式不支持",
    "blocks_js": " 含 JS 规则，当前无法稳定抓目录/正文并下载 TXT", "web_js": "检测到 webJs/browser 脚本，当前服务端模式不支持 webView", "blocks_webview": " 依赖 webView/浏览器渲染，当前服务端模式不支持 TXT 下载", "js_lib": "检测到 jsLib 脚本库；当前纯 Python 路线不会执行其中的 JS 辅助逻辑",
    "login": "检测到 loginUrl/loginUi 登录或脚本流程；当前路线 A 不支持登录态与脚本登录", "search": "缺少 searchUrl 或 ruleSearch，无法按书名搜索", "download": "缺少 ruleBookInfo/ruleToc/ruleContent，无法自动抓目录并下载 TXT",
}
#: Marks of site families in the rules' text, in the order they are tried, and the extractor of each family. Fixed values.
FAMILIES = [
    ("novelpub_like", ("lnsearchlive", ".novel-list .novel-item")), ("wordpress_madara_like", ("wp-manga", "manga_get_chapters", "reading-content")),
    ("novelfull_like", ("ajax-chapter-option", "chapter-content", "chr-content", "list-chapter")), ("json_api", ("@json:", "$.", "jsonpath")),
]
EXTRACTORS = {
    "generic_html": "fallback_rule", "javascript_dynamic": "javascript_dynamic", "webview_dynamic": "webview_dynamic",
    "wordpress_madara_like": "template_wordpress_madara_like", "novelfull_like": "template_novelfull_like", "novelpub_like": "template_novelpub_like",
}
FALLBACK = "fallback_rule"


def _holds(c: Column, marks: tuple[str, ...]) -> Column:
    """Does the text, lowered, hold any of the marks?"""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in marks))


def has_script(c: Column) -> Column:
    """FLT-04: a script's mark in a text."""
    return _holds(c, SCRIPT)


def has_browser(c: Column) -> Column:
    """FLT-05: the mark of a browser in a text, or both its words."""
    return _holds(c, BROWSER) | (_holds(c, ("webview",)) & _holds(c, ("true",)))


def has_login(login: Column) -> Column:
    """FLT-06: a login that is an address, a script or a function call."""
    text = F.lower(X.trim(F.coalesce(login, F.lit(""))))
    return text.startswith("http://") | text.startswith("https://") | _holds(text, SCRIPT + CALLS)


def _any(block: str, test) -> Column:
    """Does any text of a rule block pass?"""
    return F.exists(F.map_values(F.col(block)), lambda v: test(v))


def headers(c: Column) -> Column:
    """CLS-01: request headers of a JSON object, or else of lines "name: value"."""
    text = X.trim(F.coalesce(c, F.lit("")))
    lines = F.filter(F.split(X.lf(text), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(X.trim(F.substring_index(x, ":", 1)).alias("k"), X.trim(F.substring(x, F.locate(":", x) + 1, F.lit(1 << 30))).alias("v")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.when(text == "", F.create_map().cast("map<string,string>")).when(text.startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>")).otherwise(last)


def normalised(df: DataFrame, source: str = "source") -> DataFrame:
    """CLS-01: the fields of a definition under one name each; a bare rule text is its block's default rule."""
    raw = F.col(source)
    pick = {n: F.coalesce(*(X.blank_to_null(raw[a]) for a in names), F.lit(UNNAMED if n == "name" else "")) for n, names in ALIASES.items()}
    df = df.withColumns({n: X.trim(c) for n, c in pick.items()})
    empty = F.create_map().cast("map<string,string>")
    block = lambda c: F.when(c == "", empty).when(c.startswith("{"), F.coalesce(F.from_json(c, "map<string,string>"), empty)).otherwise(F.create_map(F.lit("__default__"), c))
    df = df.withColumns({b: block(F.col(b)) for b in BLOCKS})
    flag = lambda name, default: F.coalesce(X.bool_argument(raw[name]), F.lit(default))
    given = lambda name: X.blank_to_null(raw[name]).isNotNull() & ~F.lower(X.trim(raw[name])).isin("false", "0", "null", "[]", "{}")
    number = lambda name: F.coalesce(X.trim(raw[name]).try_cast("int"), F.lit(0))
    return df.withColumns(
        {
            "headers": headers(F.col("header")), "enabled": flag("enabled", True), "single_url": flag("singleUrl", False), "load_with_base_url": flag("loadWithBaseUrl", False), "enable_js": flag("enableJs", False),
            "has_js_lib": F.coalesce(X.blank_to_null(raw["jsLib"]).isNotNull(), F.lit(False)), "has_web_js": F.coalesce(X.blank_to_null(raw["webJs"]).isNotNull(), F.lit(False)), "has_login_flow": F.coalesce(given("loginUi"), F.lit(False)) | has_login(F.col("login_url")),
            "book_source_type": number("bookSourceType"), "respond_time": number("respondTime"), "weight": number("weight"), "source_id": urls.source_id(F.col("name"), F.col("source_url")),
        }
    )


def capability(df: DataFrame) -> DataFrame:
    """CLS-02: what the normalised definition supports, what it needs, and the issues in order."""
    script = {b: _any(b, has_script) for b in ("rule_search", *DOWNLOAD_BLOCKS)}
    browser = {b: _any(b, has_browser) for b in ("rule_search", *DOWNLOAD_BLOCKS)}
    df = df.withColumns(
        {
            "search_uses_js": F.col("enable_js") | script["rule_search"],
            "download_uses_js": F.col("enable_js") | reduce(lambda a, b: a | b, (script[b] for b in DOWNLOAD_BLOCKS)),
            "search_uses_webview": browser["rule_search"] | has_browser(F.col("search_url")) | has_browser(F.col("header")),
            "download_uses_webview": F.col("has_web_js") | reduce(lambda a, b: a | b, (browser[b] for b in DOWNLOAD_BLOCKS)),
            "_search": (F.col("search_url") != "") & (F.size("rule_search") > 0),
            "_download": reduce(lambda a, b: a & b, (F.size(b) > 0 for b in DOWNLOAD_BLOCKS)),
        }
    )
    listed = lambda tests: F.array_join(F.filter(F.array(*(F.when(tests[b], name) for b, name in DOWNLOAD_BLOCKS.items())), lambda x: x.isNotNull()), "/")
    blocks_js, blocks_webview = listed(script), listed(browser)
    issues = F.array(
        F.when(F.col("single_url") & ~F.col("_search"), ISSUES["single"]), F.when(F.col("enable_js"), ISSUES["enable_js"]), F.when(script["rule_search"], ISSUES["search_js"]), F.when(F.col("search_uses_webview"), ISSUES["search_webview"]),
        F.when(blocks_js != "", F.concat(blocks_js, F.lit(ISSUES["blocks_js"]))), F.when(F.col("has_web_js"), ISSUES["web_js"]), F.when(blocks_webview != "", F.concat(blocks_webview, F.lit(ISSUES["blocks_webview"]))),
        F.when(F.col("has_js_lib"), ISSUES["js_lib"]), F.when(F.col("has_login_flow"), ISSUES["login"]), F.when(~F.col("_search"), ISSUES["search"]), F.when(~F.col("_download"), ISSUES["download"]),
    )
    return df.withColumns(
        {
            "issues": F.filter(issues, lambda x: x.isNotNull()),
            "supports_search": F.col("_search") & ~F.col("search_uses_js") & ~F.col("search_uses_webview"),
            "supports_download": F.col("_download") & ~F.col("download_uses_js") & ~F.col("download_uses_webview"),
        }
    ).drop("_search", "_download")


def rule_text() -> Column:
    """The lower-cased text of the addresses and rules that tell families apart."""
    return F.lower(F.concat_ws("\n", "search_url", "clean_rule_url", *(F.map_values(F.col(b)) for b in ("rule_search", *DOWNLOAD_BLOCKS))))


def family(df: DataFrame) -> DataFrame:
    """CLS-03, CLS-04: the site family, first test that fits, and the extractors to prefer. After ``capability``."""
    f = (
        F.when(F.col("single_url"), "single_url").when(F.col("search_uses_webview") | F.col("download_uses_webview") | F.col("has_web_js"), "webview_dynamic")
        .when(F.col("search_uses_js") | F.col("download_uses_js") | F.col("enable_js"), "javascript_dynamic").when(F.col("has_login_flow"), "authenticated_html")
    )
    text = rule_text()
    for name, marks in FAMILIES:
        f = f.when(_holds(text, marks), name)
    df = df.withColumn("template_family", f.otherwise("generic_html"))
    return df.withColumn("preferred_extractors", preferred_extractors(F.col("template_family")))


def preferred_extractors(family: Column) -> Column:
    """CLS-04: the family's extractor, then the rules; each once."""
    chosen = F.create_map(*(F.lit(x) for pair in EXTRACTORS.items() for x in pair))
    return F.array_distinct(F.filter(F.array(chosen[family], F.lit(FALLBACK)), lambda x: x.isNotNull()))


def strategy(df: DataFrame) -> DataFrame:
    """CLS-05: how to search and how to download. After ``capability``."""
    search, download = F.col("supports_search"), F.col("supports_download")
    return df.withColumns(
        {
            "search_mode": F.when(F.col("single_url"), "single_url").when(F.col("search_uses_webview"), "unsupported_webview").when(~search & F.col("search_uses_js"), "unsupported_js").when(~search, "missing_rules").otherwise("keyword_search"),
            "download_mode": F.when(download, "chapter_list").when(F.col("download_uses_webview"), "unsupported_webview").when(F.col("download_uses_js"), "unsupported_js").otherwise("missing_rules"),
        }
    )


def request_refusal(options: Column) -> Column:
    """FLT-10: why a request's options (a map) cannot be met: they ask for a browser or a script; null where they can."""
    asked = F.lower(X.trim(F.coalesce(options["webView"], F.lit("")))).isin("1", "true", "yes", "on")
    script = (X.trim(F.coalesce(options["js"], F.lit(""))) != "") | (X.trim(F.coalesce(options["@js"], F.lit(""))) != "")
    return F.when(F.coalesce(asked, F.lit(False)), "webView").when(F.coalesce(script, F.lit(False)), "js")


def import_counts(df: DataFrame) -> DataFrame:
    """AGG-07, SRC-10: how many definitions there are, and how many can be searched and downloaded."""
    return df.agg(F.count("*").alias("imported"), F.count_if("supports_search").alias("search"), F.count_if("supports_download").alias("download"))


def repository_counts(rules: DataFrame, by: list[str]) -> DataFrame:
    """AGG-08: rules of each repository that were kept, are enabled, have a scope, and were skipped."""
    kept = F.col("skipped").isNull()
    return rules.groupBy(*by).agg(F.count_if(kept).alias("rules"), F.count_if(kept & F.col("enabled")).alias("enabled"), F.count_if(kept & (F.size("scope") > 0)).alias("scoped"), F.count_if(~kept).alias("skipped"))


def patched(profiles: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """CLS-06: stored overrides (source_id and some columns) win where they are not null."""
    o = overrides.select("source_id", *(F.col(c).alias(f"_{c}") for c in columns))
    return profiles.join(o, "source_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def in_scope(rules: DataFrame, sources: DataFrame, attributes: list[str]) -> DataFrame:
    """JN-05, FLT-09, SET-03: (source_id, seq, pattern, replacement): the cleaners of each source, each once, first repository first.

    rules: (repo, seq, pattern, replacement, scope). A rule without scope applies to all; a scope token is
    part of the source's attributes, or a pattern after "re:" (one that is none applies nowhere). Unscoped
    rules need no comparison; scoped ones are exploded to tokens and compared with each source, both sides
    being definitions, not data.
    """
    text = F.lower(F.concat_ws("\n", *attributes)).alias("_text")
    src = sources.select("source_id", text)
    free = rules.where(F.size("scope") == 0).select("repo", "seq", "pattern", "replacement")
    tokens = rules.where(F.size("scope") > 0).select("repo", "seq", "pattern", "replacement", F.explode("scope").alias("token"))

    @F.pandas_udf("boolean")
    def is_pattern(s):
        return s.map(lambda t: not t.startswith("re:") or X.valid(t[3:]))

    tokens = tokens.where(is_pattern("token"))
    fits = F.when(F.col("token").startswith("re:"), F.expr("_text rlike concat('(?U)', substring(token, 4))")).otherwise(F.contains("_text", F.col("token")))
    # what applies to all is repeated for each source because it is part of each source's list
    pairs = src.join(F.broadcast(free.agg(F.collect_list(F.struct("repo", "seq", "pattern", "replacement")).alias("_free")))).select("source_id", F.explode("_free").alias("_r")).select("source_id", "_r.*").unionByName(src.join(tokens, fits).select("source_id", "repo", "seq", "pattern", "replacement").distinct())
    w = Window.partitionBy("source_id", "pattern", "replacement").orderBy("repo", "seq")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
