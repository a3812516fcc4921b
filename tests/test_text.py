"""Text and address functions."""

import pytest
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions import urls


def one(spark, column, value="", name="c"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column).first()[0]


@pytest.mark.parametrize(
    "lines, want",
    [
        ("第1章 起\n他走进\n门里。\n\n她说\n“好。”\n结束", "　　第1章 起他走进门里。\n　　她说“好。”\n　　结束"), ("a\n第2章 b\nc", "　　a\n　　第2章 bc"), ("", ""), ("  \n ", ""), ("x\r\n注：y", "　　x\n　　注：y"),
    ],
)
def test_reflow(spark, lines, want):
    assert one(spark, X.reflow(F.col("c")), lines) == want


def test_cleaners(spark):
    c = F.col("c")
    assert one(spark, X.clean(c, [(r"(\w+)-(\w+)", r"\2-\1"), ("(", "x"), (r"\d", "$")]), "ab-cd 1") == "cd-ab $"
    assert one(spark, X.html_to_text(c), "<p>a<br>b</p><script>x</script><li>c &amp; d&nbsp;</li>") == "a\nb\n\nc & d"
    assert one(spark, X.unescape(c), "&eacute;&#x4e2d;") == "é中"
    assert one(spark, X.without_title(c, F.lit("T")), "\nT\nx\n T \ny") == "x\ny"
    assert one(spark, X.without_title(c, F.lit("T")), "T\n T") == "T\n T"
    assert one(spark, X.truncate(c, 3), "abcd") == "ab…"
    assert one(spark, X.without_page_markers(c), "a（第1/3页）\n点击下一页") == "a"
    assert one(spark, X.squash(c), "　a   b　") == "a b"
    assert one(spark, X.reflow(c), None) == ""


def test_matches_and_arguments(spark):
    c = F.col("c")
    assert [one(spark, X.title_match(c, F.lit(k)), " Abc ") for k in ("abc", "b", "z", "")] == ["exact", "contains", "other", "other"]
    assert [one(spark, X.author_match(c, F.lit(e)), a) for a, e in (("A", ""), ("", "a"), ("a", "A"), ("ab", "b"), ("x", "y"))] == ["unspecified", "missing", "exact", "contains", "mismatch"]
    assert one(spark, X.list_argument(c), '["a", " ", "b"]') == ["a", "b"] and one(spark, X.list_argument(c), "a, b,,a") == ["a", "b"]
    assert one(spark, X.headers(c), "A: b:c\n@x: 1\nbad\nC: @js:z") == {"A": "b:c"} and one(spark, X.headers(c), '{"K": "v"}') == {"K": "v"}
    assert [one(spark, X.int_argument(c), v) for v in ("5", "0", "x", "")] == [5, None, None, None]
    assert one(spark, X.slug(c), "  A b! 中 ") == "a-b-中" and one(spark, X.slug(c), "!!") == "source" and one(spark, X.file_name(c), 'a/b:"c". ') == "a_b_c_"
    assert one(spark, F.regexp_replace(F.lit("a.b axb"), X.literal_pattern(c), F.lit("-")), "a.b") == "- axb"


@pytest.mark.parametrize(
    "url, page, want",
    [("", "https://h.example/a/b", ""), ("http://x/y", "https://h.example/a/b", "http://x/y"), ("/r", "https://h.example/a/b", "https://h.example/r"), ("c", "https://h.example/a/b?q", "https://h.example/a/c"), ("?p=2", "https://h.example/a/b?q#f", "https://h.example/a/b?p=2"), ("//o.example/z", "https://h.example/a", "https://o.example/z"), ("c", "https://h.example", "https://h.example/c")],
)
def test_absolute(spark, url, page, want):
    from folioscale.rules.language import absolute

    assert one(spark, urls.absolute(F.col("c"), F.lit(page), F.lit("")), url) == want == absolute(url, page)


def test_urls_and_ids(spark):
    c = F.col("c")
    assert one(spark, urls.normalised(c), " HTTPS://H.Example/A/?x=1#f") == "https://h.example/A?x=1" and one(spark, urls.normalised(c), None) == ""
    assert tuple(one(spark, F.struct(*(x.alias(n) for n, x in zip("ab", urls.request_options(c)))), 'u?a=1,{"method":"POST"}')) == ("u?a=1", {"method": "POST"})
    assert one(spark, urls.percent_encoded(c, "gbk"), "中 a") == "%D6%D0%20a"
    assert one(spark, urls.epoch_text(c), "1700000000") == one(spark, urls.epoch_text(c), "1700000000000") == "2023-11-14 22:13" and one(spark, urls.epoch_text(c), "x") == "x"
    assert one(spark, urls.source_id(c, F.lit("u")), 'N"x') == "n-x-" + __import__("hashlib").sha1('{"name": "N\\"x", "source_url": "u"}'.encode()).hexdigest()[:12]
    assert one(spark, urls.merged(F.expr("map('a','1','b','2')"), F.expr("map('b','3')"))) == {"a": "1", "b": "3"}


def test_job_ids_options_and_merges(spark):
    import hashlib
    import json

    toc = [{"index": 0, "title": 'a "b" 中/é', "url": None}, {"index": 1, "title": "\\n", "url": "u"}]
    df = spark.createDataFrame([("灯笼", [(t["index"], t["title"], t["url"]) for t in toc])], "b string, t array<struct<index: int, title: string, url: string>>")
    want = hashlib.sha1(json.dumps({"book_name": "灯笼", "toc": toc}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:12]
    assert df.select(urls.job_id(F.col("b"), F.col("t"), df.schema["t"].dataType).alias("v")).first().v == f"灯笼-{want}"
    c = F.col("c")
    assert one(spark, urls.request_options(c)[1], "u,{'method': 'POST', 'webView': True}") == {"method": "POST", "webView": "true"} and one(spark, urls.request_options(c)[1], "u,{oops}") is None
    assert json.loads(one(spark, urls.merged_json(c, F.lit('{"a": {"y": 2}, "b": [1]}')), '{"a": {"x": 1, "y": 0}, "c": 3}')) == {"a": {"x": 1, "y": 2}, "b": [1], "c": 3}
    with pytest.raises(Exception, match="unknown keys: z"):
        one(spark, urls.merged_json(c, F.lit('{"z": 1}'), ["a"]), "{}")
    from html import unescape

    for t in ("&#8220;caf&eacute;&#x1F600;&#146;&#0;&bogus; R&D &amp;lt; &copy &nbsp;&hearts;", "&", "a&&amp;", "", None):
        assert one(spark, X.unescape(c), t) == (None if t is None else unescape(t.replace("&copy ", "&amp;copy ")))
    for u, page in (("../x.html", "https://h.example/a/b/c.html"), ("./x?q=../y", "https://h.example/a/"), ("../../..", "https://h.example/a/b/c"), ("/a/../b", "https://h.example/z")):
        assert one(spark, urls.absolute(c, F.lit(page), F.lit("")), u) == __import__("urllib.parse").parse.urljoin(page, u)
