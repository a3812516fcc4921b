"""Extraction with fallback, attempts, probes, and the facade."""

import pytest
from pyspark.sql import functions as F

from folioscale.api import Config, Engine
from folioscale.operators import extract, probe


def test_patterns_and_presets(spark):
    df = spark.createDataFrame([("<h1>第7章</h1>",), ("x",), (None,)], "c string")
    assert [r.v for r in df.select(extract.by_pattern(F.col("c"), "第(\\s*)(\\d+)章", 2).alias("v")).collect()] == ["7", None, None]
    pages = spark.createDataFrame([(1, '<h2>T</h2><div id="content"><p>a</p><p>b</p></div>'), (2, '<h1>U</h1><div class="entry-content"><p>c</p></div>'), (3, "<p>no</p>"), (4, None)], "id int, html string")
    got = extract.with_fallback(pages, "html", list(extract.PRESETS.values())).orderBy("id").collect()
    assert [(r.preset, r.title, r.content) for r in got] == [(2, "T", "a\nb"), (0, "U", "c"), (None, "", ""), (None, "", "")]


def test_chapter_pages_with_a_cycle(spark):
    starts = spark.createDataFrame([("k", "https://h.example/1")], "start string, url string")
    pages = spark.createDataFrame([("https://h.example/1", "<h1>T</h1><p>T</p><p>一。</p><a class=n href='/2'>"), ("https://h.example/2", "<p>二。</p><a class=n href='/1'>")], "url string, html string")
    assert tuple(extract.chapter_texts(starts, pages, {"title": "h1@text", "content": "p@text", "nextContentUrl": "a.n@href"}).first()) == ("k", "T", "　　一。\n　　二。")


def test_attempts_and_time(spark):
    df = spark.createDataFrame([("a", i, i == 3) for i in range(6)] + [("b", i, False) for i in range(20)], "g string, i int, ok boolean")
    tried = probe.attempts(df, "g", [F.col("i")], F.col("ok"))
    assert [r.i for r in tried.where("g = 'a'").orderBy("i").collect()] == [0, 1, 2, 3]
    assert {r.g: (r.attempts, r.status) for r in probe.run_status(tried, "g").collect()} == {"a": (4, "started"), "b": (12, "exhausted")}
    t = spark.createDataFrame([("r", i, 2.0) for i in range(4)], "g string, i int, ms double")
    assert [r.progress for r in probe.within_time(t, "g", ["i"], "ms", 5.0).orderBy("i").collect()] == ["completed", "completed", "timed_out", "unsearched"]
    none = spark.createDataFrame([("s", True, True), ("t", False, True), ("u", True, False)], "source_id string, supports_search boolean, supports_download boolean")
    n = spark.createDataFrame([("s", 3), ("u", 1)], "source_id string, n int")
    got = sorted(tuple(r) for r in probe.probe_events(none, n, n, n.where("n > 9"), 5).collect())
    assert got == [("s", "download", "broken"), ("s", "preflight", "healthy"), ("s", "search", "healthy"), ("t", "search", "unsupported"), ("u", "preflight", "unsupported"), ("u", "search", "healthy")]


def test_facade(spark, data, tmp_path):
    e = Engine(spark, data)
    assert e.sources(limit=3).count() == 3 and e.status().count() > 0 and e.missing("none").count() == 0
    title = spark.read.parquet(f"{data}/search_hit.parquet").where("title is not null").first().title.strip()
    assert e.candidates(title[:4]).count() > 0
    e.assemble(str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("job=*"))
    assert e.import_sources('{"bookSourceName": "x", "bookSourceUrl": "https://x.example"}').first().search_mode == "missing_rules"
    assert e.import_clean_rules("a##b").first().pattern == "a" and e.import_clean_rules('[{"pattern": "c"}]').first().pattern == "c"
    with pytest.raises(ValueError):
        Config(limit=0)
