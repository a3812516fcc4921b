"""Ranking, lists, journals, health, presentation, readers, sinks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from folioscale import sinks
from folioscale.functions import text as X
from folioscale.operators import health, journal, present, ranking, toc
from folioscale.sources import capability, readers
from folioscale.streaming import health as stream

JOB = "rec_id bigint, job_id string, kind string, index int, title string, url string, content string, error string, attempt int, state string, book_name string, output_filename string, chapters array<struct<index:int,title:string,url:string>>"


def jobs(spark):
    toc_ = [(0, "t0", "u0"), (1, "t1", "u1")]
    rows = [
        (1, "a", "manifest", None, None, None, None, None, None, None, "A", "a.txt", toc_), (2, "a", "chapter", 0, "old", "u0", "c0", None, 1, None, None, None, None), (3, "a", "error", 1, "t1", "u1", None, "e1", 1, None, None, None, None), (4, "a", "error", 1, "t1", "u1", None, "e2", 2, None, None, None, None), (5, "a", "chapter", 0, "new", "u0", "c0b", None, 2, None, None, None, None), (6, "a", "state", None, None, None, None, None, None, "running", None, None, None),
        (7, "b", "manifest", None, None, None, None, None, None, None, "B", "a.txt", toc_[:1]), (8, "b", "error", 0, None, None, None, "x", 1, None, None, None, None), (9, "b", "chapter", 0, "b0", "u", None, None, 2, None, None, None, None), (10, "c", "chapter", 0, None, None, "q", None, None, None, None, None, None), (11, "b", "chapter", None, "?", None, "?", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, JOB)


def test_journal(spark):
    j = jobs(spark)
    got = {r.job_id: r for r in journal.status(j).collect()}
    assert (got["a"].state, got["a"].total, got["a"].completed, got["a"].failed, got["a"].missing, got["a"].errors) == ("running", 2, 1, 1, 1, "1:e2")
    assert (got["b"].failed, got["b"].missing, got["c"].state) == (0, 0, "broken")
    assert [(r.job_id, r["index"]) for r in journal.missing(j).collect()] == [("a", 1)]
    assert [(r.job_id, r.piece) for r in journal.assembled(j).orderBy("position").collect()] == [("b", "B\n1\n\n"), ("b", "b0\n\n\n\n")]
    assert [(r.job_id, r.reserved_by) for r in journal.reserved(j).collect()] == [("b", "a")]
    assert journal.status(j.limit(0)).count() == 0 and journal.assembled(j.limit(0)).count() == 0
    plan = journal.status(j.withColumn("content", F.col("content")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan


def test_streaks(spark):
    rows = [("g", i, e) for i, e in enumerate([None, "x", "x", "y", None, "y", "y", "y"])]
    df = spark.createDataFrame(rows, "g string, i int, error string")
    got = journal.streaks(df, "g", ["i"], "error").orderBy("i").collect()
    assert [r.failures_in_row for r in got] == [0, 1, 2, 3, 0, 1, 2, 3] and [r.same_error_in_row for r in got] == [0, 1, 2, 1, 0, 1, 2, 3]
    assert [r.i for r in journal.stop_points(df, "g", ["i"], "error", 3, 6).collect()] == [7]


def test_toc(spark):
    rows = [("p", 0, "Book", "https://h.example/b/"), ("p", 1, "c1", "https://h.example/1"), ("p", 2, "c1 again", "https://h.example/1"), ("p", 3, "[倒序]", "https://h.example/x"), ("p", 4, "", "https://h.example/y"), ("q", 0, "正序", "https://h.example/z")]
    df = spark.createDataFrame(rows, "g string, pos int, title string, url string")
    kept = toc.reindexed(toc.without_noise(df, "g", F.lit("https://H.example/b"), F.lit(None).cast("string"), F.lit("book")), "g", ["pos"], "url")
    assert sorted((r.g, r["index"], r.title) for r in kept.collect()) == [("p", 0, "c1"), ("q", 0, "正序")]
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("9", None)], "url string, next string")
    starts = spark.createDataFrame([("s", "1"), ("t", "9")], "start string, url string")
    assert sorted((r.start, r.page, r.url) for r in toc.walked(starts, edges, 10).collect()) == [("s", 0, "1"), ("s", 1, "2"), ("s", 2, "3"), ("t", 0, "9")]
    n = spark.range(7).select(F.lit("g").alias("g"), F.col("id").alias("pos"))
    assert sorted(r.pos for r in toc.samples(n, "g", ["pos"], 3).collect()) == [0, 3, 6] and sorted(r.pos for r in toc.samples(n, "g", ["pos"], 5).collect()) == [0, 1, 2, 3, 6]
    assert [r.pos for r in toc.samples(n, "g", ["pos"], 1).collect()] == [0] and toc.samples(n, "g", ["pos"], 9).count() == 7
    pages = spark.createDataFrame([("c", 1, "", "b"), ("c", 0, "T", "a"), ("c", 2, None, " ")], "g string, n int, title string, content string")
    assert tuple(toc.joined_pages(pages, "g", "n", "title", "content").first()) == ("c", "T", "a\n\nb")
    saved = spark.createDataFrame([("b", "u", 0, "v0"), ("b", "w", 1, "v1"), ("c", "x", 0, "other book")], "g string, url string, index int, v string")
    want = spark.createDataFrame([("b", "u", 1), ("b", "zz", 0), ("b", None, 5)], "g string, url string, index int")
    assert sorted((str(r.url), r.v) for r in toc.restored(want, saved, "g", "url", "index", "v").collect()) == [("None", None), ("u", "v0"), ("zz", "v0")]


def test_long_lists_and_their_pages(spark):
    n = 150
    edges = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(n)] + [("a", "b"), ("b", "a"), ("z", "z")], "url string, next string")
    starts = spark.createDataFrame([("s", "u0"), ("t", f"u{n - 3}"), ("c", "a"), ("z", "z"), ("x", "nowhere")], "start string, url string")
    got = toc.walked(starts, edges, 100)
    assert {r.start: r.n for r in got.groupBy("start").agg(F.count("*").alias("n")).collect()} == {"s": 100, "t": 4, "c": 2, "z": 1, "x": 1}
    assert all(r.url == f"u{r.page}" for r in got.where("start = 's'").collect())
    base = "https://h.example/l"
    page = lambda k: f'<ul><li><a href="/c/{k}">C{k}</a></li><li><a href="/c/0">again</a></li><li><a>no link</a></li></ul><a id="n" href="?p={k + 1 if k < 11 else 3}">next</a>'
    pages = spark.createDataFrame([(f"{base}?p={k}", page(k)) for k in range(12)] + [(f"{base}?p=99", None)], "url string, html string")
    lists = toc.chapter_lists(spark.createDataFrame([("book", f"{base}?p=0"), ("none", f"{base}?p=99")], "start string, url string"), pages, {"chapterList": "li", "chapterName": "a@text", "chapterUrl": "a@href", "nextTocUrl": "#n@href"})
    rows = sorted((r["index"], r.title, r.url) for r in lists.where("start = 'book'").collect())
    assert rows == [(k, f"C{k}", f"https://h.example/c/{k}") for k in range(12)] and lists.where("start = 'none'").count() == 0


def test_resuming_a_job(spark):
    c = lambda *xs: [(i, f"t{i}", f"u{i}") for i in xs]
    rows = [(1, "a", "manifest", None, None, None, None, c(0, 1, 2)), (2, "a", "chapter", 0, "u0", "done", None, None), (3, "b", "manifest", None, None, None, None, c(0)), (4, "b", "chapter", 0, "u0", "x", None, None), (5, "c", "manifest", None, None, None, None, c(5)), (6, "d", "chapter", 0, "u0", "x", None, None)]
    schema = "rec_id long, job_id string, kind string, index int, url string, content string, state string, chapters array<struct<index: int, title: string, url: string>>, title string, error string"
    log = spark.createDataFrame([(*r, None, None) for r in rows], schema)
    store = spark.createDataFrame([("u1", "T1", "one"), ("u2", None, " "), ("u5", "", "five")], "url string, title string, content string")
    got = {(r.job_id, r.step, r["index"]): (r.kind, r.title, r.content, r.error, r.state, r.missing_count, r.error_count) for r in journal.resumed(log, store).collect()}
    assert got == {
        ("a", 0, None): ("state", None, None, None, "downloading", 2, None), ("a", 1, 1): ("chapter", "T1", "one", None, None, None, None), ("a", 1, 2): ("error", "t2", None, "chapter content empty", None, None, None), ("a", 2, None): ("state", None, None, None, "failed", None, 1),
        ("b", 2, None): ("state", None, None, None, "assembled", None, None),
        ("c", 0, None): ("state", None, None, None, "downloading", 1, None), ("c", 1, 5): ("chapter", "t5", "five", None, None, None, None), ("c", 2, None): ("state", None, None, None, "downloaded", None, None),
    }
    again = log.unionByName(journal.resumed(log, store).withColumn("rec_id", F.col("step") + 100).select("rec_id", "job_id", "kind", "index", "url", "content", "state", "title", "error"), allowMissingColumns=True)
    assert [(r.job_id, r["index"]) for r in journal.missing(again).collect()] == [("a", 2)]  # goes on where it ended
    assert {r.job_id for r in journal.without_finished(again).select("job_id").collect()} == {"a", "c", "d"}
    assert [r.wave for r in journal.waves(spark.range(5).withColumn("g", F.lit("x")), "g", ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert journal.resumed(log.limit(0), store).count() == 0 and journal.resumed(log, store.limit(0)).where("kind = 'error'").count() == 3


def test_priority_and_positions(spark):
    rows = [("none", True, None, None, None, None, None, None, None, None), ("zero", True, 0, 0, 0, 0, None, None, None, None), ("slow", True, 4, 3, 1, 0, 900.0, 0.0, 5.0, 1.0), ("fast", True, 4, 3, 1, 0, 900.0, 80.0, 5.0, 1.0), ("bad", True, 3, 1, 2, 1, 10.0, 10.0, 1.0, 9.0), ("off", False, 9, 9, 0, 0, 1.0, 1.0, 9.0, 0.0), ("ok", True, 9, 9, 0, 0, 0.0, 0.0, 9.0, 0.0)]
    names = ["source_id", "able", "attempts", "successes", "failures", "timeouts", "avg_duration_ms", "avg_success_ms", "last_success_at", "last_failure_at"]
    df = spark.createDataFrame(rows, "source_id string, able boolean, attempts int, successes int, failures int, timeouts int, avg_duration_ms double, avg_success_ms double, last_success_at double, last_failure_at double").repartition(3)
    stats = {k: F.col(k) for k in names[2:]}
    got = ranking.positions(df, [*ranking.priority_order(ranking.runtime_state(stats), F.col("able"), stats), F.col("source_id")])
    assert [r.source_id for r in got.orderBy("position").collect()] == ["ok", "off", "fast", "slow", "none", "zero", "bad"]
    assert sorted(r.position for r in ranking.positions(spark.range(1000), [F.col("id") % 7, F.col("id")]).collect()) == list(range(1, 1001))
    assert ranking.positions(df.limit(0), [F.col("source_id")]).count() == 0
    ranks = spark.createDataFrame([("template_x",), ("fallback_rule",), ("",), (None,), ("webview_dynamic",), ("javascript_dynamic",)], "e string")
    assert [tuple(r) for r in ranks.select(ranking.extractor_rank(F.col("e")), ranking.profile_rank(F.col("e"))).collect()] == [(0, 0), (1, 1), (2, 2), (2, 1), (3, 2), (4, 3)]


def test_identity_and_summaries(spark):
    df = spark.createDataFrame([(" Straße ", "A", "STRASSE", ""), ("x", "B", "", "b "), ("x", None, "X", "c"), ("y", "c", "x", "c")], "t string, a string, et string, ea string")
    assert [r.m for r in df.select(ranking.identity_mismatch(F.col("t"), F.col("a"), F.col("et"), F.col("ea")).alias("m")).collect()] == [None, None, "author", "title"]
    with pytest.raises(Exception, match="title mismatch"):
        ranking.checked_identity(df, "t", "a", F.col("et"), F.col("ea")).where("a = 'c'").collect()
    s = spark.createDataFrame([("n", "e", "broken"), (" ", "e", "broken"), (None, None, "degraded"), (None, None, None)], "n string, e string, s string")
    assert [r.m for r in s.select(ranking.stage_summary(F.col("n"), F.col("e"), F.col("s")).alias("m")).collect()] == ["n", "e", "最近探测不稳定", "尚无健康记录"]


def test_capability_of_definitions(spark):
    full = {"bookSourceName": "A", "bookSourceUrl": "https://a.example", "searchUrl": "/s", "ruleSearch": {"list": "li"}, "ruleBookInfo": {"name": "h1"}, "ruleToc": {"list": "li"}, "ruleContent": {"content": "#chr-content@text"}, "header": "X: 1\nY: a:b\nX: 2", "loginUrl": ""}
    odd = [full, full | {"ruleToc": "<js>x</js>"}, full | {"searchUrl": 's,{"webView": true}'}, full | {"singleUrl": True, "loginUrl": "login()=>1"}, full | {"ruleContent": {"content": ".reading-content"}, "jsLib": "x", "loginUi": "[{}]"}, {"title": " "}]
    text = __import__("json").dumps(odd, ensure_ascii=False)
    df = readers.source_definitions(spark.createDataFrame([(text,)], "text string"))
    got = capability.strategy(capability.family(capability.capability(capability.normalised(df)))).orderBy("pos").collect()
    assert [(r.supports_search, r.supports_download, r.template_family, r.search_mode, r.download_mode) for r in got] == [
        (True, True, "novelfull_like", "keyword_search", "chapter_list"), (True, False, "javascript_dynamic", "keyword_search", "unsupported_js"), (False, True, "webview_dynamic", "unsupported_webview", "chapter_list"),
        (True, True, "single_url", "single_url", "chapter_list"), (True, True, "authenticated_html", "keyword_search", "chapter_list"), (False, False, "generic_html", "missing_rules", "missing_rules"),
    ]
    assert got[0].headers == {"X": "2", "Y": "a:b"} and got[0].issues == [] and got[5].name == "未命名书源" and len(got[4].issues) == 2
    o = spark.createDataFrame([({"webView": "true"},), ({"js": "x"},), ({"js": " "},), (None,)], "o map<string,string>")
    assert [r.r for r in o.select(capability.request_refusal(F.col("o")).alias("r")).collect()] == ["webView", "js", None, None]


def test_page_store(spark):
    store = spark.createDataFrame([("https://h.example/a", "中文".encode("gbk"), None), ("https://h.example/a k=1", b"posted", None), ("https://h.example/b", None, None)], "url string, bytes binary, charset string")
    asked = spark.createDataFrame([(1, 'https://H.example/a#x,{"charset": "gbk"}'), (2, 'https://h.example/a,{"body": "k=1", "method": "POST"}'), (3, "https://h.example/b"), (4, 'https://h.example/a,{"webView": 1}'), (5, None)], "id int, url string")
    got = {r.id: (r.text, r.error) for r in readers.fetched(asked, store).collect()}
    assert got == {1: ("中文", None), 2: ("posted", None), 3: (None, "page not found"), 4: (None, "refused: webView"), 5: (None, "page not found")}
    torn = spark.createDataFrame([('{"a": 1}\n{"a": 2}\n',), ('{"a": 3}\n{"a"',)], "text string")
    assert sorted(r.record.a for r in readers.journal_lines(torn, "a int").collect()) == [1, 2, 3]


def test_marks_and_entities(spark):
    rows = [("a", "search", 1.0, 1, True, 5.0, None, "fine", None), ("a", "search", 2.0, 2, None, None, None, "no rules", "unsupported"), ("b", "search", 2.0, 2, None, None, None, None, "unknown"), ("b", "search", 3.0, 3, False, 7.0, "timeout", None, None)]
    df = spark.createDataFrame(rows, "source_id string, stage string, at double, id long, ok boolean, elapsed_ms double, error string, note string, mark string")
    got = {r.source_id: (r.state, r.attempts, r.successes, r.avg_ms, r.last_error, r.note) for r in health.health(df).collect()}
    assert got == {"a": ("unsupported", 1, 1, 5.0, None, "no rules"), "b": ("broken", 1, 0, 7.0, "timeout", "")}
    t = spark.createDataFrame([("<p>&#8220;caf&eacute;&#8221; &amp;lt; R&D &nbsp;&hellip;</p>",), ("a &lt; b",), (None,)], "h string")
    assert [r.t for r in t.select(X.html_to_text(F.col("h")).alias("t")).collect()] == ["“café” &lt; R&D \xa0…", "a < b", None]


EVENT = "source_id string, stage string, at double, id long, ok boolean, elapsed_ms double, error string, metadata map<string,string>"


def events(spark, n=400):
    rnd = random.Random(5)
    return spark.createDataFrame([(rnd.choice(["a", "b", "hot", "hot"]), rnd.choice(health.STAGES), float(rnd.randint(0, 50)), i, rnd.random() < 0.6, rnd.choice([None, -5.0, 10.5, 3.25]), rnd.choice(["timeout", "HTTP 500", "bad"]), {"k": str(i)} if i % 3 else None) for i in range(n)], EVENT)


def test_health_folds_agree_with_brute_force_and_stream(spark, tmp_path):
    df = events(spark)
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["at"], r["id"]))
    want = {}
    for r in rows:
        s = want.setdefault((r["source_id"], r["stage"]), [0, 0, 0, "", None])
        s[0 if r["ok"] else 1] += 1
        s[2] += not r["ok"] and r["error"] == "timeout"
        s[3] = "healthy" if r["ok"] else "degraded" if s[0] and s[1] <= s[0] else "broken"
        s[4] = None if r["ok"] else r["error"]
    got = {(r.source_id, r.stage): [r.successes, r.failures, r.timeouts, r.state, r.last_error] for r in health.health(df).collect()}
    assert got == want
    df.drop("metadata").repartition(6).write.parquet(str(tmp_path / "in"))
    q = stream.health_stream(spark.readStream.schema(df.drop("metadata").schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("h").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("h").collect():
        k = (r.source_id, r.stage)
        if k not in last or r.successes + r.failures > sum(last[k][:2]):
            last[k] = [r.successes, r.failures, r.timeouts, r.state, r.last_error]
    assert last == want
    mean = {}
    for r in rows:
        n, m = mean.get(r["source_id"], (0, 0.0))
        v = max(0.0, r["elapsed_ms"] or 0.0)
        mean[r["source_id"]] = (n + 1, round(v if n == 0 else (m * n + v) / (n + 1), 3))
    assert {r.source_id: (r.n, r["mean"]) for r in health.rolling_means(df).collect()} == mean
    full = health.with_defaults(spark.createDataFrame([("a",), ("none",)], "source_id string"), health.health(df))
    assert full.count() == 6 and health.by_stage(full).where("source_id = 'none' and search = 'unknown'").count() == 1
    assert health.stats(df.limit(0)).count() == 0 and health.rolling_means(df.limit(0)).count() == 0


def test_presentation(spark):
    df = spark.range(30)
    rows = present.page(df, [F.col("id")], 10, 5).collect()
    assert [r.id for r in rows] == [10, 11, 12, 13, 14] and (rows[0].next_offset, rows[0].omitted, rows[0].has_more) == (15, 15, True)
    assert present.page(df, [F.col("id")], 28, 5).first().next_offset is None
    assert present.within_budget(df.withColumn("g", F.lit(1)), "g", [F.col("id")], 30).count() == 2 and present.clamp(500) == 200


def test_readers(spark, tmp_path):
    blobs = ["中文".encode("gb18030"), "été".encode(), b"\xff\xfe\xff", b'<meta charset="big5">' + "中".encode("big5"), None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, b binary")
    got = [r.t for r in df.select("id", readers.decoded(F.col("b")).alias("t")).orderBy("id").collect()]
    assert got[0] == "中文" and got[1] == "été" and got[3].endswith("中") and got[4] is None and isinstance(got[2], str)
    refs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "ref string, signature string")
    done = spark.createDataFrame([("a", "1", "succeeded", 0.0), ("b", "1", "running", 990.0), ("c", "1", "running", -5000.0), ("d", "0", "succeeded", 0.0)], "ref string, signature string, status string, at double")
    assert sorted(r.ref for r in readers.new_refs(refs, done, 1000.0).collect()) == ["c", "d"]
    assert readers.backfilled(refs.limit(1), refs, ["ref"]).count() == 4
    (tmp_path / "x.txt").write_text("one\ntwo")
    assert readers.text_files(spark, str(tmp_path / "x.txt")).first().text == "one\ntwo"
    assert readers.byte_files(spark, str(tmp_path)).first().text == "one\ntwo"


def test_scope(spark):
    rules = spark.createDataFrame([(1, 0, "p", "", []), (1, 1, "q", "", ["re:["]), (2, 0, "p", "", ["x"]), (2, 1, "r", "", ["re:^s1", "two"])], "repo int, seq int, pattern string, replacement string, scope array<string>")
    src = spark.createDataFrame([("s1", "x"), ("s2", "two")], "source_id string, name string")
    assert sorted((r.source_id, r.repo, r.pattern) for r in capability.in_scope(rules, src, ["source_id", "name"]).collect()) == [("s1", 1, "p"), ("s1", 2, "r"), ("s2", 1, "p"), ("s2", 2, "r")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, v long, s string"), ["k"], "v")
    sinks.upsert(spark, path, spark.createDataFrame([("b", 1, "z"), ("a", 3, "w")], "k string, v long, s string"), ["k"], "v")
    assert sorted(tuple(r) for r in sinks.current(spark, path).collect()) == [("a", 3, "w"), ("b", 1, "z")]
    pieces = journal.assembled(jobs(spark))
    sinks.write_text(pieces, str(tmp_path / "out"))
    files = list((tmp_path / "out" / "job=b").glob("part-*"))
    assert "".join(f.read_text() for f in files) == "B\n1\n\nb0\n\n\n\n"
    sinks.append_journal(spark.range(2), str(tmp_path / "j"))
    sinks.append_journal(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 5
