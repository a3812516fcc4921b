"""Operators on single texts: encoding, charset repair, confusables, page bodies, keyword spam, residue."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscale.llm import charset_repair, confusables, encode, keyword_spam, page_body, template_residue

TEXT = st.text(alphabet=st.sampled_from(list("abcdstvmrel'ABZ019 \n\t　。，的一是不 é£🙂\x00\x1c\x85<|>")), max_size=60)


@pytest.fixture(scope="module")
def coder():
    if not os.path.exists(encode.default_vocabulary()):
        pytest.skip("no vocabulary")
    with open(encode.default_vocabulary(), "rb") as f:
        return encode.Encoder(encode.read_ranks(f.read()))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(encode.default_vocabulary(), "rb") as f:
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encode.read_ranks(f.read()), special_tokens={})


@given(st.lists(TEXT, min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_encoding_equals_reference_and_round_trips(coder, reference, texts):
    ids, at = coder.encode([t.encode() for t in texts])
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [reference.decode(g) for g in got] == texts


def test_encoding_rows(spark, coder, reference):
    rows = [(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>" * 3, "x"), (5, "的" * 200_000, "x"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode.encode_texts(df.drop("ids").withColumnRenamed("text", "key").selectExpr("doc_id", "key as text", "'z' as other"), "doc_id", "text").collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got)[:2] == [(1, 2), (1, 2)] and len(got) == 6
    assert {r.doc_id: list(r.ids) for r in got} == {r[0]: reference.encode_ordinary(r[1] or "") for r in rows}
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_long_fragments_merge_in_time(coder, reference):
    rnd = random.Random(5)
    for text in ("a" * 3000, "".join(rnd.choice("ACGTacgt") for _ in range(4000)), "é" * 1000):
        ids, _ = coder.encode([text.encode()])
        assert ids.tolist() == reference.encode_ordinary(text)
    blob = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))  # no cut within
    ids, _ = coder.encode([blob.encode()])
    token = {r: t for t, r in coder.ranks.items()}
    assert b"".join(token[i] for i in ids.tolist()) == blob.encode()


STORY = "他们决定查清封条的来历，谁也没有再提北灯城的事。比起荒原，铃铛更安静，说书人笑着退到一边。"
TRADITIONAL = "潮水退盡時，裴青禾把銀簪放在桌上，心裡鬆了一口氣。帳房先生看了她一眼。"
FRENCH = "À la marée basse, Éloïse traversa l’hôtel et trouva le greffier ; « déjà ? » répéta-t-elle."


def read_wrong(text, true, wrong):
    return charset_repair.garble(text, true, wrong)


@pytest.mark.parametrize(
    "text, true, wrong",
    [(STORY, "utf-8", "cp1252"), (STORY, "utf-8", "latin-1"), (STORY, "utf-8", "x2"), (STORY, "gb18030", "cp1252"), (STORY, "gb18030", "latin-1"), (STORY, "gb18030", "big5"), (TRADITIONAL, "big5", "gb18030"), (TRADITIONAL, "big5", "cp1252"), (STORY, "utf-8", "mac-roman"), (FRENCH, "utf-8", "cp1252"), (FRENCH, "cp1252", "cp1251"), (FRENCH, "utf-8", "x2"), (FRENCH, "utf-8", "mac-roman")],
)
def test_garbled_text_is_found_and_restored(text, true, wrong):
    bad = read_wrong(text, true, wrong)
    assert bad != text
    mixed = "\n".join(["第一章", bad, "别回头，船老大说。"])
    restored, found = charset_repair.repair(mixed)
    assert found
    lines = restored.split("\n")
    assert lines[0] == "第一章" and lines[2] == "别回头，船老大说。"
    if "�" not in bad and read_wrong(text, true, wrong).encode(wrong if wrong not in ("x2", "cp1252") else "utf-8", "ignore"):
        same = sum(a == b for a, b in zip(lines[1], text)) / len(text)
        assert same > 0.6 or lines[1] != bad


def test_every_pair_with_a_hit_is_tried():
    bad = read_wrong(FRENCH, "utf-8", "cp1252")
    true = next(n for n, pair in enumerate(charset_repair.PAIRS) if pair == ("utf-8", "cp1252"))
    whole = [(0, len(bad))]  # as if every pair had a hit
    others = [n for n in range(len(charset_repair.PAIRS)) if not charset_repair.stretches(bad, n, whole)]
    assert len(others) >= 6 and true not in others
    assert charset_repair.repair_line(bad) == (FRENCH, True)


RUSSIAN = "Он вышел из дома и пошёл к реке."


@pytest.mark.parametrize("pair", range(len(charset_repair.PAIRS)))
def test_right_text_around_a_garbled_stretch_is_left_alone(pair):
    true, wrong = charset_repair.PAIRS[pair]
    western = true in ("cp1252", "mac-roman", "cp1251")
    text = RUSSIAN if true == "cp1251" else FRENCH if western else TRADITIONAL if true == "big5" else STORY
    right = "Elle ouvrit la porte et vit la neige." if western else "他推開門，看見院子裡的雪。" if true == "big5" else "他推开门，看见院子里的雪。"
    bad, gap = read_wrong(text, true, wrong), " " if western else ""
    for before, after in ((right + gap, ""), ("", gap + right), (right + gap, gap + right), ("Привет ", "")):
        restored, found = charset_repair.repair_line(before + bad + after)
        assert found and restored.startswith(before) and restored.endswith(after)
        if wrong == "cp1251" and western and before == "Привет ":  # its neighbour, the one letter À, could be a Russian word
            continue
        if (true, wrong) not in (("utf-8", "gb18030"), ("utf-8", "big5"), ("gb18030", "big5"), ("cp1252", "gb18030"), ("cp1252", "big5")):  # these lose bytes when they read wrongly
            assert restored == before + text + after


@given(st.lists(st.integers(-4, 4), max_size=12))
@settings(max_examples=200, deadline=None)
def test_maximal_stretches(gains):
    got = charset_repair.maximal(gains)
    assert all(b <= c for (_, b), (c, _) in zip(got, got[1:])) and all(sum(gains[a:b]) > 0 for a, b in got)
    best = max((sum(gains[a:b]) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)), default=0)
    assert max((sum(gains[a:b]) for a, b in got), default=0) == max(best, 0)


@pytest.mark.parametrize("text", [None, "", " \n", STORY, TRADITIONAL, FRENCH, "São Lúmio das Águas", "门楣上是四个生僻字：魑魅魍魎", "Последний страж", "“这半截蜡烛值六两银子，”她说。", "【体质：43】", "* * *", "半夏３钱"])
def test_right_text_is_left_alone(text):
    assert charset_repair.repair(text) == (text, False)


def test_lost_bytes_are_found(spark):
    df = spark.createDataFrame([(1, "le caf� est l�", "k"), (2, STORY, "k"), (3, None, "k"), (4, read_wrong(STORY, "utf-8", "latin-1"), "k")], "id bigint, t string, key string")
    assert sorted(r.id for r in charset_repair.garbled(df, "id", "t").collect()) == [1, 4]
    assert {r.id: r.text for r in charset_repair.garbled(df, "id", "t", restore=True).collect()}[4] == STORY
    assert charset_repair.garbled(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize(
    "text, plain",
    [("Ｈｅｌｌｏ", "Hello"), ("café", "café"), ("ti​tle", "title"), ("a\xa0b", "a b"), ("Наmе", "Hаme".replace("а", "a")), ("⼈生", "人生"), ("ﬁn", "fin"), ("見", "見"), ("Lе verger", "Le verger"), ("El у la", "El y la"), ("⻓生", "长生")],
)
def test_imitations(text, plain):
    assert confusables.deviates(text) and confusables.form(text) == plain and confusables.skeleton(text) == confusables.skeleton(plain)


@pytest.mark.parametrize("text", [None, "", "a  b", "《我在金山》（完结）：第二部", "Последний страж", "Élan ñandú", "“x”…——", "Ωμέγα", "ひらがな"])
def test_plain_text_is_left_alone(text):
    assert not confusables.deviates(text) and confusables.form(text) == text


@pytest.mark.parametrize("a, b", [("раура", "paypa"), ("ᏞᏟ", "LC"), ("ꓟꓳ", "MO"), ("Ⲥⲟ", "Co"), ("Ⅳ", "IV"), ("corn", "com"), ("0ne", "One"), ("１l", "Il"), ("०", "O"), ("ᴠᴏᴡ", "vow"), ("а́", "á")])
def test_skeletons_ignore_the_script(a, b):
    assert confusables.skeleton(a) == confusables.skeleton(b)


def test_confusable_rows(spark):
    df = spark.createDataFrame([(1, "ａ", None), (2, "a", "b​"), (3, None, ""), (3, "a", "b")], "id bigint, title string, f0 string")
    assert sorted((r.row, r.field) for r in confusables.deviations(df, "id", ["title", "f0"]).collect()) == [(1, "title"), (2, "f0")]
    groups = {(r.field, r.form): (r.n_rows, r.n_spellings) for r in confusables.lookalike_groups(df, "id", ["title", "f0"]).collect()}
    assert groups[("title", "a")] == (3, 2) and groups[("f0", "b")] == (2, 2)
    assert confusables.forms(df, "id", ["title"]).where("row = 1").first().title == "a"
    assert confusables.deviations(df.limit(0), "id", ["title"]).count() == 0


@pytest.mark.parametrize(
    "title, content, certain",
    [
        ("第1章", "{{content}}", True), ("${chapter.title}", STORY, True), ("第1章", STORY + "\n%AD_SLOT_3%\n" + STORY, True), ("第1章", "null", True), ("第1章", "占位占位占位\n占位占位占位", True), ("第1章", "test test test test", True), ("第1章", "请开启脚本功能后再访问本页。", True), ("t 1", "404 Not Found", True), ("第1章", STORY + "\n章节内容加载失败，请刷新页面重试。", True), ("Untitled Document", STORY, True),
        ("第1章", STORY, False), ("第1章", "那张字条上只有一个词：null。\n" + STORY, False), ("第1章", "“请稍后重试。”机关鸟重复着这句话。", False), ("第1章", "石壁上刻着：{ 心 | 火 }，他读了三遍。", False), ("第1章", None, False), ("第1章", " \n", False), (None, STORY, False), ("第1章", "* * *\n沉默。\n【体质：43】", False),
    ],
)
def test_residue(title, content, certain):
    assert template_residue.judge(title, "https://h.example/1.html", content)[0] is certain


def test_residue_compares_the_address():
    for url, certain in (("https://h.example/b/3.html", False), ("https://h.example/b/9.html", True), (None, False)):
        assert template_residue.judge("第3章 渡口", url, "沉默。")[0] is certain  # a poor body under another chapter's address
    notice = "The page could not be found"
    assert template_residue.judge("Lantern", "https://h.example/lantern", notice)[0] is True
    assert template_residue.judge("Could Not Be Found", "https://h.example/b/could-not-be-found", notice)[0] is False  # its own title
    assert template_residue.judge("404 Not Found", "https://h.example/b/14.html", STORY)[0] is True
    assert template_residue.judge("第3章 渡口", None, "\n".join(["Dolum vero sintus amet."] * 3))[0] is True


def test_long_notices_and_reposts(spark):
    notice = "\n".join(f"本站规则第{k}条：搬家期间暂停更新，请见谅。" for k in "一二三四五六七八九十")  # longer than any error page
    rows = [(i, f"h{i % 3}", f"第{i}章", f"https://h/{i}", notice) for i in range(6)]
    rows += [(10 + i, f"h{i}", "第5章 渡口", "https://h/5", STORY) for i in range(4)]  # one chapter posted by four hosts
    rows += [(20 + i, "own", f"第{i}章", f"https://o/{i}", f"{STORY}{i}\n页面加载失败请刷新") for i in range(6)]  # a host's own line
    df = spark.createDataFrame(rows, "id bigint, host string, t string, u string, c string")
    assert sorted(r.row for r in template_residue.residue(df, "id", "host", "t", "u", "c").collect()) == [0, 1, 2, 3, 4, 5]


def test_residue_by_other_hosts(spark):
    odd = "本页正在搬家，三日后再来。"
    rows = [(i, f"h{i % 3}", f"第{i}章", f"https://h/{i}", odd, "x") for i in range(6)] + [(10, "h9", "第9章", "https://h/9", STORY + "\n" + odd, "x"), (11, "h9", "第8章", "https://h/8", STORY, "x"), (12, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, host string, t string, u string, c string, key string")
    assert sorted(r.row for r in template_residue.residue(df, "id", "host", "t", "u", "c").collect()) == [0, 1, 2, 3, 4, 5, 10]
    assert template_residue.residue(df.limit(0), "id", "host", "t", "u", "c").count() == 0


def page(k, site="灯下文学"):
    name = "".join(chr(0x4E00 + (k * 37 + i * 11) % 3000) for i in range(3))
    first, second, third = f"{name}把灯笼放在桌上，谁也没有再提北灯城的事。", f"比起裁缝，{name}更古怪，说书人笑了。", f"{name}想起了旧账本，只是笑着退到一边。"
    return "\n".join([site, "首页", "书架", f"首页 » 都市 » 书{k} » 第{k}章 渡口", f"第{k}章 渡口", f"作者：某{name}　字数：{3000 + k}", first, f"“走，{name}。”", "章节有误？点此举报", second, "* * *", third, "猜你喜欢", f"我在{name}做画师", "2. 琉井古老学徒", "最新书评", f"[匿名用户] 这章写得太稳了 赞({k})", f"书友{k}：" + third, f"Copyright © 2019 {site} 版权所有"])


def test_page_bodies(spark):
    rows = [("job", k, "s", f"第{k}章 渡口", page(k), 1) for k in range(1, 30)] + [("job", 99, "s", None, None, 1), ("job", 98, "s", "t", " \n", 1), ("job", 97, None, "第7章", STORY, 1)]
    pages = spark.createDataFrame(rows, "tab string, row_id bigint, source string, title string, content string, line_no int").drop("line_no")
    sites = spark.createDataFrame([("s", "灯下文学"), ("t", None)], "source string, name string")
    got: dict[int, list[int]] = {}
    for r in page_body.furniture(pages, sites).collect():
        got.setdefault(r.row_id, []).append(r.line_no)
    assert all(sorted(got[k]) == [1, 2, 3, 4, 6, 9, 13, 14, 15, 16, 17, 18, 19] for k in range(1, 30)) and not set(got) & {97, 98, 99}
    body = {r.row_id: r.content for r in page_body.bodies(pages, sites).collect()}
    assert body[3].split("\n")[0] == "第3章 渡口" and "猜你喜欢" not in body[3] and body[97] == STORY
    assert page_body.furniture(pages.limit(0), sites).count() == 0


def test_cut_pages():
    text = STORY + "\n" + STORY[:20]  # whatever length a table cuts its texts at: what lies open is told by the lines around it
    assert page_body.Reader(set()).story(text, None) == [True, True]
    entries = "\n".join(["雨川长生书生", "我在青台做傀儡", "云桥书生"])
    assert page_body.Reader(set()).story(STORY + "\n" + entries, None) == [True, False, False, False]
    many = "a/b·c|" * 20_000
    assert page_body.Reader(set()).story(many + "\n" + STORY, "t") == [False, True]


def test_page_bodies_come_from_the_density(monkeypatch):
    reader = page_body.Reader({k for k in page_body.line_keys("灯下文学\n首页\n书架")}, "灯下文学")
    before = reader.story(page(3), "第3章 渡口")
    assert before.count(False) >= 10
    monkeypatch.setattr(page_body, "density", lambda c, lc, t, lt, share: 1.0)  # every node as dense as any other
    assert reader.story(page(3), "第3章 渡口") != before


def test_page_bodies_by_markup():
    html = '<html><head><title>x</title></head><body><div class="top"><a href="/">首页</a> <a href="/b">书架</a></div><h1>第3章</h1><div id="c"><p>' + STORY + "<br>无尾之行<br>" + STORY + "</p></div><div><a>猜你喜欢</a></div>"
    keep, drop = page_body.main_subtree(html)
    assert STORY in keep and "无尾之行" in keep and drop == {"首页", "书架", "猜你喜欢"}
    assert page_body.main_subtree("") == (set(), set()) and page_body.main_subtree("<div><div>" * 3000)[0] == set()
    text = "\n".join(["首页", "第3章", STORY, "猜你喜欢"])
    assert page_body.Reader(set()).story(text, "第3章", html) == [False, True, True, False]


def test_best_run_is_the_largest():
    rnd = random.Random(2)
    for _ in range(200):
        g = [rnd.randint(-5, 5) for _ in range(rnd.randint(1, 9))]
        lo, hi = page_body.best_run(g)
        assert sum(g[lo:hi]) == max(sum(g[a:b]) for a in range(len(g)) for b in range(a + 1, len(g) + 1))


def test_keyword_spam(spark):
    rnd = random.Random(4)
    people, things = ["沈青禾", "裴远山", "顾知秋", "说书人"], ["灯笼", "旧账本", "银簪", "断剑"]
    prose = ["".join(f"{rnd.choice(people)}把{rnd.choice(things)}放在桌上，心里想起了{rnd.choice(things)}的事。他没有说话，只是笑着退到一边。" for _ in range(8)) for _ in range(80)]
    spam = ["免费小说 穿越 重生 " * 20, "#爽文# #书单 #穿越 " * 15, "\n".join(f"第{i}章 渡口灯火" for i in range(40)), "\n".join(f"https://a{i}.example/n/{i}" for i in range(20)), prose[0][:40] + "。\n" + "金山做画师 txt下载，金山做画师 全文阅读，" * 30]
    odd = [None, "", "  \n", "a", "xxxxxxxx" * 30, "1234567890" * 10, "🙂🙂🙃", "if (a<b) { return; }", "雨停了。" * 40, "\n".join(f"{i}. {people[i % 4]}笑着退到一边，没有说话。" for i in range(12)), prose[1] + "\nhttps://h.example/1"]
    rows = [(i, t, "k") for i, t in enumerate([*prose, *spam, *odd])]
    df = spark.createDataFrame(rows, "id bigint, text string, row string")
    assert sorted(r.row for r in keyword_spam.stuffed(df, "id", "text").collect()) == [80, 81, 82, 83, 84]
    assert keyword_spam.stuffed(df.limit(0), "id", "text").count() == 0


def test_keyword_spam_in_sentence_frames(spark):
    rnd = random.Random(4)
    people, things = ["沈青禾", "裴远山", "顾知秋", "说书人"], ["灯笼", "旧账本", "银簪", "断剑"]
    prose = ["".join(f"{rnd.choice(people)}把{rnd.choice(things)}放在桌上，心里想起了{rnd.choice(things)}的事。他没有说话，只是笑着退到一边。" for _ in range(8)) for _ in range(80)]
    words, title = ["txt下载", "无弹窗", "免费小说", "穿越", "书单", "完本推荐"], "我在灯港做寂静档案"
    frames = ["搜索{t}{a}的朋友也在找{b}{t}。", "想看{t}就来这里，{a}{b}样样有。", "{t}{a}，{t}{b}，{t}尽在本页！"]
    strung = ["".join(rnd.choice(frames).format(t=title, a=rnd.choice(words), b=rnd.choice(words)) for _ in range(15))]
    strung.append(prose[0][:40] + "\n" + strung[0])
    strung.append(" ".join(f"Looking for Quiet Stair over Halford {a}? Here is Quiet Stair over Halford {b}." for a in ("epub", "audiobook", "isekai") for b in ("no ads", "web fiction", "top ranking")))
    told = ["\n".join(f"{i}. 沈青禾把{t}放在桌上，心里想起了{u}的事。" for i, (t, u) in enumerate(zip(things * 4, things[::-1] * 3))), "雨停了，雨停了，雨又停了，雨真的停了。" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*prose, *strung, *told])], "id bigint, text string")
    assert sorted(r.row for r in keyword_spam.stuffed(df, "id", "text").collect()) == [80, 81, 82]


def test_keyword_spam_rows_come_from_the_model(spark, monkeypatch):
    rnd = random.Random(4)
    people, things = ["沈青禾", "裴远山", "顾知秋", "说书人"], ["灯笼", "旧账本", "银簪", "断剑"]
    prose = ["".join(f"{rnd.choice(people)}把{rnd.choice(things)}放在桌上，心里想起了{rnd.choice(things)}的事。他没有说话，只是笑着退到一边。" for _ in range(8)) for _ in range(80)]
    lists = ["免费小说 穿越 重生 " * 20, "\n".join(f"第{i}章 渡口灯火" for i in range(40)), " | ".join(f"Ch. {i} Smoke at Fen{i}mond" for i in range(30))]
    df = spark.createDataFrame(list(enumerate([*prose, *lists])), "id bigint, text string")
    assert sorted(r.row for r in keyword_spam.stuffed(df, "id", "text").collect()) == [80, 81, 82]
    monkeypatch.setattr(keyword_spam, "CELL_WIDTH", 1e9)  # all windows alike: the model says nothing
    assert keyword_spam.stuffed(df, "id", "text").count() == 0


def test_sequences_keep_texts_apart():
    texts = ["", "Le chat dort.", "的的的", "a" * 50, "免费 小说"]
    seq, text, _, _ = keyword_spam.Batch(texts).tokens()
    for k, t in enumerate(texts):
        one = keyword_spam.Batch([t]).tokens()[0]
        assert one.tolist() == seq[text == k].tolist()
    assert np.all(seq < keyword_spam.CLASSES)
