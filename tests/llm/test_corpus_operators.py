"""Operators on whole tables: repeated lines, leakage, entity matching; and the queries."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscale.llm import entity_match, leakage, site_lines

WORDS = "人山水火土金木日月星风云雨雪江河海湖花草树林鸟鱼马牛羊犬虎龙门窗桌灯书笔剑刀"


def line_truth(rows, least=5, share=0.04):
    chapters, seen = defaultdict(set), defaultdict(set)
    for source, job, n, content, _ in rows:
        if content is not None:
            chapters[source].add((job, n))
            for k in site_lines.line_keys(content):
                if k:
                    seen[source, k].add((job, n))
    ok = {x for x, c in seen.items() if len(c) >= least and len(c) >= share * len(chapters[x[0]])}
    return {(row, i) for source, _, _, content, row in rows if content is not None for i, k in enumerate(site_lines.line_keys(content), 1) if (source, k) in ok}


def test_site_lines_against_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        source = rnd.choice(["hot", "hot", "a", "b", None])
        lines = ["".join(rnd.choice(WORDS) for _ in range(9)) for _ in range(rnd.randint(0, 4))]
        lines += [x for x, p in (("本 站 %d 号" % i, 0.3), ("少见的行", 0.03), (f"{source}  结尾", 0.5), ("　", 0.3), ("", 0.2)) if rnd.random() < p]
        rnd.shuffle(lines)
        rows.append((source, f"j{i % 7}", rnd.choice([None, *range(60)]), rnd.choice([None, "\n".join(lines), "\r\n".join(lines)]) if i % 5 == 0 else "\n".join(lines), i))
    rows += [rows[3]] * 40  # one record over and over
    rows = [(*r[:4], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "source_id string, job_id string, n int, content string, rec bigint, row string").repartition(6)
    for counters in (2000, 3):  # too few counters are noticed and raised
        op = site_lines.SiteLines(df, "source_id", "job_id", "n", "content", "rec", counters=counters, block_lines=3)
        assert {(r.row, r.line_no) for r in op.marked().collect()} == line_truth(rows)
    kept = {r.row: r.content for r in op.removed().collect()}
    gone = line_truth(rows)
    assert all(kept[row] == (None if c is None else "\n".join(p for i, p in enumerate(c.split("\n"), 1) if (row, i) not in gone)) for _, _, _, c, row in rows)


def test_sets_of_many_sources_are_read_from_the_shared_folder(spark):
    rows = [(f"s{i % 40}" if i % 41 else None, f"line {i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "source string, line string, id int")
    few, many = site_lines.SetsBySource(df, 10_000), site_lines.SetsBySource(df, 50)
    assert few.buckets == 0 and many.buckets > 64
    for s in [None, "none", *(f"s{k}" for k in range(40))]:
        assert few.of(s) == many.of(s) == {k: n for x, k, n in rows if x == s}


def test_site_lines_empty(spark):
    op = site_lines.SiteLines(spark.createDataFrame([], "s string, j string, n int, c string, r bigint"), "s", "j", "n", "c", "r")
    assert op.marked().count() == 0 and op.removed().count() == 0


@given(st.lists(st.sampled_from("abcdefgh"), max_size=200), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_summary_bound(keys, counters):
    counts, lost = {}, 0
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
        if len(counts) > counters + 1:
            lost += site_lines.cut(counts, counters)
    lost += site_lines.cut(counts, counters)
    assert len(counts) <= counters and all(counts.get(k, 0) <= keys.count(k) <= counts.get(k, 0) + lost for k in set(keys))


def sentence(rnd, n=14):
    return "".join(rnd.choice(WORDS) for _ in range(n)) + "。"


def test_leakage(spark):
    rnd = random.Random(6)
    items = [(i, "".join(sentence(rnd) for _ in range(8))) for i in range(4)]
    english = " ".join(rnd.choice(["river", "stone", "lantern", "harbor", "quiet", "letter", "under", "before", "seven", "clerk"]) for _ in range(80))
    items += [(4, english), (5, None), (6, ""), (7, "短"), (3 + 100, items[3][1])]
    other = lambda n: "".join(sentence(rnd) for _ in range(n))
    t = items[0][1]
    changed = "".join(rnd.choice(WORDS) if k % 15 == 14 else c for k, c in enumerate(t))
    docs = [
        (1, other(5) + t + other(5)), (2, other(3) + changed), (3, other(3) + t[: len(t) // 3] + other(4)), (4, t[:70] + other(6) + t[70:]), (5, t[70:] + other(6) + t[:70][:20]), (6, other(20)), (7, None), (8, ""), (9, "x " + english.upper().replace(" ", ",  ") + "!"),
        (10, " ".join("word" if k % 12 == 11 else w for k, w in enumerate(english.split()))), (11, items[3][1]), (11, items[3][1]), (12, " ".join(english.split()[:25])), (13, other(2000) + items[1][1] + other(2000)),
    ]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(*x, "k") for x in items], "item_id bigint, text string, doc_id string")
    want = {(0, 1), (0, 2), (0, 4), (4, 9), (4, 10), (3, 11), (103, 11), (1, 13)}
    for block in (400_000, 1):
        got = leakage.leaked(d, "doc_id", "text", e, "item_id", "text", block_tokens=block).collect()
        found = {(r.item_id, r.doc_id) for r in got}
        assert found - {(0, 5)} == want and len([r for r in got if r.doc_id == 11]) == 4
    assert leakage.leaked(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leakage.leaked(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0


def test_short_items_are_found_whole(spark):
    d = spark.createDataFrame([(1, "a quiet, Lantern stone here"), (2, "quiet lantern"), (3, "他把灯笼放在桌上。"), (4, "灯笼"), (5, None)], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, "Quiet lantern stone"), (2, "灯笼放在"), (3, "!?"), (4, "one two three four")], "item_id bigint, text string")
    assert {(r.item_id, r.doc_id) for r in leakage.leaked(d, "doc_id", "text", e, "item_id", "text").collect()} == {(1, 1), (2, 3)}


def test_leakage_against_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(12, 60)))) for i in range(30)]
    docs = []
    for n in range(200):
        own, rate = items[n % 30][1].split(), rnd.choice([0.0, 0.05, 0.1, 0.15])
        own = [rnd.choice(words) if rnd.random() < rate else w for w in own]
        cut = rnd.randint(0, len(own))
        filling = lambda: [rnd.choice(words) for _ in range(rnd.randint(0, 80))]
        docs.append((n, " ".join([*filling(), *own[:cut], *filling(), *own[cut if rnd.random() < 0.7 else min(len(own), cut + 9) :], *filling()])))
    side = leakage.Tests([i for i, _ in items], [t for _, t in items])
    want = set()
    for n, text in docs:
        doc = leakage.tokens([text])[0]
        for k, (i, _) in enumerate(items):
            everywhere = [(a, b) for a in range(len(side.tok[k])) for b in (doc == side.tok[k][a]).nonzero()[0].tolist()]
            if everywhere and leakage.coverage(side.tok[k], doc, everywhere, False) >= 0.5:
                want.add((i, n))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert got <= want and len(want) > 100 and len(got) >= 0.97 * len(want)


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
@settings(max_examples=200, deadline=None)
def test_edits(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert entity_match.edits(a, b) == d[-1][-1] and d[-1][-1] >= max(len(a), len(b)) - entity_match.shared(a, b)


@pytest.mark.parametrize(
    "a, b, same",
    [("《灯笼与断剑》（完结）", "灯笼与断剑", True), ("[都市]灯笼与断剑最新章节", "灯笼与断剑", True), ("灯笼与断剑续篇", "灯笼与断剑", False), ("灯笼与断剑2", "灯笼与断剑", False), ("The Quiet Key by A. Moor", "the quiet key", True), ("The Quiet Key II", "The Quiet Key", False), ("The Quiet Key: The Return", "The Quiet Key", False)],
)
def test_titles(a, b, same):
    assert (entity_match.title_likeness(entity_match.clean_title(a)[0], entity_match.clean_title(b)[0]) > 0.8) is same


@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz"), st.floats(0.1, 1.0)), max_size=7))
@settings(max_examples=100, deadline=None)
def test_assignment_is_best(edges):
    def best(i, used):
        if i == len(edges):
            return 0.0
        a, b, c = edges[i]
        skip = best(i + 1, used)
        return skip if a in used or b in used else max(skip, c + best(i + 1, used | {a, b}))

    got = entity_match.best_assignment(edges)
    ends = [x for k in got for x in edges[k][:2]]
    assert len(ends) == len(set(ends)) and abs(sum(edges[k][2] for k in got) - best(0, frozenset())) < 1e-9


def test_matching(spark):
    rnd = random.Random(8)
    plans = [(i, f"s{i % 3}", f"{sentence(rnd, 7)[:-1]}", sentence(rnd, 4)[:-1], "".join(sentence(rnd) for _ in range(3)), f"https://s{i % 3}.example/b/{i}") for i in range(60)]
    hits, want, n = [], set(), 1000
    for i, source, name, author, intro, url in plans:
        for k, (s, t, a, u) in enumerate([(source, name + "（完结）", "作者：" + author, url.replace("https://", "http://m.") + "/?from=search"), ("far", "《" + name + "》", author + " 著", f"https://far.example/{i}"), ("far", name[:-1], author, f"https://www.far.example/{i}/")]):
            hits.append((n, s, t, a, intro[:25] if k else None, u))
            want.add((i, n))
            n += 1
    hits += [(n, "far", plans[0][2] + "续篇", plans[0][3], None, "https://far.example/seq"), (n + 1, "far", plans[1][2], "另一个人", sentence(rnd, 20), "https://far.example/other"), (n + 2, None, None, None, None, None), (n + 3, "x", "", "", "", "")]
    hits += [(n + 10 + k, "far", plans[2][2], plans[2][3], None, "https://far.example/2") for k in range(300)]  # a third of all rows
    want |= {(2, n + 10 + k) for k in range(300)}
    cols = "string, title string, author string, intro string, url string"
    h, p = spark.createDataFrame([(*x, "c") for x in hits], f"hit_id bigint, source {cols}, page string"), spark.createDataFrame([(*x, "c") for x in plans], f"plan_id bigint, source {cols}, key string")
    names = {"source": "source", "title": "title", "author": "author", "intro": "intro", "url": "url"}
    got = {(r.plan_id, r.hit_id) for r in entity_match.match(h, p, {"row": "hit_id"} | names, {"row": "plan_id"} | names).collect()}
    assert got == want
    assert entity_match.match(h.limit(0), p, {"row": "hit_id"} | names, {"row": "plan_id"} | names).count() == 0
    assert entity_match.match(h, p.limit(0), {"row": "hit_id"} | names, {"row": "plan_id"} | names).count() == 0


def plans_and_pages(spark, plans, pages):
    """plans: (row, title, author, intro); pages: (page, title, author, intro)."""
    p = spark.createDataFrame([(r, "x", f"?{r}", *rest) for r, *rest in plans], "row bigint, source string, page string, title string, author string, intro string")
    return p, spark.createDataFrame([(g, "x", i, t, a) for g, t, a, i in pages], "page string, source string, intro string, title string, author string")


def test_spellings_far_apart(spark):
    between = [(i, f"子{c}{d}丑", "沈青禾", "") for i, (c, d) in enumerate((c, d) for c in "乙丙丁戊己" for d in WORDS[:12])]
    plans, pages = plans_and_pages(spark, [(900, "甲乙丙丁戊己庚辛", "沈青禾", ""), *between], [("p", "子乙丙丁戊己庚丑", "沈青禾", "")])
    assert [r.plan for r in entity_match.neighbours(plans, pages).collect()] == [900]


def test_large_components_are_solved_exactly(spark):
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(3, 7)
        edges = [(f"a{a}", f"b{b}", rnd.choice([0.62, 0.7, 0.9, rnd.uniform(0.6, 1.0)])) for a in range(n) for b in range(n) if rnd.random() < 0.8]
        edges += edges[:3]
        best = {frozenset(): 0.0}  # by right ends used
        for a in range(n):
            new = dict(best)
            for used, total in best.items():
                for x, b, c in edges:
                    if x == f"a{a}" and b not in used and total + c > new.get(used | {b}, -1.0):
                        new[used | {b}] = total + c
            best = new
        got = entity_match.best_assignment(edges)
        ends = [x for k in got for x in edges[k][:2]]
        assert len(ends) == len(set(ends)) and abs(sum(edges[k][2] for k in got) - max(best.values())) < 1e-9
    greedy = [(f"a{i}", f"b{i + k}", 0.81 if k else 0.8) for i in range(20) for k in (0, 1) if i + k < 20]
    assert len(entity_match.best_assignment(greedy)) == 20


def test_long_chains_are_one_component(spark):
    n = 60
    edges = [(i, f"p{i + k:02}", "s", 0.81 if k else 0.8) for i in range(n) for k in (0, 1) if i + k < n]
    got = entity_match.assigned(spark.createDataFrame(edges, "plan bigint, page string, source string, confidence double")).collect()
    assert len({r.plan for r in got}) == len({r.page for r in got}) == len(got) == n


def test_intros_are_compared_to_their_end():
    rnd = random.Random(5)
    start, one, other = ("".join(sentence(rnd) for _ in range(n)) for n in (5, 12, 12))
    assert entity_match.intro_likeness(start + one, start + other) < 0.5
    assert entity_match.intro_likeness(start + one, (start + one)[:100]) == 1.0
    assert entity_match.intro_likeness(start + one, start + one[:40] + "水" + one[41:]) > 0.9


def test_equal_keys_in_several_blocks(spark):
    plans, pages = plans_and_pages(spark, [(i, "灯笼与断剑", "沈青禾", "") for i in range(40)], [("p", "灯笼与断剑", "沈青禾", ""), ("q", "灯笼与断桥", "沈青禾", "")])
    got = entity_match.neighbours(plans, pages, window=1, block=4).collect()
    assert sorted(r.plan for r in got if r.page == "p") == list(range(40)) and len([r for r in got if r.page == "q"]) >= 1


def test_copies_without_end_stay_linear(spark):
    plans, pages = plans_and_pages(spark, [(i, "灯笼与断剑", "沈青禾", "") for i in range(3000)], [(f"p{k}", "灯笼与断剑", "沈青禾", "") for k in range(500)])
    pairs = entity_match.neighbours(plans, pages, window=6, block=256)
    assert pairs.count() <= 500 * (entity_match.COPIES + 12) * 14  # cells that share the copies take their part each
    assert entity_match.assigned(pairs.limit(2000)).count() > 10


@given(st.text("abcdé灯笼断剑\U0001f600", max_size=12), st.text("abcdé灯笼断剑\U0001f600", max_size=12))
@settings(max_examples=200, deadline=None)
def test_classes_of_characters_never_hide_what_titles_share(a, b):
    held, size = entity_match.letters([a, b])
    assert size.tolist() == [len(a), len(b)] and min(len(a), len(b)) >= int(__import__("numpy").minimum(held[0], held[1]).sum()) >= entity_match.shared(a, b)


@pytest.mark.parametrize("a, b, same", [("https://www.h.example/book?id=7&from=search#info", "http://m.h.example/book/?id=7", True), ("https://h.example/book?id=7", "https://h.example/book?id=8", False), ("https://h.example/b/?ref=x", "https://h.example/b", True), ("https://h.example/b?a=1&b=2", "https://h.example/b?b=2&a=1", True)])
def test_addresses(a, b, same):
    assert (entity_match.address(a) == entity_match.address(b)) is same


def test_queries(spark, data):
    from folioscale.llm.queries import QUERIES

    columns = {"p1_found": {"plan_id", "hit_id"}, "p2_found": {"tab", "row_id", "line_no"}, "p3_found": {"rec_id", "line_no"}, "p4_found": {"rec_id"}, "p5_found": {"rec_id"}, "p7_found": {"hit_id", "field"}, "p8_ids": {"doc_id", "ids"}, "p9_found": {"item_id", "doc_id"}, "p10_found": {"doc_id"}}
    for name, f in QUERIES.items():
        df = f(spark, data)
        assert df.count() > 0 and (name not in columns or set(df.columns) == columns[name]), name
