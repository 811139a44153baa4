"""Judging, criteria, recall, enrichment, lists and streams on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadmill import vocab
from leadmill.operators import criteria as C
from leadmill.operators import enrich as E
from leadmill.operators import judge as J
from leadmill.operators import listing as L
from leadmill.operators import recall as R
from leadmill.operators import reports
from leadmill.schemas import COMPANY, CRITERION, KINDS, PERSON
from leadmill.sources import io
from leadmill.streaming import jobs

YES, UNSURE, NO = vocab.YES, vocab.UNSURE, vocab.NO
BLANK = {"string": "", "int": 0}


def records(spark, kind, *rows):
    schema = {"company": COMPANY, "person": PERSON}[kind]
    empty = io.no_nulls(spark.createDataFrame([], schema))
    out = []
    for r in rows:
        out.append(tuple(r.get(f.name, {"string": "", "int": 0}.get(f.dataType.simpleString(), {} if f.dataType.typeName() == "map" else [])) for f in empty.schema.fields))
    return spark.createDataFrame(out, schema)


def crit(category, tokens=(), expected="", weight=None, lenient=False, name=None):
    return (category, name or category, "", category, weight if weight is not None else {**vocab.PERSON_WEIGHTS, **vocab.COMPANY_WEIGHTS}[category], list(tokens), expected, "", lenient)


def verdicts(spark, kind, record, *criteria):
    df = records(spark, kind, record)
    with_criteria = df.join(spark.createDataFrame([(list(criteria),)], f"criteria array<{CRITERION}>"))
    r = J.judge(with_criteria, kind == "person").first()
    return [v.verdict for v in r.verdicts], r


@pytest.mark.parametrize(
    "record,criterion,want",
    [
        ({"location": "杭州"}, crit("geo", ["杭州"], "杭州"), YES), ({"location": "北京"}, crit("geo", ["杭州"]), NO), ({}, crit("geo", ["杭州"]), UNSURE), ({"location": "x"}, crit("geo"), UNSURE),
        ({"industries": ["食品"]}, crit("industry", ["食品"]), YES), ({"industries": ["钢铁"], "summary": "做食品"}, crit("industry", ["食品"]), UNSURE), ({"industries": ["钢铁"]}, crit("industry", ["食品"]), NO), ({}, crit("industry", ["食品"]), UNSURE),
        ({"employees": "10-20"}, crit("size", expected="1:50"), YES), ({"employees": "20"}, crit("size", expected="1:50"), NO), ({"employees": "?"}, crit("size", expected="1:50"), UNSURE), ({"employees": "10-20"}, crit("size", expected="x"), UNSURE),
        ({"funding_stage": "A 轮"}, crit("funding", expected="a轮"), YES), ({"funding_stage": "B轮"}, crit("funding", expected="A轮"), NO), ({}, crit("funding", expected="A轮"), UNSURE),
        ({"summary": "私域"}, crit("business", ["私域"]), YES), ({"summary": "x"}, crit("business", ["私域"], lenient=True), UNSURE), ({"summary": "x"}, crit("business", ["私域"]), NO), ({"summary": "x"}, crit("business", [""]), NO),
        ({"contact_count": 1}, crit("reachability"), YES), ({}, crit("reachability"), UNSURE),
    ],
)
def test_company_rules(spark, record, criterion, want):
    assert verdicts(spark, "company", record, criterion)[0] == [want]


@pytest.mark.parametrize(
    "record,criterion,want",
    [
        ({"name": "Johan Lindt"}, crit("name", ["Lindt Johan"]), YES), ({"name": "Johan Lindt"}, crit("name", ["lindt"]), UNSURE), ({"name": "Bo"}, crit("name", ["lindt"]), NO),
        ({"title": "VP of SALES"}, crit("title", ["sales"]), YES), ({"title": "Clerk", "summary": "sales"}, crit("title", ["sales"]), UNSURE), ({"title": "Clerk", "summary": "SALES"}, crit("title", ["sales"]), NO), ({}, crit("title", ["sales"]), UNSURE),
        ({"company": "软件公司"}, crit("company", ["软件"]), YES), ({"company": "零售"}, crit("company", ["软件"]), NO), ({"company": "某公司"}, crit("company", ["软件"]), UNSURE), ({}, crit("company", ["软件"]), UNSURE),
        ({"title": "director"}, crit("seniority", expected="决策层"), YES),  # the word holds "cto"
        ({"title": "主管"}, crit("seniority", expected="决策层"), UNSURE), ({"title": "manager"}, crit("seniority", expected="决策层"), NO), ({"title": "Clerk"}, crit("seniority", expected="决策层"), UNSURE), ({"title": "实习生"}, crit("seniority", expected="?"), YES),
        ({"summary": "演讲"}, crit("background", ["演讲"], lenient=True), YES), ({}, crit("background", ["演讲"], lenient=True), UNSURE), ({"contact_phone": "1"}, crit("reachability"), YES), ({}, crit("reachability"), UNSURE),
    ],
)
def test_person_rules(spark, record, criterion, want):
    assert verdicts(spark, "person", record, criterion)[0] == [want]


def test_scores(spark):
    at = lambda *cs, **r: verdicts(spark, "company", r, *cs)[1]
    full = at(crit("geo", ["a"], weight=3), crit("business", ["b"], weight=1, lenient=True), location="a", summary="x")
    assert (full.ratio, full.score, full.match_level) == (0.875, 88, vocab.FULL)
    edge = at(crit("geo", ["a"], weight=2), crit("industry", ["b"], weight=2), location="a")
    assert (edge.ratio, edge.match_level) == (0.75, vocab.FULL)
    miss = at(crit("geo", ["a"], weight=9), crit("funding", expected="A轮", weight=3), location="a", funding_stage="B轮")
    assert (miss.score, miss.match_level, miss.hard_miss) == (75, vocab.PARTIAL, True) and "「funding」不符合" in miss.match_reason
    low = at(crit("geo", ["a"], weight=5), crit("size", expected="1:2", weight=3), location="b", employees="")
    assert low.match_level == vocab.UNCONFIRMED and low.match_reason.startswith("仅 0/2")
    half = at(crit("geo", ["a"], weight=5), crit("industry", ["x"], weight=3, name="行业"), location="a", industries=["y"])
    assert half.score == 62  # 62.5 goes to even
    none = at(location="a")
    assert (none.score, none.match_level) == (0, vocab.UNCONFIRMED) and "没有可用" in none.match_reason


def test_sources(spark):
    page = lambda u: ("t", u, "")
    df = records(spark, "person", {"evidence": [page("p/1"), page("p/team"), page("p/posts/1"), page("p/team")]}, {"evidence": [page("p/1")]}, {})
    got = [[r[0] for r in df.select(J.person_sources(F.col("evidence"), F.lit(k))).collect()] for k in ("reachability", "signal", "name")]
    assert got == [[["p/team", "p/posts/1"], ["p/1"], []], [["p/posts/1", "p/1", "p/team"], ["p/1"], []], [["p/1", "p/team", "p/posts/1"], ["p/1"], []]]


# Criteria


def names_of(spark, text, people=False, conditions=None):
    df = spark.createDataFrame([(text, conditions or [])], "t string, c array<string>").withColumn("n", C.detect_person_names(F.col("t")))
    made = C.person_criteria(F.col("t"), F.col("n")) if people else C.company_criteria(F.col("t"))
    if conditions is not None:
        made = C.merge_conditions(made, F.col("c"), people)
    return [c.name for c in df.select(C.with_reachability(made, people).alias("m")).first().m]


def test_company_profile(spark):
    assert names_of(spark, "寻找杭州的零售与软件行业小微商家，未融资，最好有微信小程序，擅长冷链配送") == ["地域：杭州", "行业：零售／软件（任一）", "规模：50 人以下", "融资阶段：未融资", "意向信号：微信小程序", "业务特征：擅长冷链配送", "可触达性"]
    assert names_of(spark, "长三角的企业")[:1] == ["地域：长三角"]
    assert names_of(spark, "  ") == ["可触达性"]


def test_person_profile(spark):
    assert names_of(spark, "找人：陈可航，软件公司的 CMO 或市场总监，正在招聘", True) == ["姓名：陈可航", "职位：市场", "职级：管理层及以上", "公司特征：软件", "意向信号：正在招聘", "可触达性"]


def test_conditions(spark):
    got = names_of(spark, "杭州的零售", conditions=["地域：杭州", "可触达性", " ", "业务特征：业务特征：订阅制", "动态：订阅制", "上海", "软件", "行业：必须有认证"])
    assert got == ["地域：杭州", "行业：零售／软件（任一）", "业务特征：订阅制", "地域：上海", "业务特征：必须有认证", "可触达性"]


@pytest.mark.parametrize("text,want", [("找陈可航", ["陈可航"]), ("帮我找一下华为公司", []), ("姓名：Chen Kehang", ["Chen Kehang"]), ("「李雷」老师", ["李雷"]), ("找北京", []), (None, []), ("王小明医生，人选是 李娜。", ["王小明", "李娜"]), ("请联系陈可航律师或‘赵云飞’", ["赵云飞"]), ("本人是周杰，名叫周杰伦", ["周杰伦"]), ("目标：Sales VP", []), ("人选是：Ann Lee Smith Jones", ["Ann Lee Smith"]), ("找武汉", []), ("找：王强", ["王强"]), ("帮我查 李娜", ["李娜"])])
def test_person_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(C.detect_person_names(F.col("t"))).first()[0] == want


def test_validation(spark):
    rows = [
        ("l", 0, "geo", " n ", "", "x", "", "5", ["a", " a", ""]), ("l", 1, "geo", "n2", "", "x", "", "5", ["a"]), ("l", 2, "size", "s", "", "10:5", "", "3", []), ("l", 3, "size", "s", "", "1:5", "", "3.7", ["zz"]),
        ("l", 4, "funding", "f", "", "A轮", "", "true", []), ("l", 5, "funding", "f", "", "A轮", "", "3", []), ("l", 6, "business", "b", "", "", "", "9", ["q"]), ("m", 0, "geo", "n", "", "", "", "5", ["a"]),
    ]
    raw = spark.createDataFrame(rows, "list_id string, pos int, category string, name string, question string, expected string, note string, weight string, tokens array<string>")
    got = [(r.list_id, r.pos, r.weight, r.tokens) for r in C.validate_criteria(raw).orderBy("list_id", "pos").collect()]
    assert got == [("l", 0, 5, ["a"]), ("l", 3, 3, []), ("l", 5, 3, ["A轮"])]


def test_vocabulary_join_has_two_ways(spark):
    profiles = spark.createDataFrame([("a", "food and steel"), ("b", "none")], "list_id string, text string")
    words = vocab.table(spark, (("x", ("steel",)), ("y", ("food", "zz"))))
    assert [C.match_vocabulary(profiles, words, most).collect()[0].families for most in (10, 0)] == [["x", "y"]] * 2


def test_vocabulary_join_has_two_ways_for_one_character(spark):
    profiles = spark.createDataFrame([("a", "做茶的工厂"), ("b", "酒"), ("c", "none"), ("d", ""), ("e", None)], "list_id string, text string")
    words = vocab.table(spark, (("tea", ("茶", "")), ("wine", ("酒", "白酒")), ("plant", ("工厂",)), ("x", ("x",))))
    for most in (10, 0):
        assert sorted((r.list_id, r.families) for r in C.match_vocabulary(profiles, words, most).collect()) == [("a", ["tea", "plant"]), ("b", ["wine"])]


# Recall and enrichment


def test_merge_is_sequential(spark):
    cols = "query_id string, pos int, name string, domain string"
    first = spark.createDataFrame([("q", 0, "A", "a.com")], cols)
    extra = spark.createDataFrame([("q", 0, "a", "b.com"), ("q", 1, "C", "b.com"), ("q", 2, "D", "w.b.com"), ("q", 3, "", "e.com"), ("q", 4, "", "f.com")], cols)
    got = [(r.name, r.domain) for r in R.merge_recalls(first, extra).orderBy("place").collect()]
    assert got == [("A", "a.com"), ("C", "b.com"), ("", "e.com"), ("", "f.com")]  # the dropped b.com blocks nothing


@pytest.mark.parametrize("parts", [1, 8])
def test_keep_first_is_stable(spark, parts):
    df = spark.createDataFrame([(i % 3, i, i * 7 % 10) for i in range(60)], "k int, v int, r int").repartition(parts)
    assert [(r.k, r.v) for r in R.keep_first(df, ["k"], "r", "v").orderBy("k").collect()] == [(0, 0), (1, 10), (2, 20)]


def test_failed_sources(spark):
    calls = spark.createDataFrame([("q", "a", 1, False, 5, 1.0, 0), ("r", "a", 1, True, 5, 1.0, 1), ("r", "b", 2, True, 5, 1.0, 1)], "query_id string, source_id string, priority int, ok boolean, latency_ms int, cost double, target int")
    items = spark.createDataFrame([("r", "a", 0, "k"), ("r", "a", 1, "k2"), ("r", "b", 0, "k3")], "query_id string, source_id string, pos int, key string")
    kept, told = R.waterfall_collect(items, calls)
    assert [(r.key, r.place) for r in kept.collect()] == [("k", 1)]
    assert {r.query_id: (r.failed, r.truncated, r.source_id) for r in told.collect()} == {"q": (True, False, ""), "r": (False, True, "a")}


def test_contacts_need_a_domain(spark):
    ask = lambda d: spark.createDataFrame([("r", d, 5, [])], "request_id string, domain string, limit int, positions array<string>")
    contacts = spark.createDataFrame([("a.com", 0, "CEO")], "domain string, pos int, title string")
    assert R.contacts_by_domain(ask(" A.com"), contacts).count() == 1
    with pytest.raises(Exception, match="verified domain"):
        R.contacts_by_domain(ask(" "), contacts).collect()


def test_subpages(spark):
    links = ["https://x.com/", "https://a.com/about-us?x=1", "https://a.com/", "https://a.com/f.PDF", "https://b.a.com/zz", "https://a.com/products", "https://a.com/y/z"]
    df = spark.createDataFrame([(1, "https://www.a.com", u) for u in links], "page_id int, home string, link string")
    assert [r.link for r in R.pick_subpages(df, 3).orderBy("place").collect()] == ["https://a.com/about-us", "https://a.com/products", "https://a.com/y/z"]


def test_entity_pages_two_ways(spark):
    e = spark.createDataFrame([(1, "acme", "u", "r"), (2, "zz", "u", "r"), (3, "", "", ""), (4, "ac", "", "")], "entity_id int, name string, evidence_url string, reason string")
    p = spark.createDataFrame([(i, f"u{i}", "acme inc", "x" * 300) for i in range(6)], "pos int, url string, title string, content string")
    for few, most in ((100, 100), (0, 100), (0, 0)):
        got = {r.entity_id: [x.url for x in r.evidence] for r in R.entity_pages(e, p, few=few, most=most).collect()}
        assert got == {1: ["u0", "u1", "u2", "u3"], 2: ["u"], 3: [], 4: ["u0", "u1", "u2", "u3"]}


def test_many_entities_of_one_name(spark):
    """10,001 entities share a name that every page has; nothing meets pairwise."""
    e = spark.range(10_001).selectExpr("cast(id as int) as entity_id", "'acme' as name", "'' as evidence_url", "'' as reason")
    p = spark.range(3000).selectExpr("cast(id as int) as pos", "concat('u', id) as url", "'acme inc' as title", "'x' as content")
    out = R.entity_pages(e, p)
    assert out.count() == 10_001 and {tuple(x.url for x in r.evidence) for r in out.collect()} == {("u0", "u1", "u2", "u3")}
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("few,most", [(100, 100), (0, 100), (0, 0)])
def test_containing_in_three_ways(spark, few, most):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abc云") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(99, "")]
    words = ["", "a", "云", "ab", "abc", "c云a", "abca", "zzz", "bcabc", "abc"]
    got = R.containing(spark.createDataFrame(texts, "pos int, said string"), spark.createDataFrame([(w,) for w in words], "word string"), few, most)
    assert sorted((r.pos, r.word) for r in got.collect()) == sorted((i, w) for i, t in texts for w in set(words) if w and w in t)


def turned(items, seed):
    return items[seed % len(items) :] + items[: seed % len(items)] if items else []


@pytest.mark.parametrize(("by_city", "most"), [(True, 1_000_000), (False, 5)])
def test_ranked_companies_equal_brute_force(spark, by_city, most):
    rng = random.Random(6)
    corpus = [(i * 3, rng.choice(["杭州", "上海", ""]), [rng.choice(["食品", "软件", "钢铁"])]) for i in range(90)]
    queries = [(f"q{i}", rng.choice(["杭州", "上海", "", None, "无"]), rng.choice([["食品"], ["软件", "食品"], ["无"], []]), rng.randint(0, 500), rng.choice([1, 5, 200])) for i in range(20)]
    frame = spark.createDataFrame(corpus, "pos int, location string, industries array<string>")
    frame = frame.withColumn("city", F.col("location")) if by_city else frame
    out = R.rank_companies(spark.createDataFrame(queries, "query_id string, city string, hints array<string>, seed int, limit int"), frame, most)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.place, r.pos, r.hit))
    for q, city, hints, seed, limit in queries:
        own = [c for c in corpus if not city or (city == c[1] if by_city else city in c[1])]
        hits, rest = [c for c in own if set(hints) & set(c[2])], [c for c in own if not set(hints) & set(c[2])]
        offset = seed % (len(hits) or max(len(own), 1))
        want = [(p, True) for p, *_ in turned(hits, offset)] + [(p, False) for p, *_ in turned(rest, offset)]
        assert sorted(got.get(q, [])) == [(i + 1, p, h) for i, (p, h) in enumerate(want[:limit])], (q, city, hints, seed, limit)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_ranked_people_equal_brute_force(spark, most):
    rng = random.Random(9)
    rows = [{"name": rng.choice(["Ann Lee", "Bo Chen", "Cy Novak"]), "title": rng.choice(["Sales", "Clerk", ""]), "company": rng.choice(["soft", "steel", ""]), "location": rng.choice(["Rome", "Oslo", ""])} for _ in range(70)]
    people = records(spark, "person", *({**r, "external_id": str(i)} for i, r in enumerate(rows))).withColumn("pos", F.col("external_id").cast("int"))
    queries = [(f"q{i}", rng.choice([["Lee Ann"], ["novak"], []]), rng.choice([["Sales"], []]), rng.choice([["soft"], ["zz"], []]), rng.choice(["Rome", "", None]), rng.randint(0, 99), rng.choice([3, 30, 500])) for i in range(16)]
    out = R.rank_people(spark.createDataFrame(queries, "query_id string, name_hints array<string>, role_hints array<string>, company_hints array<string>, city string, seed int, limit int"), people, most)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r.place, r.pos, r.relevance))
    for q, names, roles, firms, city, seed, limit in queries:
        def score(r):
            level = 4 if "Lee Ann" in names and r["name"] == "Ann Lee" else 2 if "novak" in names and "Novak" in r["name"] else 0
            return level + 2 * any(x in r["title"] for x in roles) + 2 * any(x in r["company"] for x in firms) + bool(city and city in r["location"])

        scored = [(i, score(r)) for i, r in enumerate(rows)]
        hits, rest = sorted((x for x in scored if x[1]), key=lambda x: (-x[1], x[0])), [x for x in scored if not x[1]]
        want = (hits + turned(rest, seed))[:limit]
        assert sorted(got.get(q, [])) == [(i + 1, *x) for i, x in enumerate(want)], q


def test_master_keeps_ties(spark):
    """However sightings of one time are split, merged masters equal one master."""
    at = dt.datetime(2024, 1, 1)
    rows = [("k", n, "", s, at) for n in "abc" for s in "yxz"]
    schema = "dedupe_key string, name string, domain string, source_id string, seen_at timestamp"
    whole = E.company_master(spark.createDataFrame(rows, schema)).collect()
    for cut in (1, 4, 8):
        parts = [E.company_master(spark.createDataFrame(x, schema)) for x in (rows[:cut], rows[cut:])]
        assert E.merge_master(*parts).collect() == whole == E.merge_master(*parts[::-1]).collect()


def test_latest_has_no_ties(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", "s", at, "b", {"x": "1"}), ("k", "s", at, "a", {"x": "2"}), ("k", "s", at, None, None)], "dedupe_key string, source_id string, fetched_at timestamp, record string, more map<string, string>")
    assert {E.latest_enrichment(df.repartition(n)).first().record for n in (1, 2, 3)} == {"a"}


def test_rows_of_people(spark):
    rows = spark.createDataFrame([("l", "1", "ready", 1, "ready", "CEO"), ("l", "2", "ready", 0, "ready", "")], "list_id string, row_id string, contact_state string, contact_count int, summary_state string, title string")
    assert [(r.contact_state, r.profile_state) for r in L.row_research_state(rows, True).orderBy("row_id").collect()] == [("ready", "ready"), ("failed", "blocked")]
    df = spark.createDataFrame([([], "A", "", "x"), ([], "B", "u", ""), ([("t", "w", "")], "C", "u", "x")], "e array<struct<title: string, url: string, snippet: string>>, n string, a string, s string")
    assert [[tuple(x) for x in r[0]] for r in df.select(J.row_references(F.col("e"), F.col("n"), F.col("a"), F.col("s"))).collect()] == [[], [("B · 公开档案", "u")], [("t", "w")]]


def test_enrichment_fills_blanks_only(spark):
    page = lambda u: ("t", u, "")
    base = records(spark, "company", {"name": "A", "domain": "A.com", "location": "X", "missing_fields": ["summary", "contacts"], "evidence": [page("1")], "attributes": {"k": "old", "z": "z"}}, {"name": "", "domain": ""})
    new = records(spark, "company", {"name": "B", "domain": "a.com", "location": "Y", "summary": "s", "industries": ["i"], "evidence": [page("1"), page("2")], "attributes": {"k": "new"}, "source_id": "v"}, {"name": " ", "domain": " ", "summary": "bad"})
    a, b = E.merge_enrichment(base, new).orderBy(F.col("name").desc()).collect()
    assert (a.name, a.domain, a.location, a.summary, a.industries, a.missing_fields) == ("A", "A.com", "X", "s", ["i"], ["contacts"])
    assert a.attributes == {"k": "new", "z": "z", "enriched_by": "v"} and [e.url for e in a.evidence] == ["1", "2"] and b.summary == ""


def test_cache(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    cache = spark.createDataFrame([("a", "v", at(1), at(9)), ("b", "", at(2), at(9)), ("c", "v", at(3), at(4))], "cache_key string, value string, created_at timestamp, expires_at timestamp")
    now = F.lit("2024-01-05").cast("timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cache_key string")
    assert {r.cache_key: r.state for r in E.cache_lookup(asked, cache, now).collect()} == {"a": "hit", "b": "known_empty", "c": "miss", "d": "miss"}
    left = lambda **kw: {r.cache_key for r in E.cache_prune(cache, now, **kw).collect()}
    assert left(most=4, drop=1) == {"a", "b", "c"} and left(most=3, drop=1) == {"a", "b"} and left(most=2, drop=1) == {"b"}


# Lists, reports, files, streams


def test_progress_invariants(spark):
    rows = spark.createDataFrame([("l", i, [vocab.FULL, vocab.PARTIAL, vocab.UNCONFIRMED][i % 3], 2) for i in range(10)], "list_id string, pos int, match_level string, contact_count int")
    for verified in (0, 4, 10):
        r = reports.list_progress(rows, spark.createDataFrame([("l", verified, True)], "list_id string, verified int, completed boolean")).first()
        assert r.full <= r.qualified <= r.verified <= r.goal == 10 and r.contacts == 2 * verified
        assert r.stop_reason == ("已达到目标数量" if verified == 10 else "候选已耗尽")


def test_levels_without_rows(spark):
    none = spark.createDataFrame([], "level string")
    assert [(r.n, r.analyzed_percent) for r in reports.opportunity_levels(none, ("a", "b"), "b").collect()] == [(0, 100), (0, 100)]


def test_sorting(spark):
    rows = spark.createDataFrame([("l", 0, vocab.PARTIAL, 60, "b"), ("l", 1, vocab.FULL, 80, "c"), ("l", 2, vocab.PARTIAL, 60, "a"), ("l", 3, vocab.PARTIAL, 70, "d")], "list_id string, pos int, match_level string, score int, name string")
    assert [r.pos for r in L.sort_rows(rows).orderBy("place").collect()] == [1, 3, 0, 2]
    assert [r.pos for r in L.sort_rows(rows, "name").orderBy("place").collect()] == [2, 0, 1, 3]


def test_files(spark, tmp_path):
    up = tmp_path / "u.csv"
    up.write_text('﻿公司名称,x\n"A, Inc",1\n\n  \n A ,2\n"A, Inc",3\n', encoding="utf-8")
    assert [r.name for r in io.import_names(spark, str(up)).collect()] == ["A, Inc", "A", "A, Inc"]
    rows = spark.createDataFrame([("l1", 1), ("l2", 2)], "list_id string, v int")
    path = str(tmp_path / "lists")
    io.write_list(rows, path)
    io.write_list(spark.createDataFrame([("l1", 9)], "list_id string, v int"), path)
    assert sorted((r.list_id, r.v) for r in spark.read.parquet(path).collect()) == [("l1", 9), ("l2", 2)]
    spark.createDataFrame([("A", None)], "name string, domain string").write.json(str(tmp_path / "j"))
    r = io.read_records(spark, str(tmp_path / "j"), "company", "json").first()
    assert (r.name, r.domain, r.industries, r.attributes) == ("A", "", [], {}) and set(KINDS) >= {"company", "person"}


def test_broken_lists(spark):
    lists = spark.createDataFrame([("a", "running", "{}"), ("b", "completed", "{}"), ("c", "completed", "oops")], "list_id string, status string, payload string")
    rows = spark.createDataFrame([("a", "1", '{"name": "x"}', "{}", "{}"), ("a", "2", "oops", "{}", "{}"), ("b", "3", '{"name": "y"}', "bad", "{}"), ("c", "4", '{"name": "z"}', "{}", "{}")], "list_id string, row_id string, row_json string, record_json string, judgment_json string")
    good, fine = io.load_lists(lists, rows, "name string")
    assert [(r.list_id, r.status) for r in good.collect()] == [("a", "completed")] and [(r.row_id, r.name) for r in fine.collect()] == [("1", "x")]


def test_stream_master_equals_batch(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    src, path = str(tmp_path / "in"), str(tmp_path / "master")
    rows = [[("k", "n1", "", "s", at(2)), ("k", "n0", "", "t", at(1))], [("k", "n2", "", "u", at(3)), ("m", "m", "", "u", at(3))]]
    schema = "dedupe_key string, name string, domain string, source_id string, seen_at timestamp"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    jobs.stream_company_master(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = jobs.read_master(spark, path).orderBy("dedupe_key").collect()
    want = E.company_master(spark.createDataFrame(rows[0] + rows[1], schema)).orderBy("dedupe_key").collect()
    assert [r.asDict() for r in last] == [r.asDict() for r in want]
