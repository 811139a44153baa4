"""Scalar functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from leadmill.functions import html
from leadmill.functions import text as T


def values(spark, made, rows, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(made).collect()]


class _Late:
    """Columns a and b; they need a running session."""

    def __getattr__(self, name):
        return F.col(name)


COL = _Late()


def one(spark, made, *texts):
    return values(spark, made, [(t, "") for t in texts])


def test_domains(spark):
    assert one(spark, T.extract_domain(COL.a), "https://WWW.Foo.com:80/x?y", "foo.com/x", "http://localhost/", "http://u:p@a.b/", "") == ["foo.com:80", "", "", "u:p@a.b", ""]
    assert one(spark, T.extract_host(COL.a), "https://u:p@A.b.com:8080/x", "a.com/path", " x ", "a.b?c") == ["a.b.com", "a.com", "x", "a.b"]
    assert one(spark, T.registrable_domain(COL.a), "ent.online.360.cn", "finance.sina.com.cn", "a.b", "x", "", "a.co.uk") == ["360.cn", "sina.com.cn", "a.b", "x", "", "a.co.uk"]
    assert one(spark, T.registrable_domain_listed(COL.a), "https://www.a.example.com.cn:80/x", "WWW.x.y.com", "com.cn") == ["example.com.cn", "y.com", "com.cn"]
    assert one(spark, T.is_skippable(COL.a, ("own.org",)), "en.wikipedia.org", "good.com", "a.own.org", "") == [True, False, True, True]


def test_site_classes(spark):
    kind = T.classify_site(COL.a, ("baidu.com",), ("qcc.baidu.com",))
    assert one(spark, kind, "qcc.baidu.com", "a.qcc.baidu.com", "notqcc.baidu.com", "x.com", "") == ["directory", "directory", "non_company", "company", "company"]


def test_title_names(spark):
    rows = [
        ("江南青石安全科技有限公司常见问题与解答 - 官网", "x.com"), ("云杉网络 | 首页", "yunshan.net"), ("Idc4", "idc4.com"), ("News", "news.mydrivers.com"), ("一个好用, 不折腾", "a.com"), ("Acme Cloud Inc. | Home", ""),
        ("Cloud", "abc.com"), ("", "a.com"), ("a b c d", "abcd.com"), ("明月安全科技(上海)有限公司", ""), ("x" * 41, ""),
    ]
    assert values(spark, T.name_from_title(COL.a, COL.b), rows) == ["江南青石安全科技有限公司", "云杉网络", "Idc4", "", "", "Acme Cloud Inc.", "", "", "", "明月安全科技(上海)有限公司", ""]
    assert one(spark, T.name_from_domain(COL.a), "m.tensor-SECURITY.cn", "") == ["Tensor security", ""]


def test_a_company_before_the_first_separator_is_the_name(spark):
    rows = [
        ("星河7科技有限公司 - Atonea, | reeast", ""), ("Acme Cloud Inc. — a b c d | Home", ""), ("星河7科技有限公司_Foo Co | x", ""), ("公司·a, | b", ""), (" 明月集团 ｜ 新闻！ - x", ""),
        ("星河 - 青石有限公司 | 首页", ""), ("Atonea, - 星河7科技有限公司 | x", ""), ("云杉 - 网络 | 首页", ""), ("a, - b | c", ""),
    ]
    assert values(spark, T.name_from_title(COL.a, COL.b), rows) == ["星河7科技有限公司", "Acme Cloud Inc.", "星河7科技有限公司", "公司", "明月集团", "星河 - 青石有限公司", "", "云杉 - 网络", ""]


def test_names(spark):
    def level(names, hints):
        df = spark.createDataFrame([(names, hints)], "n array<string>, h array<string>")
        return df.select(T.match_name(T.name_forms(F.col("n")), F.col("h")).alias("m")).first().m

    assert level(["Jo-Han R.A. Lindt"], ["johan"]).level == "full"
    assert level(["Johan Lindt"], ["Lindt Johan"]).level == "full"
    assert level(["jonathan moor"], ["than"]).level == "none"
    assert level(["陈可航"], ["陈可"]).level == "partial" and level(["陈可航"], ["陈"]).level == "none"
    assert tuple(level(["Ann Lee", "陈可航"], ["lee", "陈 可航"])) == ("full", "陈 可航")
    assert level([""], ["ann"]).level == "none"


def test_sizes(spark):
    r = T.employee_range(COL.a)
    assert [tuple(x) if x else None for x in one(spark, r, "10-20 人", "500 人以上", "120", "无", "", "20~10", "50–200")] == [(10, 20), (500, 10**6), (120, 120), None, None, (10, 20), (50, 200)]
    covers = T.range_covers(r, F.lit(1), F.lit(50))
    assert one(spark, covers, "50-200 人", "10-60", "20", "20-30") == [False, True, False, True]
    assert one(spark, T.normalize_funding(COL.a), "A 轮", "") == ["a轮", ""]


def test_other_scalars(spark):
    got = one(spark, T.registry_fields(COL.a), "注册资本为 500万元，法定代表人：李雷，成立于2001年2月3日", "none")
    assert got == [{"registered_capital": "500万元", "legal_rep": "李雷", "founded": "2001年2月3日"}, {}]
    assert one(spark, T.report_title(COL.a), "帮我查一下甲乙科技股份有限公司这家公司以及最近的状况。", "对甲进行背调") == ["甲乙科技", "甲"]
    assert one(spark, T.report_sections(COL.a), "## a\n# b\r\n## c\n ## d", "") == [2, 0]
    assert one(spark, T.as_bool(COL.a), " TRUE ", "false", "1", None) == [True, False, True, False]
    assert one(spark, T.strip(COL.a), "　 a b \n") == ["a b"]
    assert one(spark, T.stable_seed(COL.a), "abc") == [891568578 % 100000]
    assert values(spark, T.dedupe_key(COL.a, COL.b), [(" A.com ", "x"), (" ", " Foo ")]) == ["a.com", "foo"]
    assert values(spark, T.row_key(COL.a, COL.b), [(" A.com ", "x"), ("", " Foo ")]) == ["A.com", "Foo"]
    items = one(spark, T.contact_items(COL.a), "客服：a@b.com；电话 123; ")[0]
    assert [tuple(x) for x in items] == [("客服", "a@b.com"), ("电话 123", "")]


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><link rel="icon" href="/i.png"><link rel="apple-touch-icon" href="apple-touch.png"><meta property="og:image" content="/og.jpg"></head>
<body><h1>Hello</h1><p>one <b>two</b><script>var x = "</p>";</script></p><a href="/a#f">a</a><a href="/a">again</a><a href="#x">x</a><a href="mailto:q@q">m</a><a href="https://o.org/b">b</a></body></html>"""


def test_markup(spark):
    df = spark.createDataFrame([(PAGE, "https://h.com/d/"), (None, None), ("<p>broken <", "https://h.com/")], "h string, u string")
    rows = df.select(html.html_to_text(F.col("h")).alias("t"), html.html_links(F.col("h"), F.col("u")).alias("l"), html.html_icons(F.col("h"), F.col("u")).alias("i")).collect()
    assert rows[0].t.split("\n") == ["Hello", "one two", "aagainxmb"]
    assert rows[0].l == ["https://h.com/a", "https://o.org/b"]
    assert rows[0].i == ["https://h.com/d/apple-touch.png", "https://h.com/i.png", "https://h.com/og.jpg", "https://h.com/d/favicon.ico"]
    assert rows[1].t == "" and rows[1].l == []


def test_bytes(spark):
    df = spark.createDataFrame([(0, "中文".encode("gb18030"), ""), (1, "é".encode("latin-1"), "latin-1"), (2, "é".encode(), "no-such"), (3, b"\xff\xff", "")], "i int, b binary, c string")
    assert [r[0] for r in df.orderBy("i").select(html.decode_bytes(F.col("b"), F.col("c"))).collect()] == ["中文", "é", "é", "��"]


@pytest.mark.parametrize("left,right,want", [(["a"], ["b"], False), ([""], ["x"], False)])
def test_blank_tokens_never_hit(spark, left, right, want):
    df = spark.createDataFrame([(left, "zzz")], "t array<string>, s string")
    assert df.select(T.any_in(F.col("s"), F.col("t"))).first()[0] is want
