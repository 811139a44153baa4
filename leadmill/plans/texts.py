"""Scalar functions and profiles, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadmill.functions import html
from leadmill.functions import text as T
from leadmill.operators import criteria as C
from leadmill.sources import adapters as A

#: The sites of the driver's pages: own suffixes, so that each host is a site.
SUFFIXES = ("example.com", "example.net", "example.org")
SKIP = ("therin.example.net", "thther.example.org")


def site(domain):
    """Registrable domain of the driver's pages."""
    return T.registrable_domain_listed(domain, SUFFIXES)


def url_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "pages").withColumn("domain", T.extract_domain(F.col("url"))).withColumn("host", T.extract_host(F.col("url")))
    return p.select(
        "page_id", "domain", "host", T.registrable_domain(F.col("domain")).alias("registrable"), site(F.col("host")).alias("site"),
        T.classify_site(F.col("domain"), SKIP, ("ththth.example.net",), site).alias("kind"), T.is_skippable(F.col("host"), (), SKIP, SUFFIXES).alias("skippable"),
        T.name_from_domain(F.col("domain")).alias("plain_name"), T.name_from_domain(F.col("domain"), site).alias("name"),
    )


_SITE = "array_to_string(list_slice(string_split(regexp_replace(host, '^www\\.', ''), '.'), -3, -1), '.')"
URL_SQL = f"""WITH {A.WEB}, h AS (SELECT pos AS page_id, host AS domain, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, {_SITE} AS site FROM web)
SELECT page_id, domain, host, array_to_string(list_slice(string_split(domain, '.'), -2, -1), '.') AS registrable, site,
  CASE WHEN domain = 'ththth.example.net' OR domain LIKE '%.ththth.example.net' THEN 'directory' WHEN site IN {SKIP} THEN 'non_company' ELSE 'company' END AS kind,
  site IN {SKIP} AS skippable, 'Example' AS plain_name, upper(substr(site, 1, 1)) || replace(substr(split_part(site, '.', 1), 2), '-', ' ') AS name FROM h"""


def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from titles that hold a company's name, a trade or a slogan."""
    c = A.companies(spark, sf_dir)
    k = F.col("pos")
    title = (
        F.when(k % 6 == 0, F.concat("name", F.lit(" Inc. | Home")))
        .when(k % 6 == 1, F.concat(F.lit("星河"), F.col("pos").cast("string"), F.lit("科技有限公司常见问题 - 站点")))
        .when(k % 6 == 2, F.lit("云杉网络_首页"))
        .when(k % 6 == 3, F.lit("一个好用, 不折腾的平台"))
        .when(k % 6 == 4, F.concat(F.substring_index("domain", ".", 1), F.lit(" — about us")))
        .otherwise(F.lit("Shop all the great tools online"))
    )
    return c.select("external_id", T.name_from_title(title, F.col("domain")).alias("from_title"))


TITLE_SQL = f"""WITH {A.COMPANIES}
SELECT external_id, CASE pos % 6 WHEN 0 THEN name || ' Inc.' WHEN 1 THEN '星河' || pos || '科技有限公司' WHEN 2 THEN '云杉网络' WHEN 4 THEN split_part(domain, '.', 1) ELSE '' END AS from_title FROM companies"""


def size_and_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.companies(spark, sf_dir).withColumn("r", T.employee_range(F.col("employees")))
    return c.select("external_id", F.col("r.low").alias("low"), F.col("r.high").alias("high"), T.range_covers(F.col("r"), F.lit(40), F.lit(110)).alias("covers"), T.normalize_funding(F.col("funding_stage")).alias("stage"), T.dedupe_key(F.col("domain"), F.col("name")).alias("dedupe_key"), T.row_key(F.col("domain"), F.col("name")).alias("row_key"))


SIZE_SQL = f"""WITH {A.COMPANIES}
SELECT external_id, low, high, coalesce(least(high, 110) > greatest(low, 40) AND least(high, 110) - greatest(low, 40) >= 0.5 * (high - low), false) AS covers, stage, dedupe_key, CASE WHEN domain = '' THEN name ELSE domain END AS row_key FROM companies"""


def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.people(spark, sf_dir)
    hints = F.array(F.lit("x"), F.lit("Kehang Chen"), F.lit("berg"), F.lit("陈可"))
    m = T.match_name(T.name_forms(T.all_names(F.col("name"), F.col("name_local"), F.col("aliases"))), hints)
    return p.select("external_id", m["level"].alias("level"), m["hint"].alias("hint"), T.normalize_name(F.col("name")).alias("norm"))


NAME_SQL = f"""WITH {A.PEOPLE}
SELECT external_id, CASE WHEN first = 'Chen' AND last = 'Kehang' THEN 'full' WHEN last = 'Berg' OR name_local = '陈可航' THEN 'partial' ELSE 'none' END AS level,
  CASE WHEN first = 'Chen' AND last = 'Kehang' THEN 'Kehang Chen' WHEN last = 'Berg' THEN 'berg' WHEN name_local = '陈可航' THEN '陈可' ELSE '' END AS hint, lower(first || last) AS norm FROM people"""


def conversation_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report titles, section counts, truth values and contact items over conversation texts."""
    t = A.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    question = F.concat(F.lit("帮我查一下"), "text", F.lit("有限公司这家公司"))
    report = F.concat(F.lit("# a\n## b\n"), "text", F.lit("\n## c"))
    contact = F.concat(F.lit("客服：a"), F.col("turn").cast("string"), F.lit("@x.org；电话 12"))
    items = T.contact_items(contact)
    return t.select("conv_id", "turn", T.report_title(question).alias("title"), T.report_sections(report).alias("sections"), T.as_bool(F.when(F.col("turn") % 2 == 0, " Yes ").otherwise("no")).alias("truth"), F.get(items, F.lit(0))["label"].alias("label"), F.get(items, F.lit(0))["email"].alias("email"), F.size(items).alias("items"))


CONVERSATION_SQL = r"""SELECT conv_id, turn, substr(ltrim(coalesce(text, ''), '，。？！?! '), 1, 20) AS title,
  (2 + len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: starts_with(l, '## '))))::INT AS sections, turn % 2 = 0 AS truth, '客服' AS label, 'a' || turn || '@x.org' AS email, 2 AS items FROM conversations"""


def seeds_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable seeds and request keys of conversation texts."""
    t = A.table(spark, sf_dir, "conversations")
    key = C.request_key(F.lit("v1"), F.lit("m"), F.coalesce("text", F.lit("")), F.array("role"))
    return t.groupBy(key.alias("request_key")).agg(F.count("*").alias("requests"), F.min(T.stable_seed(F.coalesce("text", F.lit("")))).alias("seed"))


#: CRC-32 of a text in SQL: the table by its rule, then the bytes one by one.
CRC = """RECURSIVE crc_steps(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of a text; the table crc_table must be joined."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, o: xor(c >> 8, crcs[(xor(c, o) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests: a role has many askers of one key; what orders' priorities say is known, all else is answered once."""
    t = A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "5-LOW").when(F.col("turn") % 3 == 1, F.concat("role", F.lit("?"))).otherwise(F.coalesce("text", F.lit(""))).alias("key"))
    known = A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.concat(F.lit("known "), "o_orderpriority").alias("answer"))
    told, _ = C.answered_once(t, known, lambda new: new.select("key", F.concat(F.lit("made "), F.length("key").cast("string")).alias("answer")))
    return told.select("conv_id", "turn", "answer")


ANSWERED_SQL = """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '5-LOW' WHEN turn % 3 = 1 THEN role || '?' ELSE coalesce(text, '') END AS key FROM conversations)
SELECT conv_id, turn, CASE WHEN key IN (SELECT o_orderpriority FROM orders) THEN 'known ' || key ELSE 'made ' || length(key) END AS answer FROM t"""

KEYS_SQL = f"""WITH {CRC}, t AS (SELECT role, coalesce(text, '') AS text FROM conversations), k AS (SELECT *, sha256('v1' || chr(31) || 'm' || chr(31) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(31) || role) AS request_key FROM t)
SELECT request_key, count(*) AS requests, min({crc_sql("text")} % 100000)::BIGINT AS seed FROM k, crc_table GROUP BY request_key"""


def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text, title, links and icons of pages, each page read once, and their decoded bytes."""
    p = A.table(spark, sf_dir, "pages").select("page_id", html.page(F.col("html"), F.col("url")).alias("p"), F.length(html.decode_bytes(F.encode("html", "utf-8"), F.lit(""))).alias("decoded_chars"))
    return p.select(
        "page_id", F.length("p.text").alias("text_chars"), F.sha2(F.col("p.text").cast("binary"), 256).alias("text_sha256"), F.col("p.title").alias("title"), F.size("p.links").alias("n_links"),
        F.get("p.links", F.lit(0)).alias("first_link"), F.element_at("p.icons", -1).alias("last_icon"), "decoded_chars",
    )


_BREAKS = "p|div|br|li|tr|td|th|section|article|h1|h2|h3|h4|h5|h6|blockquote|pre|hr"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
MARKUP_SQL = rf"""WITH s AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<head>.*?</head>', '', 'g'), '(?s)<script.*?</script>', '', 'g') AS body FROM pages),
t AS (SELECT *, regexp_replace(regexp_replace(body, '(?i)</?(?:{_BREAKS})(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>|<[^>]*$', '', 'g') AS bare FROM s),
x AS (SELECT *, array_to_string(list_filter(list_transform(string_split({_PLAIN.format("bare")}, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> ''), chr(10)) AS said, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS root FROM t),
l AS (SELECT *, list_distinct(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: h[1] = '/')) AS links FROM x)
SELECT page_id, length(said)::INT AS text_chars, sha256(said) AS text_sha256, {_PLAIN.format("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")} AS title, len(links)::INT AS n_links,
  root || regexp_extract(html, '<a href="([^"]*)"', 1) AS first_link, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) || 'favicon.ico' AS last_icon, length(html)::INT AS decoded_chars FROM l"""


# Profiles

VOCABULARY = C.Vocabulary(
    cities=("NATION_21", "NATION_17", "NATION_8", "NATION_3"),
    regions=(("ASIA", ("NATION_2", "NATION_7", "NATION_12", "NATION_17", "NATION_22")), ("EUROPE", ("NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23"))),
    families=(("making", ("machinery", "automobile")), ("homes", ("building", "furniture", "household"))),
    signals=("urgent", "hiring", "urgent hiring"),
    intent=("Find", "companies", "in"),
    roles=(("销售", ("销售", "sales")), ("市场", ("市场", "marketing", "cmo")), ("技术", ("技术", "研发", "engineering", "cto")), ("采购", ("采购", "procurement")), ("财务", ("财务", "finance", "cfo"))),
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written profile per customer."""
    c = A.companies(spark, sf_dir)
    k = F.col("pos")
    text = F.concat(
        F.lit("Find "), F.get(F.when(F.size("industries") > 0, F.col("industries")).otherwise(F.array(F.lit("any"))), F.lit(0)), F.lit(" companies in "), F.replace("location", F.lit(", "), F.lit(" of ")),
        F.when(k % 3 == 0, "，50 人以上").when(k % 3 == 1, "，小微").otherwise(""), F.when(k % 4 == 0, "；A 轮").otherwise(""), F.when(k % 5 == 0, "。urgent hiring").when(k % 5 == 1, "。hiring").otherwise(""),
        F.when(k % 6 == 0, "，cold chain logistics").otherwise(""),
    )
    return c.select(F.col("external_id").alias("list_id"), text.alias("text"), "pos", "industries", "n_name", "r_name", "location")


def profile_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, v, t = profiles(spark, sf_dir), VOCABULARY, F.col("text")
    return p.select(
        "list_id", C.detect_place(t, v)["place"].alias("place"), F.size(C.detect_place(t, v)["cities"]).alias("cities"), F.array_join(F.transform(C.match_families(t, v.families), lambda f: f["name"]), "/").alias("families"),
        C.detect_size(t, v)["label"].alias("size"), C.detect_funding(t, v)["stage"].alias("stage"), F.array_join(C.detect_signals(t, v.signals), "/").alias("signals"),
    )


_PLACE = "CASE WHEN c.location = '' THEN NULL WHEN n_name IN ('NATION_21', 'NATION_17', 'NATION_8', 'NATION_3') THEN n_name WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name END"
_FAMILY = "CASE WHEN industry IN ('machinery', 'automobile') THEN 'making' WHEN industry IN ('building', 'furniture', 'household') THEN 'homes' ELSE '' END"
DETECTION_SQL = f"""WITH {A.COMPANIES}
SELECT external_id AS list_id, {_PLACE} AS place, CASE WHEN {_PLACE} IS NULL THEN NULL WHEN {_PLACE} IN ('ASIA', 'EUROPE') THEN 5 ELSE 1 END AS cities, {_FAMILY} AS families,
  CASE pos % 3 WHEN 0 THEN '50 人以上' WHEN 1 THEN '50 人以下' END AS size, CASE WHEN pos % 4 = 0 THEN 'A轮' END AS stage, CASE pos % 5 WHEN 0 THEN 'urgent hiring' WHEN 1 THEN 'hiring' ELSE '' END AS signals
FROM companies c"""


def profile_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria of every profile as numbered conditions with their weights."""
    p = profiles(spark, sf_dir).withColumn("criteria", C.with_reachability(C.company_criteria(F.col("text"), VOCABULARY)))
    told = C.criteria_conditions(p)
    more = p.select("list_id", F.posexplode("criteria").alias("pos", "c")).select("list_id", "pos", F.col("c.category").alias("category"), F.col("c.weight").alias("weight"), F.col("c.expected").alias("expected"), F.size("c.tokens").alias("tokens"), F.col("c.lenient").alias("lenient"))
    return told.join(more, ["list_id", "pos"])


CRITERIA_ROWS = f"""{A.COMPANIES}, d AS (SELECT external_id, pos AS k, {_PLACE} AS place, {_FAMILY} AS family FROM companies c), x AS (
  SELECT external_id AS list_id, 1 AS o, '地域：' || place AS text, 'geo' AS category, 5 AS weight, place AS expected, CASE WHEN place IN ('ASIA', 'EUROPE') THEN 5 ELSE 1 END AS tokens, false AS lenient,
    CASE place WHEN 'ASIA' THEN 'NATION_2/NATION_7/NATION_12/NATION_17/NATION_22' WHEN 'EUROPE' THEN 'NATION_3/NATION_8/NATION_13/NATION_18/NATION_23' ELSE place END AS words FROM d WHERE place IS NOT NULL
  UNION ALL SELECT external_id, 2, '行业：' || family, 'industry', 5, family, CASE family WHEN 'making' THEN 2 ELSE 3 END, false, CASE family WHEN 'making' THEN 'machinery/automobile' ELSE 'building/furniture/household' END FROM d WHERE family <> ''
  UNION ALL SELECT external_id, 3, CASE k % 3 WHEN 0 THEN '规模：50 人以上' ELSE '规模：50 人以下' END, 'size', 3, CASE k % 3 WHEN 0 THEN '50:1000000' ELSE '1:50' END, 0, false, '' FROM d WHERE k % 3 < 2
  UNION ALL SELECT external_id, 4, '融资阶段：A轮', 'funding', 3, 'A轮', 1, false, 'A轮' FROM d WHERE k % 4 = 0
  UNION ALL SELECT external_id, 5, CASE k % 5 WHEN 0 THEN '意向信号：urgent hiring' ELSE '意向信号：hiring' END, 'signal', 2, '', 1, true, CASE k % 5 WHEN 0 THEN 'urgent hiring' ELSE 'hiring' END FROM d WHERE k % 5 < 2
  UNION ALL SELECT external_id, 7, '业务特征：cold chain logistics', 'business', 3, '', 1, true, 'cold chain logistics' FROM d WHERE k % 6 = 0
  UNION ALL SELECT c.external_id, 6, '业务特征：' || CASE WHEN length(t) <= 22 THEN t ELSE substr(t, 1, 22) || '…' END, 'business', 3, '', 1, true, t
    FROM (SELECT c.external_id, 'Find ' || CASE WHEN industry = '' THEN 'any' ELSE industry END || ' companies in ' || replace(c.location, ', ', ' of ') AS seg, d.place, d.family, industry FROM companies c JOIN d USING (external_id)) c,
    LATERAL (SELECT regexp_replace(c.seg, '\\s+$', '') AS t), LATERAL (SELECT trim(replace(replace(replace(replace(CASE WHEN c.family <> '' THEN replace(CASE WHEN c.place IS NULL THEN t ELSE replace(t, c.place, '') END, c.industry, '') ELSE CASE WHEN c.place IS NULL THEN t ELSE replace(t, c.place, '') END END, 'companies', ''), 'Find', ''), 'in', ''), '', ''), ' ') AS rest) WHERE length(rest) >= 4
  UNION ALL SELECT external_id, 8, '可触达性', 'reachability', 1, '', 0, false, '' FROM d)"""
CRITERIA_SQL = f"""WITH {CRITERIA_ROWS}
SELECT list_id, (row_number() OVER (PARTITION BY list_id ORDER BY o) - 1)::INT AS pos, text, ((row_number() OVER (PARTITION BY list_id ORDER BY o) - 1) % 4)::INT AS color, category, weight, expected, tokens, lenient FROM x"""


def profile_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir).withColumn("h", C.criteria_hints(C.company_criteria(F.col("text"), VOCABULARY)))
    return p.select("list_id", F.col("h.city").alias("city"), F.array_join("h.industry_hints", "/").alias("industry_hints"))


HINTS_SQL = f"""WITH {A.COMPANIES} SELECT external_id AS list_id, {_PLACE} AS city, CASE {_FAMILY} WHEN 'making' THEN 'machinery/automobile' WHEN 'homes' THEN 'building/furniture/household' ELSE '' END AS industry_hints FROM companies c"""


def person_profile_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of people's profiles, with names found in them and conditions folded in."""
    p = A.people(spark, sf_dir)
    text = F.concat(F.lit("联系人："), F.col("name"), F.lit("，sales or marketing director，"), F.col("n_name"), F.lit("，正在招聘，speaks three languages"))
    found = p.select(F.col("external_id").alias("list_id"), text.alias("text"), C.detect_person_names(text).alias("names"))
    made = C.with_reachability(C.merge_conditions(C.person_criteria(F.col("text"), F.col("names"), VOCABULARY), F.array(F.lit("履历背景：likes long walks"), F.lit("可触达性")), True, v=VOCABULARY), True)
    return found.select("list_id", F.posexplode(made).alias("pos", "c")).select("list_id", "pos", F.col("c.name").alias("text"), F.col("c.category").alias("category"), F.col("c.weight").alias("weight"), F.array_join("c.tokens", "/").alias("tokens"))


def merged_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company profiles with conditions written by hand."""
    p = profiles(spark, sf_dir)
    own = F.array(F.concat(F.lit("地域："), F.col("n_name")), F.lit("业务特征：业务特征：cold storage"), F.lit("furniture"), F.lit("可触达性"), F.lit("cold storage"))
    made = C.merge_conditions(C.company_criteria(F.col("text"), VOCABULARY), own, v=VOCABULARY)
    return p.select("list_id", F.posexplode(made).alias("pos", "c")).select("list_id", "pos", F.col("c.name").alias("text"), F.col("c.category").alias("category"), F.array_join("c.tokens", "/").alias("tokens"))


PERSON_SQL = f"""WITH {A.PEOPLE}, p AS (SELECT *, first || ' ' || last AS full_name, n_name IN ('NATION_21', 'NATION_17', 'NATION_8', 'NATION_3') AS city FROM people), x AS (
  SELECT external_id AS list_id, 1 AS o, '姓名：' || full_name AS text, 'name' AS category, 5 AS weight, full_name AS tokens FROM p
  UNION ALL SELECT external_id, 2, '职位：销售／市场／技术（任一）', 'title', 4, '销售/sales/市场/marketing/cmo/技术/研发/engineering/cto' FROM p
  UNION ALL SELECT external_id, 3, '职级：管理层及以上', 'seniority', 3, 'director' FROM p
  UNION ALL SELECT external_id, 4, '地域：' || n_name, 'geo', 3, n_name FROM p WHERE city
  UNION ALL SELECT external_id, 5, '意向信号：正在招聘', 'signal', 2, '正在招聘' FROM p
  UNION ALL SELECT external_id, 6, '履历背景：' || n_name, 'background', 3, n_name FROM p WHERE NOT city
  UNION ALL SELECT external_id, 7, '履历背景：speaks three languages', 'background', 3, 'speaks three languages' FROM p
  UNION ALL SELECT external_id, 8, '履历背景：likes long walks', 'background', 3, 'likes long walks' FROM p
  UNION ALL SELECT external_id, 9, '可触达性', 'reachability', 1, '' FROM p)
SELECT list_id, (row_number() OVER (PARTITION BY list_id ORDER BY o) - 1)::INT AS pos, text, category, weight, tokens FROM x"""
MERGED_SQL = f"""WITH {CRITERIA_ROWS}, f AS (SELECT d.external_id AS list_id, place, family, n_name, n_name IN ('NATION_21', 'NATION_17', 'NATION_8', 'NATION_3') AS city,
    EXISTS (FROM x WHERE x.list_id = d.external_id AND x.category = 'business' AND contains(x.text, 'furniture')) AS named FROM d JOIN companies USING (external_id)),
y AS (SELECT x.list_id, o, CASE WHEN category = 'industry' AND family = 'making' AND NOT named THEN '行业：making／homes（任一）' ELSE text END AS text, category, CASE WHEN category = 'industry' AND family = 'making' AND NOT named THEN words || '/building/furniture/household' ELSE words END AS tokens
    FROM x JOIN f USING (list_id) WHERE category <> 'reachability'
  UNION ALL SELECT list_id, 11, CASE WHEN city THEN '地域：' ELSE '业务特征：' END || n_name, CASE WHEN city THEN 'geo' ELSE 'business' END, n_name FROM f WHERE place IS DISTINCT FROM n_name
  UNION ALL SELECT list_id, 12, '业务特征：cold storage', 'business', 'cold storage' FROM f
  UNION ALL SELECT list_id, 13, '行业：homes', 'industry', 'building/furniture/household' FROM f WHERE family = '' AND NOT named)
SELECT list_id, (row_number() OVER (PARTITION BY list_id ORDER BY o) - 1)::INT AS pos, text, category, tokens FROM y"""


def raw_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the output of a generator: a list per order, good and bad entries mixed."""
    x = A.table(spark, sf_dir, "lineitem")
    n, k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")), F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("geo", "industry", "size", "funding", "business", "reachability"))), (k % 6).cast("int") + 1)
    expected = F.when(k % 6 == 2, F.concat((k % 90).cast("string"), F.lit(":"), (k % 70 + 20).cast("string"))).when(k % 6 == 3, F.when(k % 4 == 1, "A轮").otherwise("Z轮")).otherwise("x")
    tokens = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a "), F.lit("a"), F.lit("")))
    return x.select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("list_id"), n.alias("pos"), kind.alias("category"), F.concat(F.lit(" n"), F.col("l_linenumber").cast("string")).alias("name"), F.when(k % 8 == 0, " q ").otherwise("").alias("question"), expected.alias("expected"), F.when(k % 9 == 0, " why ").otherwise("").alias("note"), (k % 7).cast("string").alias("weight"), tokens.alias("tokens"))


def validated_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_criteria(raw_criteria(spark, sf_dir)).withColumn("tokens", F.array_join("tokens", "/")).drop("lenient")


VALIDATED_SQL = f"""WITH {CRC}, u AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS pos FROM lineitem),
r AS (SELECT 'l' || l_orderkey AS list_id, pos, list_extract(['geo', 'industry', 'size', 'funding', 'business', 'reachability'], (k % 6)::INT + 1) AS category, 'n' || l_linenumber AS name, (k % 7)::INT AS weight, k FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY list_id, category ORDER BY pos) AS nth FROM r WHERE category <> 'reachability' AND weight BETWEEN 1 AND 5
  AND CASE category WHEN 'size' THEN k % 90 <= k % 70 + 20 WHEN 'funding' THEN k % 4 = 1 ELSE k % 5 <> 0 END),
f AS (SELECT *, count(*) OVER (PARTITION BY list_id) AS n FROM g WHERE nth <= CASE category WHEN 'business' THEN 3 ELSE 1 END),
e AS (SELECT *, CASE category WHEN 'size' THEN (k % 90) || ':' || (k % 70 + 20) WHEN 'funding' THEN 'A轮' ELSE 'x' END AS expected FROM f WHERE n >= 2),
ids AS (SELECT name, expected, {crc_sql("name || '|' || expected")} % 1000000 AS crc FROM (SELECT DISTINCT name, expected FROM e), crc_table)
SELECT list_id, pos, 'criterion-' || category || '-' || crc AS id, CASE WHEN k % 8 = 0 THEN 'q' ELSE '公开资料是否体现了「' || name || '」？' END AS question, CASE WHEN k % 9 = 0 THEN 'why' ELSE '由 LLM 依据画像推导。' END AS rationale, category, name, weight, CASE WHEN category = 'size' THEN '' WHEN k % 5 = 0 THEN 'A轮' ELSE 'a' END AS tokens, expected FROM e JOIN ids USING (name, expected)"""

def raw_person_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``raw_criteria``, of people."""
    k = F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("name", "title", "company", "seniority", "background", "reachability"))), (k % 6).cast("int") + 1)
    expected = F.when(k % 6 == 3, F.when(k % 4 == 1, "管理层").otherwise("Z")).when(k % 6 == 4, F.when(k % 11 < 6, "").otherwise("x")).otherwise("x")
    tokens = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a "), F.lit("a"), F.lit("")))
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    x = A.table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("list_id"), n.alias("pos"), kind.alias("category"), F.concat(F.lit(" n"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("").alias("question"), expected.alias("expected"), F.lit("").alias("note"), (k % 7).cast("string").alias("weight"), tokens.alias("tokens"))


def validated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.validate_criteria(raw_person_criteria(spark, sf_dir), True).select("list_id", "pos", "id", "category", "name", "weight", F.array_join("tokens", "/").alias("tokens"), "expected")


VALIDATED_PEOPLE_SQL = f"""WITH {CRC}, u AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS pos FROM lineitem),
r AS (SELECT 'l' || l_orderkey AS list_id, pos, list_extract(['name', 'title', 'company', 'seniority', 'background', 'reachability'], (k % 6)::INT + 1) AS category, 'n' || l_linenumber AS name, (k % 7)::INT AS weight, k FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY list_id, category ORDER BY pos) AS nth FROM r WHERE category <> 'reachability' AND weight BETWEEN 1 AND 5
  AND CASE category WHEN 'seniority' THEN k % 4 = 1 WHEN 'background' THEN k % 11 < 6 AND k % 5 <> 0 ELSE k % 5 <> 0 END),
f AS (SELECT *, count(*) OVER (PARTITION BY list_id) AS n FROM g WHERE nth <= CASE category WHEN 'background' THEN 2 ELSE 1 END),
e AS (SELECT *, CASE category WHEN 'seniority' THEN '管理层' WHEN 'background' THEN '' ELSE 'x' END AS expected FROM f WHERE n >= 2),
ids AS (SELECT name, expected, {crc_sql("name || '|' || expected")} % 1000000 AS crc FROM (SELECT DISTINCT name, expected FROM e), crc_table)
SELECT list_id, pos, 'criterion-' || category || '-' || crc AS id, category, name, weight, CASE WHEN k % 5 = 0 THEN '' ELSE 'a' END AS tokens, expected FROM e JOIN ids USING (name, expected)"""


def person_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for people's profiles: names, roles, the whole families of the words for companies, the city."""
    p = A.people(spark, sf_dir)
    text = F.concat(F.lit("联系人："), F.col("name"), F.lit("，sales director，"), F.col("n_name"), F.lit("，furniture"))
    made = p.select(F.col("external_id").alias("list_id"), text.alias("text"), C.detect_person_names(text).alias("names")).withColumn("h", C.criteria_hints(C.person_criteria(F.col("text"), F.col("names"), VOCABULARY), True, VOCABULARY))
    return made.select("list_id", "h.city", *[F.array_join(f"h.{n}", "/").alias(n) for n in ("name_hints", "role_hints", "company_hints")])


PERSON_HINTS_SQL = f"""WITH {A.PEOPLE} SELECT external_id AS list_id, CASE WHEN n_name IN ('NATION_21', 'NATION_17', 'NATION_8', 'NATION_3') THEN n_name END AS city,
  first || ' ' || last AS name_hints, '销售/sales/技术/研发/engineering/cto' AS role_hints, 'furniture/building/household' AS company_hints FROM people"""


def vocabulary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that share a word of eight letters and more with a document; any place in a text counts."""
    said = A.table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("token"))
    words = said.groupBy("conv_id").agg(F.collect_set("token").alias("tokens")).select(F.col("conv_id").alias("pos"), F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("family"), "tokens")
    found = C.match_vocabulary(A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("list_id"), "text"), words)
    return found.select("list_id", F.size("families").alias("n_families"), F.array_join("families", "/").alias("families"))


VOCABULARY_SQL = """WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[a-z]{8,}')) AS token FROM conversations),
h AS (SELECT doc_id, token FROM documents JOIN (SELECT DISTINCT token FROM t) ON contains(text, token)),
p AS (SELECT DISTINCT doc_id, conv_id FROM h JOIN t USING (token))
SELECT doc_id AS list_id, count(*)::INT AS n_families, string_agg('v' || conv_id, '/' ORDER BY conv_id) AS families FROM p GROUP BY doc_id"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry fields of web results: capital, head and founding date, each in some of them."""
    k = F.col("rank")
    text = F.concat(
        F.col("content"), F.when(k % 2 == 0, F.concat(F.lit(" 注册资本：1,"), k.cast("string"), F.lit(".5万元 "))).otherwise(""), F.when(k % 3 == 0, "法定代表人为李雷·王；").otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("成立日期："), (k % 40 + 1980).cast("string"), F.lit("年5月6日"))).when(k % 5 == 1, F.concat(F.lit("成立于 "), (k % 40 + 1980).cast("string"), F.lit("-05-06"))).otherwise(""),
    )
    return A.web_results(spark, sf_dir).select("rank", T.registry_fields(text).alias("f")).select("rank", *[F.coalesce(F.col("f")[n], F.lit("")).alias(n) for n in ("registered_capital", "legal_rep", "founded")])


REGISTRY_SQL = f"""WITH {A.WEB} SELECT rank, CASE WHEN rank % 2 = 0 THEN '1,' || rank || '.5万元' ELSE '' END AS registered_capital, CASE WHEN rank % 3 = 0 THEN '李雷·王' ELSE '' END AS legal_rep,
  CASE rank % 5 WHEN 0 THEN (rank % 40 + 1980) || '年5月6日' WHEN 1 THEN (rank % 40 + 1980) || '-05-06' ELSE '' END AS founded FROM web"""

QUERIES = {
    "t_url_scalars": url_scalars, "t_title_names": title_names, "t_size_and_funding": size_and_funding, "t_name_matching": name_matching, "t_conversation_scalars": conversation_scalars, "t_request_keys": seeds_and_keys, "c_answered_once": answered_requests,
    "t_page_markup": page_markup, "c_profile_detection": profile_detection, "c_profile_criteria": profile_criteria, "c_profile_hints": profile_hints, "c_person_criteria": person_profile_criteria, "c_merged_conditions": merged_conditions,
    "c_validated_criteria": validated_criteria, "c_validated_people": validated_people, "c_person_hints": person_hints, "c_vocabulary_matches": vocabulary_matches, "t_registry_fields": registry,
}
ORACLE = {
    "t_url_scalars": URL_SQL, "t_title_names": TITLE_SQL, "t_size_and_funding": SIZE_SQL, "t_name_matching": NAME_SQL, "t_conversation_scalars": CONVERSATION_SQL,
    "t_request_keys": KEYS_SQL, "c_answered_once": ANSWERED_SQL, "t_page_markup": MARKUP_SQL, "c_person_criteria": PERSON_SQL, "c_merged_conditions": MERGED_SQL, "c_profile_detection": DETECTION_SQL, "c_profile_criteria": CRITERIA_SQL, "c_profile_hints": HINTS_SQL, "c_validated_criteria": VALIDATED_SQL,
    "c_validated_people": VALIDATED_PEOPLE_SQL, "c_person_hints": PERSON_HINTS_SQL, "c_vocabulary_matches": VOCABULARY_SQL, "t_registry_fields": REGISTRY_SQL,
}
