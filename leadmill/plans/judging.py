"""Judging, scoring, ranking, paging: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill import vocab
from leadmill.operators import criteria as C
from leadmill.operators import judge as J
from leadmill.operators import listing as L
from leadmill.schemas import EVIDENCE
from leadmill.sources import adapters as A


def company_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per nation with its criteria: 25 rows."""
    tokens = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    made = F.array(
        C.criterion("geo", F.concat(F.lit("地域："), F.col("n_name")), "", "geo", 5, tokens(F.col("n_name")), F.col("n_name"), ""),
        C.criterion("ind", "行业：homes", "", "industry", 5, tokens("building", "furniture"), "homes", ""),
        C.criterion("size", "规模：50+", "", "size", 3, tokens().cast("array<string>"), "50:130", ""),
        C.criterion("fund", "融资阶段：A轮", "", "funding", 3, tokens("A轮"), "A轮", ""),
        C.criterion("sig", "意向信号：urgent", "", "signal", 2, tokens("urgent"), "", "", True),
    )
    return A.places(spark, sf_dir).select(F.col("n_name").alias("list_id"), F.col("r_name").alias("region"), C.with_reachability(made).alias("criteria"), F.col("nationkey").alias("seed"))


def judged_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's list judges the companies of its region; criteria arrive by a broadcast, judging shuffles nothing."""
    c = A.companies(spark, sf_dir)
    rows = c.join(F.broadcast(company_lists(spark, sf_dir)), F.col("r_name") == F.col("region"))
    return J.judge(rows)


def ranked_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_companies(spark, sf_dir).select("list_id", "pos", "external_id", "score", "match_level", "hard_miss", "match_reason", F.col("external_id").alias("row_key"), "name")
    return L.sort_rows(judged).where("place <= 20").select("list_id", "place", "external_id", "score", "match_level", "hard_miss", "match_reason")


JUDGED = f"""{A.COMPANIES},
v AS (SELECT l.n_name AS list_id, c.*, CASE WHEN c.location = '' THEN 0.5 WHEN contains(c.location, l.n_name) THEN 1.0 ELSE 0.0 END AS geo,
    CASE WHEN industry = '' THEN 0.5 WHEN industry IN ('building', 'furniture') THEN 1.0 WHEN contains(summary, 'building') OR contains(summary, 'furniture') THEN 0.5 ELSE 0.0 END AS ind,
    CASE WHEN low IS NULL THEN 0.5 WHEN least(high, 130) > greatest(low, 50) AND least(high, 130) - greatest(low, 50) >= 0.5 * (high - low) THEN 1.0 ELSE 0.0 END AS size,
    CASE stage WHEN '' THEN 0.5 WHEN 'a轮' THEN 1.0 ELSE 0.0 END AS fund, CASE WHEN contains(summary, 'urgent') THEN 1.0 ELSE 0.5 END AS sig, CASE WHEN contact_count > 0 THEN 1.0 ELSE 0.5 END AS reach
  FROM companies c JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) l ON c.r_name = l.r_name),
s AS (SELECT *, (5 * geo + 5 * ind + 3 * size + 3 * fund + 2 * sig + reach)::DOUBLE / 19 AS ratio, geo = 0 OR ind = 0 OR size = 0 OR fund = 0 AS hard_miss,
    (geo = 1)::INT + (ind = 1)::INT + (size = 1)::INT + (fund = 1)::INT + (sig = 1)::INT + (reach = 1)::INT AS hits,
    (geo = .5)::INT + (ind = .5)::INT + (size = .5)::INT + (fund = .5)::INT + (sig = .5)::INT + (reach = .5)::INT AS unsure,
    list_slice(list_filter([CASE WHEN geo = 0 THEN '地域：' || list_id END, CASE WHEN ind = 0 THEN '行业：homes' END, CASE WHEN size = 0 THEN '规模：50+' END, CASE WHEN fund = 0 THEN '融资阶段：A轮' END], lambda x: x IS NOT NULL), 1, 2) AS missed FROM v),
j AS (SELECT *, round_even(ratio * 100, 0)::INT AS score, CASE WHEN ratio >= 0.75 AND NOT hard_miss THEN '明确符合' WHEN ratio >= 0.45 THEN '可能符合' ELSE '待确认' END AS match_level FROM s),
w AS (SELECT *, CASE WHEN match_level = '明确符合' THEN hits || '/6 条标准命中（加权得分 ' || score || '），地域与行业等硬性条件均一致，可直接进入触达序列。'
    WHEN match_level = '可能符合' AND hard_miss THEN hits || '/6 条标准命中，但「' || array_to_string(missed, '、') || '」不符合，建议人工确认后再跟进。'
    WHEN match_level = '可能符合' THEN hits || '/6 条标准命中（加权得分 ' || score || '），仍有 ' || unsure || ' 条需补充核实。'
    ELSE '仅 ' || hits || '/6 条标准命中（加权得分 ' || score || '），公开信息不足以支撑判断，需要补充调研。' END AS match_reason,
  row_number() OVER (PARTITION BY list_id ORDER BY CASE match_level WHEN '明确符合' THEN 0 WHEN '可能符合' THEN 1 ELSE 2 END, score DESC, pos) AS place FROM j)"""
RANKED_SQL = f"WITH {JUDGED} SELECT list_id, place::INT AS place, external_id, score, match_level, hard_miss, match_reason FROM w WHERE place <= 20"


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per criterion of every judged company, with its source."""
    judged = judged_companies(spark, sf_dir).withColumn("row_key", F.col("external_id"))
    return J.evaluation_rows(judged)


EVALUATIONS_SQL = f"""WITH {JUDGED}, e AS (SELECT list_id, external_id AS row_key, domain, unnest([
    {{'pos': 0, 'condition': '地域：' || list_id, 'v': geo, 'weight': 5}}, {{'pos': 1, 'condition': '行业：homes', 'v': ind, 'weight': 5}}, {{'pos': 2, 'condition': '规模：50+', 'v': size, 'weight': 3}},
    {{'pos': 3, 'condition': '融资阶段：A轮', 'v': fund, 'weight': 3}}, {{'pos': 4, 'condition': '意向信号：urgent', 'v': sig, 'weight': 2}}, {{'pos': 5, 'condition': '可触达性', 'v': reach, 'weight': 1}}]) AS x FROM v)
SELECT list_id, row_key, x.pos AS pos, x.condition AS condition, CASE x.v WHEN 1 THEN '符合' WHEN 0.5 THEN '不确定' ELSE '不符合' END AS status, x.weight AS weight,
  CASE WHEN domain = '' THEN '' ELSE 'https://' || domain || CASE x.pos WHEN 5 THEN '/contact' ELSE '/about' END END AS source_url FROM e"""


def rejudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old results judged anew; rows of companies without a funding stage have lost their record and keep their result."""
    judged = judged_companies(spark, sf_dir).withColumn("row_key", F.col("external_id"))
    old = judged.select("list_id", "row_key", F.lit(1).alias("score"), F.lit("待确认").alias("match_level"), F.lit("old").alias("match_reason"), "criteria")
    records = A.companies(spark, sf_dir).where("funding_stage <> ''").withColumn("row_key", F.col("external_id"))
    return J.rejudge(old, records).drop("match_reason")


REJUDGED_SQL = f"WITH {JUDGED} SELECT list_id, external_id AS row_key, CASE WHEN stage = '' THEN 1 ELSE score END AS score, CASE WHEN stage = '' THEN '待确认' ELSE match_level END AS match_level FROM j"


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.build_rows(judged_companies(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"))


def built_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).drop("match_reason")


ROWS = f"""{JUDGED}, p AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS ix FROM j),
listed AS (SELECT list_id, 'row-' || n_nationkey || '-' || ix AS row_id, ix AS pos, CASE WHEN domain = '' THEN name ELSE domain END AS row_key, name, domain, summary, location, industry, score, match_level,
  CASE WHEN p.pos % 7 = 0 THEN 'failed' ELSE 'ready' END AS summary_state, CASE WHEN p.pos % 7 = 0 THEN 'failed' ELSE 'ready' END AS contact_state, 'blocked' AS official_contact_state, contact_count,
  TIMESTAMP '2024-01-31' + to_seconds(ix * 7) AS created_at FROM p JOIN nation ON list_id = nation.n_name)"""
BUILT_SQL = f"WITH {ROWS} SELECT list_id, row_id, pos::INT AS pos, row_key, name, score, match_level, summary_state, contact_state, official_contact_state, contact_count, created_at FROM listed"


def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twelve of each list: rows seen so far that mention a word, by name."""
    rows = built(spark, sf_dir).join(A.companies(spark, sf_dir).select("name", "domain", "summary", "location", "industries"), "name")
    seen = company_lists(spark, sf_dir).select("list_id", (F.col("seed") * 10 + 100).alias("discovered_count"))
    return L.page_rows(rows, seen, 2, 12, keyword="GOODS", sort="name").select("list_id", "place", "row_id", "name", "total")


PAGED_SQL = f"""WITH {ROWS}, f AS (SELECT listed.*, row_number() OVER (PARTITION BY list_id ORDER BY name, pos) AS place, count(*) OVER (PARTITION BY list_id) AS total
  FROM listed JOIN nation ON list_id = n_name WHERE pos < n_nationkey * 10 + 100 AND contains(lower(name || ' ' || domain || ' ' || summary || ' ' || location || ' ' || industry), 'goods'))
SELECT list_id, place::INT AS place, row_id, name, total FROM f WHERE place BETWEEN 13 AND 24"""


def one_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as rows of one list, in their places; no task has the list to itself."""
    o = A.table(spark, sf_dir, "orders")
    rows = o.select(F.lit("all").alias("list_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "F", vocab.FULL).when(F.col("o_orderstatus") == "O", vocab.PARTIAL).otherwise(vocab.UNCONFIRMED).alias("match_level"), F.floor("o_totalprice").alias("score"))
    return L.sort_rows(rows, most=1000).select("pos", "place")


ONE_LIST_SQL = "SELECT o_orderkey AS pos, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, floor(o_totalprice) DESC, o_orderkey) AS place FROM orders"


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows, those that may match, that have no deep dive yet."""
    rows = built(spark, sf_dir).withColumn("dossier_state", F.when(F.col("contact_count") == 2, "ready").otherwise("blocked"))
    chosen = rows.where("match_level <> '待确认'").select("list_id", "row_id")
    return L.blocked_rows(rows, chosen).select("list_id", "row_id")


BLOCKED_SQL = f"WITH {ROWS} SELECT list_id, row_id FROM listed WHERE match_level <> '待确认' AND contact_count <> 2"


def research_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = built(spark, sf_dir).withColumn("official_note", F.when(F.col("pos") % 4 == 0, " mail ").otherwise("")).withColumn("official_contact_state", F.when(F.col("pos") % 2 == 0, "ready").otherwise("blocked"))
    return L.row_research_state(rows)


RESEARCH_SQL = f"""WITH {ROWS} SELECT list_id, row_id, contact_state AS contacts_state, CASE WHEN contact_state = 'ready' AND contact_count > 0 THEN '已挖掘到 ' || contact_count || ' 位' ELSE '未找到结果' END AS contacts_summary,
  CASE WHEN pos % 2 = 0 THEN 'ready' ELSE 'blocked' END AS official_state, CASE WHEN pos % 4 = 0 THEN 'mail' ELSE '未找到结果' END AS official_summary FROM listed"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rows of companies and people point to: their pages, else a home page, a profile or nothing."""
    c = A.companies(spark, sf_dir).where("domain <> '' or pos % 2 = 0")
    p = _people(spark, sf_dir).withColumn("source_url", F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("source_url")))
    label = F.when(F.col("pos") % 2 == 0, "site").otherwise("")
    both = c.select("external_id", J.row_references(F.col("evidence"), F.col("name"), F.col("domain")).alias("r")).unionByName(p.select("external_id", J.row_references(F.col("evidence"), F.col("name"), F.col("source_url"), label).alias("r")))
    return both.select("external_id", F.size("r").alias("links"), F.coalesce(F.get("r", F.lit(0))["title"], F.lit("")).alias("title"), F.coalesce(F.get("r", F.lit(0))["url"], F.lit("")).alias("url"))


# People


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with a profile, a team page and a post, with a profile, or without pages."""
    page = lambda end: F.struct(F.concat(F.lit("page"), F.lit(end)).alias("title"), F.concat("source_url", F.lit(end)).alias("url"), F.lit("").alias("snippet"))
    k = F.col("pos") % 3
    pages = F.when(k == 0, F.array(page(""), page("/team"), page("/posts/1"))).when(k == 1, F.array(page(""))).otherwise(F.array().cast(f"array<{EVIDENCE}>"))
    return A.people(spark, sf_dir).withColumn("evidence", pages)


def person_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per person and criterion with the page that backs it."""
    return J.evaluation_rows(_judged_people(spark, sf_dir, _people(spark, sf_dir)).withColumn("row_key", F.col("external_id")), True)


def person_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What research found of each person."""
    mailed = F.col("contact_email") != ""
    rows = A.people(spark, sf_dir).select(F.col("n_name").alias("list_id"), F.col("external_id").alias("row_id"), F.when(mailed, "ready").otherwise("blocked").alias("contact_state"), (F.col("pos") % 8).cast("int").alias("contact_count"), F.when(F.col("summary") != "", "ready").otherwise("failed").alias("summary_state"), "title")
    return L.row_research_state(rows, True)


PERSON_RESEARCH_SQL = f"""WITH {A.PEOPLE} SELECT n_name AS list_id, external_id AS row_id, CASE WHEN has_mail AND pos % 8 > 0 THEN 'ready' ELSE 'failed' END AS contact_state, CASE WHEN has_mail AND pos % 8 > 0 THEN '已获取邮箱或电话' ELSE '未找到结果' END AS contact_summary,
  CASE WHEN summary <> '' AND title <> '' THEN 'ready' ELSE 'blocked' END AS profile_state, CASE WHEN summary <> '' AND title <> '' THEN '职位与归属齐备' ELSE '缺少职位或所属机构' END AS profile_summary FROM people"""


def _judged_people(spark: SparkSession, sf_dir: str, people: DataFrame) -> DataFrame:
    """Each nation's list judges the people of its region by name, role, seniority, employer, place and background."""
    tokens = lambda *xs: F.array(*map(F.lit, xs))
    made = F.array(
        C.criterion("n", "姓名：Kehang Chen", "", "name", 5, tokens("Kehang Chen", "berg"), "", ""), C.criterion("t", "职位：销售", "", "title", 4, tokens("sales", "Marketing"), "", ""),
        C.criterion("s", "职级：管理层及以上", "", "seniority", 3, tokens("director"), "管理层", ""), C.criterion("c", "公司特征：软件", "", "company", 4, tokens("software"), "软件", ""),
        C.criterion("g", "地域：x", "", "geo", 3, F.array("list_id"), "x", ""), C.criterion("b", "履历背景：sales", "", "background", 3, tokens("sales before"), "", "", True),
    )
    listed = A.places(spark, sf_dir).select(F.col("n_name").alias("list_id"), F.col("r_name").alias("region")).withColumn("criteria", C.with_reachability(made, True))
    return J.judge(people.join(F.broadcast(listed), F.col("r_name") == F.col("region")), True)


def judged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged_people(spark, sf_dir, A.people(spark, sf_dir))
    return judged.select("list_id", "external_id", "score", "match_level", "hard_miss", F.array_join(F.transform("verdicts", lambda v: v["verdict"]), "/").alias("verdicts"))


PEOPLE_JUDGED = f"""{A.PEOPLE},
v AS (SELECT l.n_name AS list_id, p.*, CASE WHEN first = 'Chen' AND last = 'Kehang' THEN 1.0 WHEN last = 'Berg' THEN 0.5 ELSE 0.0 END AS a,
    CASE WHEN title = '' THEN 0.5 WHEN contains(lower(title), 'sales') OR contains(lower(title), 'marketing') THEN 1.0 WHEN contains(summary, 'sales') THEN 0.5 ELSE 0.0 END AS b,
    CASE title WHEN 'Sales Director' THEN 1.0 WHEN 'VP Engineering' THEN 1.0 WHEN 'Marketing Manager' THEN 0.5 WHEN '' THEN 0.5 WHEN 'Engineer' THEN 0.0 WHEN 'Procurement Lead' THEN 1.0 WHEN 'CTO' THEN 1.0
      WHEN 'Finance Analyst' THEN 0.0 WHEN 'Sales Manager' THEN 0.5 WHEN 'Chief Marketing Officer' THEN 1.0 ELSE 0.5 END AS c,
    CASE WHEN company || summary || keywords = '' THEN 0.5 WHEN contains(company || summary || keywords, 'software') THEN 1.0 WHEN contains(company, 'retail') THEN 0.0 ELSE 0.5 END AS d,
    CASE WHEN location = '' THEN 0.5 WHEN contains(location, l.n_name) THEN 1.0 ELSE 0.0 END AS e, CASE WHEN summary <> '' THEN 1.0 ELSE 0.5 END AS f, CASE WHEN has_mail THEN 1.0 ELSE 0.5 END AS g
  FROM people p JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) l ON p.r_name = l.r_name)"""
PEOPLE_SQL = f"""WITH {PEOPLE_JUDGED},
s AS (SELECT *, (5 * a + 4 * b + 3 * c + 4 * d + 3 * e + 3 * f + g)::DOUBLE / 23 AS ratio, a = 0 OR b = 0 OR c = 0 OR d = 0 OR e = 0 AS hard_miss FROM v)
SELECT list_id, external_id, round_even(ratio * 100, 0)::INT AS score, CASE WHEN ratio >= 0.75 AND NOT hard_miss THEN '明确符合' WHEN ratio >= 0.45 THEN '可能符合' ELSE '待确认' END AS match_level, hard_miss,
  array_to_string(list_transform([a, b, c, d, e, f, g], lambda x: CASE x WHEN 1 THEN '符合' WHEN 0.5 THEN '不确定' ELSE '不符合' END), '/') AS verdicts FROM s"""



def built_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged people as rows of their lists with reasons in their wording; those who have to do with sales."""
    p = A.people(spark, sf_dir).withColumn("seed", F.lit(7)).withColumn("missing_fields", F.when(F.col("summary") == "", F.array(F.lit("summary"))).otherwise(F.array().cast("array<string>")))
    rows = L.build_rows(_judged_people(spark, sf_dir, p), F.lit("2024-01-31").cast("timestamp"), True)
    told = p.select(F.col("source_url").alias("row_key"), "name_local", "title", "company", "company_domain", "source_url", "summary", "location")
    return L.filter_rows(rows.join(told, "row_key"), "SALES", people=True).select(rows.columns)


BUILT_PEOPLE_SQL = f"""WITH {PEOPLE_JUDGED},
s AS (SELECT *, (5 * a + 4 * b + 3 * c + 4 * d + 3 * e + 3 * f + g)::DOUBLE / 23 AS ratio, a = 0 OR b = 0 OR c = 0 OR d = 0 OR e = 0 AS hard_miss, [a, b, c, d, e, f, g] AS vs,
    ['姓名：Kehang Chen', '职位：销售', '职级：管理层及以上', '公司特征：软件', '地域：x'] AS names FROM v),
j AS (SELECT *, round_even(ratio * 100, 0)::INT AS score, CASE WHEN ratio >= 0.75 AND NOT hard_miss THEN '明确符合' WHEN ratio >= 0.45 THEN '可能符合' ELSE '待确认' END AS match_level, len(list_filter(vs, lambda x: x = 1)) AS hits, len(list_filter(vs, lambda x: x = 0.5)) AS unsure,
    list_slice(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN vs[i] = 0 THEN names[i] END), lambda x: x IS NOT NULL), 1, 2) AS missed,
    list_slice(list_filter(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN vs[i] = 1 THEN split_part(names[i], '：', 1) END), lambda x: x IS NOT NULL), 1, 2) AS met, row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS ix FROM s)
SELECT list_id, 'row-7-' || ix AS row_id, ix::INT AS pos, 'https://people.org/in/' || pos AS row_key, first || ' ' || last AS name, score, match_level,
  CASE WHEN match_level = '明确符合' THEN hits || '/7 条标准命中（加权得分 ' || score || '），' || CASE WHEN len(met) = 0 THEN '硬性条件' ELSE array_to_string(met, '、') END || '等硬性条件均一致，可进入触达序列。'
    WHEN match_level = '可能符合' AND hard_miss THEN hits || '/7 条标准命中，但「' || array_to_string(missed, '、') || '」不符合，建议人工确认后再跟进。'
    WHEN match_level = '可能符合' THEN hits || '/7 条标准命中（加权得分 ' || score || '），仍有 ' || unsure || ' 条需补充核实。'
    ELSE '仅 ' || hits || '/7 条标准命中（加权得分 ' || score || '），公开信息不足以支撑判断，需要补充调研。' END AS match_reason,
  CASE WHEN summary = '' THEN 'failed' ELSE 'ready' END AS summary_state, CASE WHEN has_mail THEN 'ready' ELSE 'failed' END AS contact_state, has_mail::BIGINT AS contact_count, TIMESTAMP '2024-01-31' + to_seconds(ix * 7) AS created_at
FROM j WHERE contains(lower(title), 'sales') OR contains(summary, 'sales')"""

PERSON_EVALUATIONS_SQL = f"""WITH {PEOPLE_JUDGED}, e AS (SELECT list_id, external_id AS row_key, v.pos AS k, unnest([
    {{'pos': 0, 'condition': '姓名：Kehang Chen', 'v': a, 'weight': 5}}, {{'pos': 1, 'condition': '职位：销售', 'v': b, 'weight': 4}}, {{'pos': 2, 'condition': '职级：管理层及以上', 'v': c, 'weight': 3}}, {{'pos': 3, 'condition': '公司特征：软件', 'v': d, 'weight': 4}},
    {{'pos': 4, 'condition': '地域：x', 'v': e, 'weight': 3}}, {{'pos': 5, 'condition': '履历背景：sales', 'v': f, 'weight': 3}}, {{'pos': 6, 'condition': '可触达性', 'v': g, 'weight': 1}}]) AS x FROM v)
SELECT list_id, row_key, x.pos AS pos, x.condition AS condition, CASE x.v WHEN 1 THEN '符合' WHEN 0.5 THEN '不确定' ELSE '不符合' END AS status, x.weight AS weight,
  CASE k % 3 WHEN 2 THEN '' ELSE 'https://people.org/in/' || k || CASE WHEN k % 3 = 0 AND x.pos = 6 THEN '/team' ELSE '' END END AS source_url FROM e"""
REFERENCES_SQL = f"""WITH {A.COMPANIES}, {A.PEOPLE}
SELECT external_id, CASE WHEN domain = '' THEN 1 ELSE 3 END AS links, CASE WHEN domain = '' THEN name || '（官网首页）' ELSE name || ' home' END AS title, CASE WHEN domain = '' THEN 'https://' ELSE 'https://' || domain || '/home' END AS url FROM companies WHERE domain <> '' OR pos % 2 = 0
UNION ALL SELECT external_id, CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE (pos % 5 <> 0)::INT END, CASE WHEN pos % 3 < 2 THEN 'page' WHEN pos % 5 = 0 THEN '' ELSE first || ' ' || last || ' · ' || CASE pos % 2 WHEN 0 THEN 'site' ELSE '公开档案' END END,
  CASE WHEN pos % 3 < 2 THEN 'https://people.org/in/' || pos WHEN pos % 5 = 0 THEN '' ELSE 'https://people.org/in/' || pos END FROM people"""

QUERIES = {
    "w1_ranked_companies": ranked_companies, "j_evaluations": evaluations, "j_rejudged": rejudged, "l_built_rows": built_rows, "l_built_people": built_people, "l_paged_rows": paged_rows, "l_one_list": one_list, "l_blocked_rows": blocked, "l_research_states": research_states, "w2_judged_people": judged_people, "j_references": references, "j_person_evaluations": person_evaluations, "l_person_research": person_research,
}
ORACLE = {
    "w1_ranked_companies": RANKED_SQL, "j_evaluations": EVALUATIONS_SQL, "j_rejudged": REJUDGED_SQL, "l_built_rows": BUILT_SQL, "l_built_people": BUILT_PEOPLE_SQL, "l_paged_rows": PAGED_SQL, "l_one_list": ONE_LIST_SQL, "l_blocked_rows": BLOCKED_SQL, "l_research_states": RESEARCH_SQL, "w2_judged_people": PEOPLE_SQL, "j_references": REFERENCES_SQL, "j_person_evaluations": PERSON_EVALUATIONS_SQL, "l_person_research": PERSON_RESEARCH_SQL,
}
