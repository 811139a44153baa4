"""The driver's tables as records, candidates, lists and interactions.

Every value is derived from a column, so the frames grow with the tables. The SQL texts give the same rows
and are the beginning of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.schemas import EVIDENCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nationkey, n_name, r_name): a dimension of 25 rows."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("nationkey"), "n_name", "r_name")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as company records, with their position, nation and region."""
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey"), F.lower("c_mktsegment")
    text = lambda x: x.cast("string")
    employees = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(text(k % 90 + 10), F.lit("-"), text(k % 90 + 60), F.lit(" 人"))).when(k % 4 == 2, "500 人以上").otherwise("120")
    funding = F.when(F.col("c_acctbal") < 0, "").when(F.col("c_acctbal") < 3000, "A 轮").when(F.col("c_acctbal") < 6000, "B轮").otherwise("未融资")
    domain = F.when(k % 5 == 0, "").otherwise(F.concat(s, text(k % 97), F.lit(".co.uk")))
    summary = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("supplier of "), s, F.lit(" goods in "), F.col("n_name"), F.when(k % 11 == 0, " urgent").otherwise("")))
    pages = F.array(*[F.struct(F.concat(F.col("c_name"), F.lit(f" {p}")).alias("title"), F.concat(F.lit("https://"), domain, F.lit(f"/{p}")).alias("url"), F.lit("").alias("snippet")) for p in ("home", "about", "contact")])
    joined = c.join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("nationkey"))
    return joined.select(
        k.alias("pos"), F.concat(F.lit("c"), text(k)).alias("external_id"), F.col("c_name").alias("name"), domain.alias("domain"),
        F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(s)).alias("industries"), summary.alias("summary"),
        F.when(k % 17 == 0, "").otherwise(F.concat("n_name", F.lit(", "), "r_name")).alias("location"), employees.alias("employees"), funding.alias("funding_stage"),
        (k % 3).cast("int").alias("contact_count"), F.when(domain == "", F.array().cast(f"array<{EVIDENCE}>")).otherwise(pages).alias("evidence"),
        F.when(k % 7 == 0, F.array(F.lit("contacts"), F.lit("official_contact"), F.lit("summary"))).otherwise(F.array(F.lit("official_contact"))).alias("missing_fields"),
        F.lit("primary").alias("source_id"), F.create_map(F.lit("origin"), F.lower("c_name")).alias("attributes"), "n_name", "r_name",
    )


COMPANIES = """
companies AS (
  SELECT c_custkey AS pos, 'c' || c_custkey AS external_id, c_name AS name, lower(c_mktsegment) AS seg, n_name, r_name,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) || (c_custkey % 97) || '.co.uk' END AS domain,
    CASE WHEN c_custkey % 13 = 0 THEN '' ELSE lower(c_mktsegment) END AS industry,
    CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'supplier of ' || lower(c_mktsegment) || ' goods in ' || n_name || CASE WHEN c_custkey % 11 = 0 THEN ' urgent' ELSE '' END END AS summary,
    CASE WHEN c_custkey % 17 = 0 THEN '' ELSE n_name || ', ' || r_name END AS location,
    CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_custkey % 90 + 10 WHEN 2 THEN 500 ELSE 120 END AS low,
    CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN c_custkey % 90 + 60 WHEN 2 THEN 1000000 ELSE 120 END AS high,
    CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 3000 THEN 'a轮' WHEN c_acctbal < 6000 THEN 'b轮' ELSE '未融资' END AS stage,
    CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 3000 THEN 'A 轮' WHEN c_acctbal < 6000 THEN 'B轮' ELSE '未融资' END AS funding_stage,
    c_custkey % 3 AS contact_count,
    CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE lower(c_mktsegment) || (c_custkey % 97) || '.co.uk' END AS dedupe_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as people, with their position and nation."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int") + 1)
    local = F.when(k % 8 == 0, pick(("陈可航", "王小明", "李雷"))).otherwise("")
    joined = s.join(F.broadcast(places(spark, sf_dir)), F.col("s_nationkey") == F.col("nationkey"))
    employer = pick(("software house", "retail chain", "holding", ""))
    return joined.select(
        k.alias("pos"), F.concat(F.lit("p"), k.cast("string")).alias("external_id"), F.concat(pick(FIRST), F.lit(" "), pick(LAST)).alias("name"), local.alias("name_local"), pick(TITLES).alias("title"), employer.alias("company"),
        F.lit("").alias("company_domain"), F.when(k % 9 == 0, "").otherwise(F.col("n_name")).alias("location"), F.when(k % 6 == 0, "worked in sales before").otherwise("").alias("summary"), F.array().cast("array<string>").alias("aliases"),
        F.when(k % 10 == 0, F.array(F.lit("software"))).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(k % 4 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit("@x.org"))).otherwise("").alias("contact_email"),
        F.lit("").alias("contact_phone"), F.concat(F.lit("https://people.org/in/"), k.cast("string")).alias("source_url"), F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), "n_name", "r_name",
    )


FIRST = ("Ana", "Ben", "Chen", "Dora", "Emil", "Fay", "Gus")
LAST = ("Kehang", "Okafor", "Silva", "Berg", "Novak")
TITLES = ("Sales Director", "VP Engineering", "Marketing Manager", "", "Engineer", "Procurement Lead", "CTO", "Finance Analyst", "Sales Manager", "Chief Marketing Officer", "Clerk")


def _pick(xs: tuple, n: int | None = None) -> str:
    return f"list_extract([{', '.join(repr(x) for x in xs)}], (s_suppkey % {n or len(xs)})::INT + 1)"


PEOPLE = f"""
people AS (
  SELECT s_suppkey AS pos, 'p' || s_suppkey AS external_id, {_pick(FIRST)} AS first, {_pick(LAST)} AS last, CASE WHEN s_suppkey % 8 = 0 THEN {_pick(("陈可航", "王小明", "李雷"))} ELSE '' END AS name_local,
    {_pick(TITLES)} AS title, {_pick(("software house", "retail chain", "holding", ""))} AS company, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE n_name END AS location,
    CASE WHEN s_suppkey % 6 = 0 THEN 'worked in sales before' ELSE '' END AS summary, CASE WHEN s_suppkey % 10 = 0 THEN 'software' ELSE '' END AS keywords,
    s_suppkey % 4 = 0 AS has_mail, n_name, r_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def web_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web results of ten queries; title and text by patterns, so that SQL can follow."""
    p = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)$", 1), r"<[^>]*>", " ")
    return p.select(F.concat(F.lit("q"), (F.col("page_id") % 10).cast("string")).alias("query_id"), F.col("page_id").alias("rank"), F.col("page_id").alias("pos"), "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("content"), "html")


WEB = r"""
web AS (SELECT 'q' || (page_id % 10) AS query_id, page_id AS rank, page_id AS pos, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(regexp_extract(html, '(?s)<article>(.*)$', 1), '<[^>]*>', ' ', 'g') AS content,
  lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '')) AS host FROM pages)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sightings of their customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.lower("c_name").alias("dedupe_key"), F.concat("c_name", F.lit("/"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("").alias("domain"), F.col("o_orderpriority").alias("source_id"), (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("seen_at"))


SIGHTINGS = """
sightings AS (SELECT lower(c_name) AS dedupe_key, c_name || '/' || o_orderkey AS name, o_orderpriority AS source_id, o_orderdate + to_seconds(o_orderkey % 86400) AS seen_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: purchases and sign-ups are opportunities, errors have no signal."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "purchase", "建议跟进").when(F.col("event_type") == "signup", "保持关注").otherwise("暂无信号")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("pos"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("owner"), F.concat(F.lit("company "), F.col("user_id").cast("string")).alias("company_name"),
        F.col("event_type").alias("channel"), F.col("event_type").alias("signal"), level.alias("level"), F.col("ts").alias("last_message_at"), F.col("ts").alias("happened_at"), F.col("props").alias("summary"),
    )


INTERACTIONS = """
interactions AS (SELECT event_id AS id, event_id AS pos, 'u' || (user_id % 7) AS owner, 'company ' || user_id AS company_name, event_type AS channel, event_type AS signal,
  CASE event_type WHEN 'purchase' THEN '建议跟进' WHEN 'signup' THEN '保持关注' ELSE '暂无信号' END AS level, ts AS last_message_at, ts AS happened_at, props AS summary FROM events)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per order clerk bucket: orders as lists with a status and a discovered count."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(F.concat(F.lit("l"), F.col("o_orderkey").cast("string")).alias("list_id"), status.alias("status"), (F.col("o_orderkey") % 40).alias("discovered_count"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))


LISTS = """
lists AS (SELECT 'l' || o_orderkey AS list_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 40 AS discovered_count, o_orderdate AS created_at, o_orderkey AS id FROM orders)"""
