"""Recall, merging, ranking of candidates and pages: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.operators import recall as R
from leadmill.plans.texts import _SITE, SKIP, SUFFIXES, site
from leadmill.sources import adapters as A

HINTS = ("the", "que", "zzz")
#: A site that stands for a directory of companies.
DIRECTORY = "ththth.example.net"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten queries of the web results."""
    ids = A.web_results(spark, sf_dir).select("query_id").distinct()
    return ids.select("query_id", F.array(*map(F.lit, HINTS)).alias("hints"), F.lit(12).alias("limit"))


def web_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``web_candidates``, of a source whose results must have a site of their own."""
    k = F.col("rank")
    named = F.when(k % 3 == 0, F.concat(F.lit("星河"), k.cast("string"), F.lit("科技有限公司 - "), "title")).otherwise("")
    results = A.web_results(spark, sf_dir).withColumn("title", named).drop("html")
    return R.web_to_companies(results, _queries(spark, sf_dir), site, SKIP, (DIRECTORY,), domain_only=True).select("query_id", "rank", "key", "name", "domain")


WEB_SITES_SQL = f"""WITH {A.WEB}, h AS (SELECT *, {_SITE} AS site FROM web WHERE host <> '' AND host <> '{DIRECTORY}' AND host NOT LIKE '%.{DIRECTORY}'),
n AS (SELECT *, CASE WHEN rank % 3 = 0 THEN '星河' || rank || '科技有限公司' ELSE upper(substr(site, 1, 1)) || replace(substr(split_part(site, '.', 1), 2), '-', ' ') END AS name FROM h WHERE site NOT IN {SKIP}),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, site ORDER BY rank) AS nth FROM n WHERE name <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f WHERE nth = 1)
SELECT query_id, rank, site AS key, name, host AS domain FROM k WHERE place <= 12"""


def web_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web results to the first twelve companies of each query, one per site."""
    k = F.col("rank")
    named = F.when(k % 3 == 0, F.concat(F.lit("星河"), k.cast("string"), F.lit("科技有限公司 - "), "title")).when(k % 3 == 1, F.concat(F.lit("一个好用的平台。"), "title")).otherwise("")
    told = F.when(k % 2 == 0, F.concat(F.lit("注册资本为 "), k.cast("string"), F.lit("万元，法定代表人：李雷，"), "content")).otherwise(F.col("content"))
    results = A.web_results(spark, sf_dir).withColumn("title", named).withColumn("content", told).drop("html")
    found = R.web_to_companies(results, _queries(spark, sf_dir), site, SKIP, (DIRECTORY,))
    return found.select(
        "query_id", "rank", "key", "name", "domain", F.array_join("industries", "/").alias("industries"), F.size("missing_fields").alias("missing"), F.element_at("evidence", 1)["title"].alias("title"),
        F.coalesce(F.col("attributes")["registered_capital"], F.lit("")).alias("capital"), F.coalesce(F.col("attributes")["legal_rep"], F.lit("")).alias("head"),
    )


WEB_SQL = f"""WITH {A.WEB}, t AS (SELECT *, CASE rank % 3 WHEN 0 THEN '星河' || rank || '科技有限公司 - ' || title WHEN 1 THEN '一个好用的平台。' || title ELSE '' END AS said, CASE WHEN rank % 2 = 0 THEN '注册资本为 ' || rank || '万元，法定代表人：李雷，' || content ELSE content END AS text FROM web),
h AS (SELECT *, {_SITE} AS site, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS shown, host = '{DIRECTORY}' OR host LIKE '%.{DIRECTORY}' AS listed FROM t),
n AS (SELECT *, CASE WHEN rank % 3 = 0 THEN '星河' || rank || '科技有限公司' WHEN listed THEN '' ELSE upper(substr(site, 1, 1)) || replace(substr(split_part(site, '.', 1), 2), '-', ' ') END AS name FROM h WHERE listed OR site NOT IN {SKIP}),
f AS (SELECT *, CASE WHEN listed THEN lower(name) ELSE site END AS key, row_number() OVER (PARTITION BY query_id, CASE WHEN listed THEN lower(name) ELSE site END ORDER BY rank) AS nth FROM n WHERE name <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM f WHERE nth = 1)
SELECT query_id, rank, key, name, CASE WHEN listed THEN '' ELSE host END AS domain, array_to_string(list_filter(['the', 'que', 'zzz'], lambda t: contains(shown || ' ' || body, t)), '/') AS industries,
  CASE WHEN body = '' THEN 3 ELSE 2 END AS missing, CASE WHEN shown = '' THEN name ELSE shown END AS title, CASE WHEN listed AND rank % 2 = 0 THEN rank || '万元' ELSE '' END AS capital, CASE WHEN listed AND rank % 2 = 0 THEN '李雷' ELSE '' END AS head
FROM k WHERE place <= 12"""


def merged_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recalls of each nation, twenty rows each at most, merged in order by key and name."""
    c = A.companies(spark, sf_dir).select(F.col("n_name").alias("query_id"), "pos", "name", "domain", "contact_count")
    first = R.top(c, ["query_id"], 20, "pos")
    more = R.top(c, ["query_id"], 20, F.col("contact_count").desc(), "pos")
    return R.merge_recalls(first, more)


MERGED_SQL = f"""WITH RECURSIVE {A.COMPANIES}, a AS (SELECT n_name AS query_id, pos, name, domain, 0 AS part, pos AS o, row_number() OVER (PARTITION BY n_name ORDER BY pos) AS nth FROM companies
    UNION ALL SELECT n_name, pos, name, domain, 1, pos, row_number() OVER (PARTITION BY n_name ORDER BY contact_count DESC, pos) FROM companies),
n AS (SELECT *, CASE WHEN domain = '' THEN lower(name) ELSE domain END AS key, lower(name) AS fold, row_number() OVER (PARTITION BY query_id ORDER BY part, o) AS rn FROM a WHERE nth <= 20),
r AS (SELECT query_id, 0::BIGINT AS rn, ''::VARCHAR AS name, ''::VARCHAR AS domain, 0 AS part, []::VARCHAR[] AS keys, []::VARCHAR[] AS names, false AS ok FROM (SELECT DISTINCT query_id FROM n)
  UNION ALL SELECT n.query_id, n.rn, n.name, n.domain, n.part, CASE WHEN n.part = 0 OR NOT (list_contains(r.keys, n.key) OR list_contains(r.names, n.fold)) THEN list_append(r.keys, n.key) ELSE r.keys END,
    CASE WHEN n.part = 0 OR NOT (list_contains(r.keys, n.key) OR list_contains(r.names, n.fold)) THEN list_append(r.names, n.fold) ELSE r.names END, n.part = 0 OR NOT (list_contains(r.keys, n.key) OR list_contains(r.names, n.fold))
  FROM r JOIN n ON n.query_id = r.query_id AND n.rn = r.rn + 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rn) - 1 AS place, part, name, domain FROM r WHERE ok"""


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies as items of four sources per nation, of which one has failed in some."""
    c = A.companies(spark, sf_dir)
    from leadmill.functions.text import dedupe_key

    key = dedupe_key(F.col("domain"), F.col("name"))
    items = c.select(F.col("n_name").alias("query_id"), F.concat(F.lit("s"), (F.col("pos") % 4).cast("string")).alias("source_id"), "pos", key.alias("key"), "external_id")
    calls = A.places(spark, sf_dir).select(F.col("n_name").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s"), F.col("nationkey").alias("k"))
    calls = calls.select("query_id", F.concat(F.lit("s"), F.col("s").cast("string")).alias("source_id"), (F.lit(9) - F.col("s")).alias("priority"), ((F.col("k") + F.col("s")) % 5 != 0).alias("ok"), (F.col("s") * 10).alias("latency_ms"), (F.col("s") * 0.5).alias("cost"), (F.col("k") % 3 * 25).alias("target"))
    return items, calls


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = R.waterfall_collect(*_sources(spark, sf_dir))
    return kept.select("query_id", "place", "source_id", "external_id")


def waterfall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.waterfall_collect(*_sources(spark, sf_dir))[1]


WATERFALL = f"""{A.COMPANIES},
calls AS (SELECT n_name AS query_id, 's' || s AS source_id, 9 - s AS priority, s * 10 AS latency, s * 0.5 AS cost, n_nationkey % 3 * 25 AS target, (n_nationkey + s) % 5 <> 0 AS ok FROM nation, range(4) t(s)),
good AS (SELECT * FROM calls WHERE ok),
f AS (SELECT c.n_name AS query_id, g.source_id, g.priority, g.target, c.pos, c.external_id, row_number() OVER (PARTITION BY c.n_name, dedupe_key ORDER BY priority, g.source_id, c.pos) AS nth
  FROM companies c JOIN good g ON g.query_id = c.n_name AND g.source_id = 's' || (c.pos % 4)),
n AS (SELECT query_id, source_id, count(*) AS gained FROM f WHERE nth = 1 GROUP BY ALL),
b AS (SELECT g.*, coalesce(gained, 0) AS gained, coalesce(sum(coalesce(gained, 0)) OVER (PARTITION BY g.query_id ORDER BY priority, g.source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM good g LEFT JOIN n USING (query_id, source_id)),
asked AS (SELECT * FROM b WHERE target = 0 OR before < target)"""
WATERFALL_SQL = f"""WITH {WATERFALL}, p AS (SELECT f.query_id, f.source_id, external_id, f.target, row_number() OVER (PARTITION BY f.query_id ORDER BY f.priority, f.source_id, pos) AS place FROM f JOIN asked a USING (query_id, source_id) WHERE nth = 1)
SELECT query_id, place::INT AS place, source_id, external_id FROM p WHERE target = 0 OR place <= target"""
SUMMARY_SQL = f"""WITH {WATERFALL} SELECT q.n_name AS query_id, coalesce(string_agg(source_id, '+' ORDER BY priority, source_id), '') AS source_id, coalesce(sum(latency), 0)::BIGINT AS latency_ms, coalesce(sum(cost), 0)::DOUBLE AS cost,
  coalesce(max(target) > 0 AND sum(gained) > max(target), false) AS truncated, count(source_id) = 0 AS failed FROM nation q LEFT JOIN asked a ON a.query_id = q.n_name GROUP BY q.n_name"""


def ranked_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies recalled per nation: the nation as city for even ones, industry words first, rotated by seed."""
    q = A.places(spark, sf_dir).select(F.col("n_name").alias("query_id"), F.when(F.col("nationkey") % 8 != 0, F.col("n_name")).alias("city"), F.array(F.lit("furniture"), F.lit("build")).alias("hints"), (F.col("nationkey") * 7 + 3).alias("seed"), F.lit(15).alias("limit"))
    corpus = A.companies(spark, sf_dir).select("pos", "external_id", "industries", F.col("n_name").alias("city"))
    return R.rank_companies(q, corpus).select("query_id", "place", "external_id", "hit")


CORPUS_SQL = f"""WITH {A.COMPANIES}, q AS (SELECT n_name AS query_id, CASE WHEN n_nationkey % 8 <> 0 THEN n_name END AS city, n_nationkey * 7 + 3 AS seed FROM nation),
x AS (SELECT query_id, seed, external_id, pos, contains(industry, 'furniture') OR contains(industry, 'build') AS hit FROM q JOIN companies c ON city IS NULL OR c.n_name = city),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit ORDER BY pos) - 1 AS ix, count(*) OVER (PARTITION BY query_id, hit) AS n, sum(hit::INT) OVER (PARTITION BY query_id) AS hits, count(*) OVER (PARTITION BY query_id) AS all_n FROM x),
z AS (SELECT *, (((ix - (seed % CASE WHEN hits > 0 THEN hits ELSE all_n END) % n) % n) + n) % n AS turn FROM y),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, turn) AS place FROM z) SELECT query_id, place::INT AS place, external_id, hit FROM p WHERE place <= 15"""


def ranked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People per nation by name, role, employer and place."""
    lit = lambda *xs: F.array(*map(F.lit, xs))
    q = A.places(spark, sf_dir).select(F.col("n_name").alias("query_id"), lit("Kehang Chen", "Berg").alias("name_hints"), lit("Sales", "CTO").alias("role_hints"), lit("software").alias("company_hints"), F.col("n_name").alias("city"), F.col("nationkey").alias("seed"), F.lit(30).alias("limit"))
    return R.rank_people(q, A.people(spark, sf_dir)).select("query_id", "place", "external_id", "relevance")


RANKED_PEOPLE_SQL = f"""WITH {A.PEOPLE}, x AS (SELECT l.n_name AS query_id, n_nationkey AS seed, p.pos, external_id, CASE WHEN first = 'Chen' AND last = 'Kehang' THEN 4 WHEN last = 'Berg' THEN 2 ELSE 0 END
    + CASE WHEN contains(title || keywords, 'Sales') OR contains(title || keywords, 'CTO') THEN 2 ELSE 0 END + CASE WHEN contains(company || keywords, 'software') THEN 2 ELSE 0 END + CASE WHEN contains(location, l.n_name) THEN 1 ELSE 0 END AS relevance FROM people p, nation l),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, relevance > 0 ORDER BY relevance DESC, pos) - 1 AS ix, count(*) OVER (PARTITION BY query_id, relevance > 0) AS n FROM x),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance > 0 DESC, CASE WHEN relevance > 0 THEN ix ELSE (((ix - seed % n) % n) + n) % n END) AS place FROM y)
SELECT query_id, place::INT AS place, external_id, relevance FROM p WHERE place <= 30"""


def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints against all people by equi-joins on name forms."""
    q = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("query_id"), F.element_at(F.array(F.lit("Chen Kehang"), F.lit("silva"), F.lit("陈可"), F.lit("x")), F.col("n_nationkey") % 4 + 1).alias("hint"))
    p = A.people(spark, sf_dir).select("pos", F.array("name", "name_local").alias("names"))
    return R.name_matches(q, p)


MATCHED_SQL = f"""WITH {A.PEOPLE} SELECT l.n_name AS query_id, p.pos, CASE n_nationkey % 4 WHEN 0 THEN 'full' ELSE 'partial' END AS level FROM people p, nation l
WHERE CASE n_nationkey % 4 WHEN 0 THEN first = 'Chen' AND last = 'Kehang' WHEN 1 THEN last = 'Silva' WHEN 2 THEN name_local = '陈可航' ELSE false END"""


def more_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten companies of each nation that its list doesn't have."""
    c = A.companies(spark, sf_dir).select(F.col("n_name").alias("list_id"), F.col("external_id").alias("row_key"), "pos", "contact_count")
    return R.exclude_taken(c, c.where("contact_count = 0"), 10, "pos").select("list_id", "row_key")


MORE_SQL = f"WITH {A.COMPANIES}, x AS (SELECT n_name AS list_id, external_id AS row_key, row_number() OVER (PARTITION BY n_name ORDER BY pos) AS nth FROM companies WHERE contact_count <> 0) SELECT list_id, row_key FROM x WHERE nth <= 10"


def domain_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts of each nation: the first forty, then those with wanted titles."""
    p = A.people(spark, sf_dir).select(F.lower(F.col("n_name")).alias("domain"), "pos", "title", "external_id")
    q = A.places(spark, sf_dir).select(F.col("n_name").alias("request_id"), F.concat(F.lit(" "), F.col("n_name")).alias("domain"), F.lit(40).alias("limit"), F.array(F.lit("Sales "), F.lit("")).alias("positions"))
    return R.contacts_by_domain(q, p).select("request_id", "external_id", "title")


CONTACTS_SQL = f"WITH {A.PEOPLE}, x AS (SELECT n_name AS request_id, external_id, title, row_number() OVER (PARTITION BY n_name ORDER BY pos) AS nth FROM people) SELECT request_id, external_id, title FROM x WHERE nth <= 40 AND contains(lower(title), 'sales')"


def entity_name():
    """Names of parts as entities: a letter with an ending that pages may have, so that hundreds of names differ, some on many pages, some on none."""
    k = F.col("p_partkey")
    letters = lambda n: F.substring(F.md5(k.cast("string")), n, 1)
    return F.when(k % 50 == 0, F.substring("p_name", 1, 3)).when(k % 7 == 0, "th").otherwise(F.concat(F.translate(letters(1), "0123456789", "ghiklmnors"), F.translate(letters(2), "0123456789", "aeiouaeiou"), F.translate(letters(3), "0123456789", "stnrlstnrl")))


ENTITY_NAME_SQL = """CASE WHEN p_partkey % 50 = 0 THEN substr(p_name, 1, 3) WHEN p_partkey % 7 = 0 THEN 'th' ELSE translate(substr(md5(p_partkey::VARCHAR), 1, 1), '0123456789', 'ghiklmnors')
  || translate(substr(md5(p_partkey::VARCHAR), 2, 1), '0123456789', 'aeiouaeiou') || translate(substr(md5(p_partkey::VARCHAR), 3, 1), '0123456789', 'stnrlstnrl') END"""


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four pages that name each entity, or its own link."""
    e = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), entity_name().alias("name"), F.when(F.col("p_partkey") % 2 == 0, "https://x.org").otherwise("").alias("evidence_url"), F.lit("why").alias("reason"))
    found = R.entity_pages(e, A.web_results(spark, sf_dir))
    return found.select("entity_id", F.size("evidence").alias("pages"), F.coalesce(F.get("evidence", F.lit(0))["url"], F.lit("")).alias("first_url"))


PAGES_SQL = f"""WITH {A.WEB}, e AS (SELECT p_partkey AS entity_id, {ENTITY_NAME_SQL} AS name, CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org' ELSE '' END AS link FROM part),
d AS (SELECT DISTINCT name FROM e), h AS (SELECT d.name, url, pos, row_number() OVER (PARTITION BY d.name ORDER BY pos) AS nth FROM d JOIN web ON contains(title || ' ' || content, d.name)),
g AS (SELECT name, count(*) AS n, min_by(url, pos) AS url FROM h WHERE nth <= 4 GROUP BY name)
SELECT entity_id, CASE WHEN n IS NOT NULL THEN n WHEN link <> '' THEN 1 ELSE 0 END::INT AS pages, coalesce(url, link) AS first_url FROM e LEFT JOIN g USING (name)"""


def first_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names found over rounds: the first of each name and run."""
    x = A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("run_id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("round"), F.col("p_partkey").alias("pos"))
    return R.dedupe_entities(x)


ENTITIES_SQL = "SELECT run_id, name, round, pos FROM (SELECT p_brand AS run_id, p_name AS name, p_size % 5 AS round, p_partkey AS pos, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size % 5, p_partkey) AS nth FROM part) WHERE nth = 1"


def homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.web_results(spark, sf_dir).select((F.col("pos") % 40).alias("entity_id"), "rank", "url")
    return R.locate_homepage(hits, ("ththth.example.net",), SKIP, SUFFIXES)


HOMEPAGES_SQL = f"""WITH {A.WEB}, h AS (SELECT pos % 40 AS entity_id, rank, {_SITE} AS site FROM web) SELECT entity_id, min_by(site, rank) AS domain FROM h WHERE site NOT IN {SKIP} AND site <> 'ththth.example.net' GROUP BY entity_id"""


def subpages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best links of each site among the page addresses; every seventh was found on another site."""
    w = A.web_results(spark, sf_dir)
    word = F.element_at(F.array(*map(F.lit, ("about-us", "products", "x", "news/contact", "关于我们", "join"))), (F.col("pos") % 6).cast("int") + 1)
    own = site(T.extract_host(F.col("url")))
    links = w.select(own.alias("page_id"), F.when(F.col("pos") % 7 == 0, "https://none.example.net/").otherwise(F.concat(F.lit("https://"), own)).alias("home"), F.regexp_replace("url", F.lit("(//[^/]*/)"), F.concat(F.lit("$1"), word, F.lit("/"))).alias("link"))
    return R.pick_subpages(links, 3, SUFFIXES)


SUBPAGES_SQL = f"""WITH {A.WEB}, l AS (SELECT {_SITE} AS page_id, pos, lower(regexp_replace(regexp_replace(regexp_replace(url, '(//[^/]*/)', '\\1' || list_extract(['about-us', 'products', 'x', 'news/contact', '关于我们', 'join'], (pos % 6)::INT + 1) || '/'), '[?#].*$', ''), '/+$', '')) AS link, {_SITE} AS site FROM web),
g AS (SELECT *, contains(path, 'about')::INT + contains(path, '关于')::INT + contains(path, 'product')::INT + contains(path, 'join')::INT + contains(path, 'news')::INT AS score FROM (SELECT *, coalesce(string_split(link, '/')[4], '') AS path FROM l)),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, length(path), link) AS place FROM g WHERE pos % 7 <> 0 AND path <> '') SELECT page_id, place::INT AS place, link, score FROM r WHERE place <= 3"""


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen documents of each source as one numbered text."""
    d = A.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("list_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("title"), F.lit("u").alias("url"), F.col("text").alias("content"), F.lit("w").alias("website"), F.lit("d").alias("date"))
    packed = R.pack_documents(d)
    return packed.select("list_id", "n_documents", F.length("packed").cast("long").alias("chars"), F.sha2(F.col("packed").cast("binary"), 256).alias("digest"))


PACKED_SQL = r"""WITH d AS (SELECT coalesce(source, '') AS list_id, doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS nth FROM documents),
p AS (SELECT list_id, count(*) AS n, string_agg('[' || nth || '] ' || lang || chr(10) || '    站点：w　日期：d' || chr(10) || '    URL：u' || chr(10) || '    正文：' || substr(body, 1, 260), chr(10) ORDER BY nth) AS packed FROM d WHERE nth <= 16 GROUP BY list_id)
SELECT list_id, n::INT AS n_documents, length(packed)::BIGINT AS chars, sha256(packed) AS digest FROM p"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``packed_documents``, by language, with whole bodies."""
    d = A.table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("list_id"), F.col("doc_id").alias("pos"), F.coalesce("source", F.lit("")).alias("title"), F.lit(" u ").alias("url"), F.coalesce("text", F.lit("")).alias("content"), F.lit("w").alias("website"), F.lit("d").alias("date"))
    return R.pack_documents(d, materials=True).select("list_id", "n_documents", F.length("packed").cast("long").alias("chars"), F.sha2(F.col("packed").cast("binary"), 256).alias("digest"))


MATERIALS_SQL = r"""WITH d AS (SELECT coalesce(lang, '') AS list_id, coalesce(source, '') AS title, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id) AS nth FROM documents),
p AS (SELECT list_id, count(*) AS n, string_agg('[' || nth || '] ' || title || chr(10) || '    URL：u' || chr(10) || '    正文：' || body, chr(10) ORDER BY nth) AS packed FROM d WHERE nth <= 16 GROUP BY list_id)
SELECT list_id, n::INT AS n_documents, length(packed)::BIGINT AS chars, sha256(packed) AS digest FROM p"""


def mentioned_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nation whose name, or its last four letters, a conversation line mentions."""
    q = A.table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn", "role").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(F.lit(" in NATION_3"), F.lit(" ON_1 "), F.lit("")), (F.col("turn") % 3).cast("int") + 1)).alias("text"))
    return R.find_mentioned_company(q, A.places(spark, sf_dir).select(F.col("nationkey").alias("pos"), F.concat("n_name", F.lit("股份有限公司")).alias("name")))


MENTIONED_SQL = """WITH q AS (SELECT conv_id || '/' || turn || '/' || role AS query_id, coalesce(text, '') || list_extract([' in NATION_3', ' ON_1 ', ''], (turn % 3)::INT + 1) AS text FROM conversations)
SELECT query_id, min_by(n_name || '股份有限公司', n_nationkey) AS company FROM q JOIN nation ON contains(text, CASE WHEN length(n_name) > 4 THEN right(n_name, 4) ELSE n_name END) GROUP BY query_id"""

QUERIES = {
    "r_web_candidates": web_candidates, "r_merged_recalls": merged_recalls, "r_waterfall": waterfall, "r_waterfall_summary": waterfall_summary, "r_ranked_corpus": ranked_corpus, "r_ranked_people": ranked_people, "r_matched_names": matched_names,
    "r_more_candidates": more_candidates, "r_domain_contacts": domain_contacts, "r_named_pages": named_pages, "r_first_entities": first_entities, "r_homepages": homepages, "r_subpages": subpages, "r_packed_documents": packed_documents, "r_mentioned_companies": mentioned_companies, "r_web_sites": web_sites, "r_materials": materials,
}
ORACLE = {
    "r_web_candidates": WEB_SQL, "r_merged_recalls": MERGED_SQL, "r_waterfall": WATERFALL_SQL, "r_waterfall_summary": SUMMARY_SQL, "r_ranked_corpus": CORPUS_SQL, "r_ranked_people": RANKED_PEOPLE_SQL, "r_matched_names": MATCHED_SQL, "r_more_candidates": MORE_SQL,
    "r_domain_contacts": CONTACTS_SQL, "r_named_pages": PAGES_SQL, "r_first_entities": ENTITIES_SQL, "r_homepages": HOMEPAGES_SQL, "r_subpages": SUBPAGES_SQL, "r_packed_documents": PACKED_SQL, "r_mentioned_companies": MENTIONED_SQL, "r_web_sites": WEB_SITES_SQL, "r_materials": MATERIALS_SQL,
}
