"""Enrichment and the history of companies: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.operators import enrich as E
from leadmill.plans.recalling import ENTITY_NAME_SQL, entity_name
from leadmill.schemas import EVIDENCE
from leadmill.sources import adapters as A

NOW = "1998-01-01"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.enrich_targets(A.companies(spark, sf_dir))
    return t.select("name", "domain", F.array_join("missing", "/").alias("missing"), "dedupe_key")


TARGETS_SQL = f"WITH {A.COMPANIES} SELECT name, domain, CASE WHEN summary = '' THEN 'contacts/official_contact/summary' ELSE 'official_contact' END AS missing, dedupe_key FROM companies"


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first web result about each nation that lacks a summary, directory results first."""
    n = A.places(spark, sf_dir).select("nationkey", F.lower("n_name").alias("dedupe_key"), F.col("n_name").alias("name"), F.concat(F.lit("thther"), F.lit(".org")).alias("domain"), F.array(F.lit("summary")).alias("missing"))
    w = A.web_results(spark, sf_dir)
    results = w.join(F.broadcast(n.select("nationkey", "dedupe_key")), F.col("pos") % 25 == F.col("nationkey")).select("dedupe_key", (F.col("pos") % 2).alias("stage"), "rank", "url", F.lit("t").alias("title"), "content")
    found = E.first_relevant(n.drop("nationkey"), results)
    return found.select("dedupe_key", "stage", F.length("summary").alias("chars"), "url", "source", F.size("attributes").alias("fields"))


RELEVANT_SQL = f"""WITH {A.WEB}, x AS (SELECT lower(n_name) AS dedupe_key, pos % 2 AS stage, rank, url, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body FROM web JOIN nation ON pos % 25 = n_nationkey WHERE contains(lower(url), 'thther')),
f AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY stage, rank) AS nth FROM x WHERE body <> '')
SELECT dedupe_key, stage, least(length(body), 400)::INT AS chars, url, CASE stage WHEN 0 THEN 'directory' ELSE 'web_search' END AS source, 0 AS fields FROM f WHERE nth = 1"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("cache_key"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("value"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("interval 7 days") * 50).alias("expires_at"),
    )


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache states of targets, some of them never asked for."""
    t = A.table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 4 == 0, "n").otherwise("k"), F.col("o_orderkey").cast("string")).alias("cache_key"))
    return E.cache_lookup(t, _cache(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("cache_key", "state")


CACHED_SQL = f"""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'n' ELSE 'k' END || o_orderkey AS cache_key, CASE WHEN o_orderkey % 4 = 0 OR o_orderdate + INTERVAL 350 DAY < TIMESTAMP '{NOW}' THEN 'miss' WHEN o_orderkey % 3 = 0 THEN 'known_empty' ELSE 'hit' END AS state FROM orders"""


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after pruning to a tenth of its rows or less."""
    cache = _cache(spark, sf_dir)
    return E.cache_prune(cache, F.lit(NOW).cast("timestamp"), most=100, drop=50).select("cache_key", "value")


PRUNED_SQL = f"""WITH c AS (SELECT 'k' || o_orderkey AS cache_key, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS value, o_orderdate AS created_at FROM orders WHERE o_orderdate + INTERVAL 350 DAY >= TIMESTAMP '{NOW}'),
r AS (SELECT *, row_number() OVER (ORDER BY created_at, cache_key) AS nth, count(*) OVER () AS n FROM c) SELECT cache_key, value FROM r WHERE n < 100 OR nth > 50"""


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a second source, one per key."""
    c = A.companies(spark, sf_dir).withColumn("key", T.dedupe_key(F.col("domain"), F.col("name"))).groupBy("key").agg(F.min(F.struct("pos", "name", "domain")).alias("x"))
    p = F.col("x.pos")
    page = lambda s: F.struct(F.lit("more").alias("title"), F.concat(F.lit("https://"), F.col("x.domain"), F.lit(s)).alias("url"), F.lit("").alias("snippet"))
    return c.select(
        F.col("x.name").alias("name"), F.col("x.domain").alias("domain"), F.concat(F.lit("about "), F.col("x.name")).alias("summary"), F.lit("Earth").alias("location"), F.when(p % 2 == 0, "10-20").otherwise("").alias("employees"), F.lit("B轮").alias("funding_stage"),
        F.array(F.lit("new")).alias("industries"), F.array(page("/about"), page("/press")).cast(f"array<{EVIDENCE}>").alias("evidence"), F.create_map(F.lit("origin"), F.lit("second"), F.lit("founded"), F.lit("1999")).alias("attributes"), F.lit("vendor").alias("source_id"),
    )


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.merge_enrichment(A.companies(spark, sf_dir), _enriched(spark, sf_dir))
    return m.select("external_id", "summary", "location", "employees", "funding_stage", F.array_join("industries", "/").alias("industries"), F.size("evidence").alias("evidence"), F.array_join(F.array_sort("missing_fields"), "/").alias("missing"), F.col("attributes")["origin"].alias("origin"), F.try_element_at("attributes", F.lit("enriched_by")).alias("enriched_by"))


MERGED = f"""{A.COMPANIES}, k AS (SELECT dedupe_key, min(pos) AS p FROM companies GROUP BY dedupe_key), e AS (SELECT k.dedupe_key, k.p, c.name AS new_name FROM k JOIN companies c ON c.pos = k.p),
m AS (SELECT c.*, e.p IS NOT NULL AS got, e.p, new_name, CASE WHEN c.pos % 4 = 0 THEN '' WHEN c.pos % 4 = 1 THEN (c.pos % 90 + 10) || '-' || (c.pos % 90 + 60) || ' 人' WHEN c.pos % 4 = 2 THEN '500 人以上' ELSE '120' END AS employees FROM companies c LEFT JOIN e USING (dedupe_key))"""
MERGED_SQL = f"""WITH {MERGED} SELECT external_id, CASE WHEN got AND summary = '' THEN 'about ' || new_name ELSE summary END AS summary, CASE WHEN got AND location = '' THEN 'Earth' ELSE location END AS location,
  CASE WHEN got AND employees = '' AND p % 2 = 0 THEN '10-20' ELSE employees END AS employees, CASE WHEN got AND funding_stage = '' THEN 'B轮' ELSE funding_stage END AS funding_stage, CASE WHEN got AND industry = '' THEN 'new' ELSE industry END AS industries,
  CASE WHEN domain <> '' THEN CASE WHEN got THEN 4 ELSE 3 END WHEN got THEN 2 ELSE 0 END AS evidence, CASE WHEN pos % 7 <> 0 THEN 'official_contact' WHEN got THEN 'contacts/official_contact' ELSE 'contacts/official_contact/summary' END AS missing,
  CASE WHEN got THEN 'second' ELSE lower(name) END AS origin, CASE WHEN got THEN 'vendor' END AS enriched_by FROM m"""


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies filled from three sources with gaps, of which keys repeat: a field comes from the first that has it."""
    base = A.companies(spark, sf_dir)
    sources = F.array(*[F.when(F.col("pos") % step == 0, source) for source, step in (("alpha", 2), ("beta", 3), ("gamma", 5))])
    c = base.where("name <> ''").select("pos", "name", "domain", F.explode(F.array_compact(sources)).alias("source_id"))
    c = c.groupBy(T.dedupe_key(F.col("domain"), F.col("name")).alias("key"), "source_id").agg(F.min_by(F.struct("name", "domain"), "pos").alias("x"))
    said = lambda word: F.concat(F.col("source_id"), F.lit(word))
    new = c.select(
        F.col("x.name").alias("name"), F.col("x.domain").alias("domain"), F.when(F.col("source_id") == "alpha", "").otherwise(said(" says")).alias("summary"), said(" town").alias("location"),
        F.when(F.col("source_id") == "gamma", "").otherwise(said(" staff")).alias("employees"), F.lit("").alias("funding_stage"), F.array().cast("array<string>").alias("industries"),
        F.array().cast(f"array<{EVIDENCE}>").alias("evidence"), F.create_map(F.lit("of"), F.col("source_id")).alias("attributes"), "source_id",
    )
    blank = base.select(*[F.lit("").alias(x) if x in E.FILLABLE else F.col(x) for x in base.columns])
    m = E.merge_enrichment(blank, new.union(new), ("gamma", "alpha"))
    return m.select("external_id", "summary", "location", "employees", F.try_element_at("attributes", F.lit("of")).alias("of"), F.try_element_at("attributes", F.lit("enriched_by")).alias("enriched_by"))


BY_SOURCE_SQL = f"""WITH {A.COMPANIES}, s AS (SELECT dedupe_key, bool_or(pos % 5 = 0) AS g, bool_or(pos % 2 = 0) AS a, bool_or(pos % 3 = 0) AS b FROM companies WHERE name <> '' AND dedupe_key <> '' GROUP BY dedupe_key)
SELECT external_id, CASE WHEN g THEN 'gamma says' WHEN b THEN 'beta says' ELSE '' END AS summary, CASE WHEN g THEN 'gamma town' WHEN a THEN 'alpha town' WHEN b THEN 'beta town' ELSE '' END AS location,
  CASE WHEN a THEN 'alpha staff' WHEN b THEN 'beta staff' ELSE '' END AS employees, CASE WHEN g THEN 'gamma' WHEN a THEN 'alpha' WHEN b THEN 'beta' END AS of,
  nullif(concat_ws('+', CASE WHEN g THEN 'gamma' END, CASE WHEN a THEN 'alpha' END, CASE WHEN b THEN 'beta' END), '') AS enriched_by FROM companies LEFT JOIN s USING (dedupe_key)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.merge_enrichment(A.companies(spark, sf_dir), _enriched(spark, sf_dir))
    labels = A.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("vendor").alias("source_id"), F.lit("Vendor data").alias("label"))
    found = E.enrichment_ledger(m, labels)
    return found.select("external_id", "enriched_by", "source_label", F.col("fields")["founded"].alias("founded"), F.size("fields").alias("fields"))


LEDGER_SQL = f"WITH {MERGED} SELECT external_id, 'vendor' AS enriched_by, 'Vendor data' AS source_label, '1999' AS founded, 1 AS fields FROM m WHERE got"


def _enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sightings(spark, sf_dir).select("dedupe_key", "source_id", F.col("name").alias("record"), F.col("seen_at").alias("fetched_at"))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_enrichment(_enrichments(spark, sf_dir)).select("dedupe_key", "source_id", "fetched_at")


LATEST_SQL = f"WITH {A.SIGHTINGS} SELECT dedupe_key, source_id, max(seen_at) AS fetched_at FROM sightings GROUP BY ALL"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.enrichment_audit(_enrichments(spark, sf_dir), F.lit("1996-01-01").cast("timestamp"), F.lit("1997-01-01").cast("timestamp"))


AUDIT_SQL = f"WITH {A.SIGHTINGS} SELECT source_id, count(DISTINCT dedupe_key) AS companies FROM sightings WHERE seen_at >= TIMESTAMP '1996-01-01' AND seen_at < TIMESTAMP '1997-01-01' GROUP BY source_id"


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company master from two parts of the history, merged."""
    s = A.sightings(spark, sf_dir)
    early, late = s.where("seen_at < timestamp '1996-06-01'"), s.where("seen_at >= timestamp '1996-06-01'")
    return E.merge_master(E.company_master(early), E.company_master(late))


MASTER_SQL = f"""WITH {A.SIGHTINGS} SELECT dedupe_key, arg_max(name, (seen_at, source_id, name)) AS name, arg_min(source_id, (seen_at, source_id)) AS first_source, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, arg_max(source_id, (seen_at, source_id, name)) AS last_source, count(*) AS seen_count FROM sightings GROUP BY dedupe_key"""


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_seen_by_source(E.company_master(A.sightings(spark, sf_dir)))


FIRST_SQL = f"WITH {A.SIGHTINGS}, m AS (SELECT dedupe_key, arg_min(source_id, (seen_at, source_id)) AS first_source, min(seen_at) AS since FROM sightings GROUP BY dedupe_key) SELECT first_source, date_trunc('month', since)::TIMESTAMP AS period, count(*) AS companies FROM m GROUP BY ALL"


def vendor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = p.select(
        k.cast("string").alias("id"), F.when(k % 3 == 0, None).otherwise(F.col("p_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("HTTPS://"), F.col("p_type"), F.lit(".Org/"))).alias("website"), F.col("p_type").alias("industry"),
        F.array(F.lit(" a "), F.col("p_brand"), F.lit(""), F.lit("z")).alias("tags"), F.lit("x").alias("locality"), F.when(k % 2 == 0, "x").otherwise("y").alias("region"), F.lit(" ").alias("country"), F.lit(" 10-20 ").alias("size"),
        F.when(k % 5 == 0, "").otherwise("s").alias("summary"), F.lit("target").alias("target_name"), F.lit("t.org").alias("target_domain"),
    )
    return E.profile_to_record(raw).withColumn("industries", F.array_join("industries", "/")).withColumn("missing_fields", F.array_join("missing_fields", "/"))


VENDOR_SQL = """SELECT 'profile-' || p_partkey AS external_id, CASE WHEN p_partkey % 3 = 0 THEN 'target' ELSE p_name END AS name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || '.org' ELSE 't.org' END AS domain, p_type || '/a/' || p_brand AS industries,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 's' END AS summary, CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'x，y' END AS location, '10-20' AS employees, CASE WHEN p_partkey % 5 = 0 THEN 'contacts/official_contact/summary' ELSE 'contacts/official_contact' END AS missing_fields FROM part"""

#: The field table of the dossiers below.
FIELDS = [{"name": "domain", "kind": "text", "required": True}, {"name": "summary", "kind": "text", "required": False}, {"name": "industries", "kind": "list", "required": True}]


def _dossier_json(p: DataFrame) -> DataFrame:
    """Part rows as a model's answers: some under the older key, some without an object."""
    k = F.col("p_partkey")
    inner = F.to_json(F.struct(F.when(k % 4 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.concat("p_type", F.lit(" ")).alias("domain"), F.array(F.lit(" i "), F.lit("")).alias("industries"), F.when(k % 2 == 0, "Yes").otherwise("false").alias("matched"), F.array(F.lit("summary"), F.lit(" domain "), F.lit("risk")).alias("missing")))
    return p.withColumn("inner", inner).withColumn("payload", F.when(k % 5 == 0, "{\"other\": 1}").when(k % 5 == 1, F.concat(F.lit('{"company": '), "inner", F.lit("}"))).otherwise(F.concat(F.lit('{"entity": '), "inner", F.lit("}"))))


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _dossier_json(A.table(spark, sf_dir, "part")).withColumn("d", E.parse_dossier(F.col("payload"), F.col("p_brand"), FIELDS))
    return p.select("p_partkey", F.col("d").isNull().alias("broken"), F.col("d.name").alias("name"), F.col("d.domain").alias("domain"), F.array_join("d.industries", "/").alias("industries"), F.col("d.matched").alias("matched"), F.array_join("d.missing", "/").alias("missing"), F.when(F.col("d").isNotNull(), E.filled_count(F.col("d"), FIELDS)).alias("filled"))


DOSSIER_SQL = """SELECT p_partkey, p_partkey % 5 = 0 AS broken, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS name, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS domain, CASE WHEN p_partkey % 5 > 0 THEN 'i' END AS industries,
  CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 2 = 0 END AS matched, CASE WHEN p_partkey % 5 > 0 THEN 'domain' END AS missing, CASE WHEN p_partkey % 5 > 0 THEN 2 END AS filled FROM part"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity lists of a model, one payload per brand and size."""
    p = _dossier_json(A.table(spark, sf_dir, "part")).groupBy(F.col("p_brand").alias("run_id"), F.col("p_size").alias("round")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "inner"))), lambda x: x["inner"]), ",").alias("all"))
    return E.parse_entities(p.withColumn("payload", F.concat(F.lit('{"entities": ['), "all", F.lit("]}"))), FIELDS).select("run_id", "round", "pos", "name", "domain", F.array_join("industries", "/").alias("industries"), "matched")


ENTITY_SQL = """SELECT * FROM (SELECT p_brand AS run_id, p_size AS round, (row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1)::INT AS pos, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS name, p_type AS domain, 'i' AS industries, p_partkey % 2 = 0 AS matched FROM part) WHERE name <> ''"""


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers applied to company rows: blanks filled, the name upgraded."""
    rows = A.companies(spark, sf_dir).withColumn("row_key", F.col("external_id")).withColumn("official_contact_state", F.lit("blocked"))
    d = rows.where("contact_count > 0").select("row_key", F.concat(F.lit("d "), F.col("name")).alias("name"), F.when(F.col("pos") % 4 == 0, F.concat(F.lit("legal "), F.col("name"))).otherwise("").alias("legal_name"), F.lit("new.org").alias("domain"), F.lit("s").alias("summary"), F.array(F.lit("i")).alias("industries"), F.when(F.col("pos") % 4 == 1, "m@x.org").otherwise(" ").alias("official_contact"))
    out = E.apply_dossier(rows, d)
    return out.select("row_key", "name", "domain", "summary", F.array_join("industries", "/").alias("industries"), "official_contact_state", F.size("agent_fields").alias("extra"), F.array_join(F.array_sort(F.map_keys("written")), "/").alias("written"))


APPLIED_SQL = f"""WITH {A.COMPANIES} SELECT external_id AS row_key, CASE WHEN contact_count = 0 THEN name WHEN pos % 4 = 0 THEN 'legal ' || name ELSE 'd ' || name END AS name, CASE WHEN contact_count > 0 AND domain = '' THEN 'new.org' ELSE domain END AS domain, CASE WHEN contact_count > 0 AND summary = '' THEN 's' ELSE summary END AS summary,
  CASE WHEN contact_count > 0 AND industry = '' THEN 'i' ELSE industry END AS industries, CASE WHEN contact_count > 0 AND pos % 4 = 1 THEN 'ready' ELSE 'blocked' END AS official_contact_state, CASE WHEN contact_count = 0 THEN 0 ELSE (pos % 4 = 0)::INT + (pos % 4 = 1)::INT END AS extra,
  CASE WHEN contact_count = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN domain = '' THEN 'domain' END, CASE WHEN industry = '' THEN 'industries' END, 'name', CASE WHEN summary = '' THEN 'summary' END], lambda x: x IS NOT NULL), '/') END AS written FROM companies"""


def light_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted entities as records with their pages."""
    from leadmill.operators.recall import entity_pages

    p = A.table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("entity_id"), entity_name().alias("name"), F.concat(F.lit(" "), F.col("p_type"), F.lit(".Org")).alias("domain"), F.lit(" s ").alias("summary"), (F.col("p_size") > 25).alias("matched"), F.col("p_brand").alias("reason"), F.lit("").alias("evidence_url"), F.create_map(F.lit("agent"), F.lit("x"), F.lit("brand"), F.col("p_brand")).alias("attributes"))
    out = E.entity_to_record(e, entity_pages(e, A.web_results(spark, sf_dir)))
    return out.select("entity_id", "name", "domain", "summary", "match_level", "score", F.col("attributes")["agent"].alias("agent"), F.size("attributes").alias("attributes"), F.size("evidence").alias("evidence"))


LIGHT_SQL = f"""WITH {A.WEB}, d AS (SELECT {ENTITY_NAME_SQL} AS name, * FROM part), n AS (SELECT name, least(4, count(*))::INT AS n FROM (SELECT DISTINCT name FROM d) x JOIN web ON contains(title || ' ' || content, name) GROUP BY name)
SELECT p_partkey AS entity_id, d.name, lower(p_type) || '.org' AS domain, 's' AS summary, CASE WHEN p_size > 25 THEN '明确符合' ELSE '可能符合' END AS match_level, CASE WHEN p_size > 25 THEN 90 ELSE 45 END AS score, 'discovery' AS agent, 3 AS attributes, coalesce(n.n, 0) AS evidence FROM d LEFT JOIN n USING (name)"""

QUERIES = {
    "e_targets": targets, "e_first_relevant": relevant, "e_cache_lookup": cached, "e_cache_prune": pruned, "e_merge_enrichment": merged, "e_enriched_by_source": by_source, "e_ledger": ledger, "e_latest": latest, "e_audit": audit, "e_company_master": master, "e_first_seen": first_seen,
    "e_vendor_profiles": vendor_profiles, "e_dossiers": dossiers, "e_entities": entities, "e_applied_dossiers": applied, "e_light_records": light_records,
}
ORACLE = {
    "e_targets": TARGETS_SQL, "e_first_relevant": RELEVANT_SQL, "e_cache_lookup": CACHED_SQL, "e_cache_prune": PRUNED_SQL, "e_merge_enrichment": MERGED_SQL, "e_enriched_by_source": BY_SOURCE_SQL, "e_ledger": LEDGER_SQL, "e_latest": LATEST_SQL, "e_audit": AUDIT_SQL, "e_company_master": MASTER_SQL, "e_first_seen": FIRST_SQL,
    "e_vendor_profiles": VENDOR_SQL, "e_dossiers": DOSSIER_SQL, "e_entities": ENTITY_SQL, "e_applied_dossiers": APPLIED_SQL, "e_light_records": LIGHT_SQL,
}
