"""Counts, charts, lists and streams: queries and SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import listing as L
from leadmill.operators import reports as R
from leadmill.plans.enriching import MASTER_SQL
from leadmill.plans.judging import JUDGED, ROWS, built
from leadmill.sources import adapters as A
from leadmill.sources import io, snapshots
from leadmill.streaming import jobs

NOW = "2024-01-31"
LEVELS = ("建议跟进", "保持关注", "暂无信号", "已失效")


def _now():
    return F.lit(NOW).cast("timestamp")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = A.places(spark, sf_dir).select(F.col("n_name").alias("list_id"), (F.col("nationkey") * 20).alias("verified"), (F.col("nationkey") % 2 == 0).alias("completed"))
    return R.list_progress(built(spark, sf_dir), lists)


PROGRESS_SQL = f"""WITH {ROWS}, x AS (SELECT r.*, n_nationkey AS k, r.pos < n_nationkey * 20 AS seen FROM listed r JOIN nation ON list_id = n_name)
SELECT list_id, count(*) AS goal, sum(seen::INT)::BIGINT AS verified, sum((seen AND match_level <> '待确认')::INT)::BIGINT AS qualified, sum((seen AND match_level = '明确符合')::INT)::BIGINT AS "full", coalesce(sum(CASE WHEN seen THEN contact_count END), 0)::BIGINT AS contacts,
  CASE WHEN max(k) % 2 = 0 THEN CASE WHEN sum(seen::INT) >= count(*) THEN '已达到目标数量' ELSE '候选已耗尽' END END AS stop_reason FROM x GROUP BY list_id"""


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overview_stats(A.lists(spark, sf_dir)).join(R.report_stats(A.lists(spark, sf_dir)))


OVERVIEW_SQL = f"""WITH {A.LISTS} SELECT sum(CASE WHEN status = 'completed' THEN discovered_count ELSE 0 END)::BIGINT AS "rows", sum((status = 'running')::INT)::BIGINT AS running, count(*) AS lists, sum((status = 'completed')::INT)::BIGINT AS report_count, sum((status = 'running')::INT)::BIGINT AS running_count FROM lists"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.opportunity_levels(A.interactions(spark, sf_dir), LEVELS, "暂无信号")


LEVELS_SQL = f"""WITH {A.INTERACTIONS}, l AS (SELECT * FROM (VALUES (0, '建议跟进'), (1, '保持关注'), (2, '暂无信号'), (3, '已失效')) t(pos, level)), t AS (SELECT round_even(100 * (1 - sum((level = '暂无信号')::INT)::DOUBLE / greatest(count(*), 1)), 0)::INT AS p FROM interactions)
SELECT l.pos, l.level, count(i.id) AS n, any_value(p) AS analyzed_percent FROM l LEFT JOIN interactions i ON i.level = l.level CROSS JOIN t GROUP BY ALL"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.activity_feed(A.interactions(spark, sf_dir), "建议跟进", _now())


FEED_SQL = f"""WITH {A.INTERACTIONS}, f AS (SELECT pos, company_name || ' · ' || signal AS title, summary AS detail, last_message_at AS happened_at FROM interactions WHERE level = '建议跟进' ORDER BY pos LIMIT 4)
SELECT * FROM f UNION ALL SELECT 2147483648, '智能体运行状态正常', '当前有 ' || count(*) || ' 条商机记录，其中 ' || sum((level = '建议跟进')::INT) || ' 条处于建议跟进状态，建议在今日内完成首轮跟进。', TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE FROM interactions"""


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.kpi_cards(A.interactions(spark, sf_dir), _now(), {"interaction": F.lit(True), "message": F.col("channel") == "click", "connection": F.col("channel") == "signup", "opportunity": F.col("level") == "建议跟进"})


KPI_SQL = f"""WITH {A.INTERACTIONS}, r AS (SELECT * FROM (VALUES ('7d', 7), ('30d', 30), ('12m', 365)) t(range, days)), x AS (SELECT r.range, i.*, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(happened_at)) AS age, days FROM r CROSS JOIN interactions i)
SELECT range, count(*) AS interaction, sum((channel = 'click')::INT)::BIGINT AS message, sum((channel = 'signup')::INT)::BIGINT AS connection, sum((level = '建议跟进')::INT)::BIGINT AS opportunity FROM x WHERE age >= 0 AND age < days * 86400 GROUP BY range"""


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trend_chart(A.interactions(spark, sf_dir), _now(), "30d", F.col("level") == "建议跟进")


TRENDS_SQL = f"""WITH {A.INTERACTIONS}, x AS (SELECT 9 - floor((floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(happened_at))) / 259200)::INT AS bucket, level, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(happened_at)) AS age FROM interactions)
SELECT b::INT AS bucket, count(x.level) AS interaction, coalesce(sum((x.level = '建议跟进')::INT), 0)::BIGINT AS opportunity FROM range(10) t(b) LEFT JOIN x ON x.bucket = b AND age >= 0 AND age < 2592000 GROUP BY b"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "邮箱渠道").otherwise("社媒渠道").alias("channel_group"), F.when(F.col("s_acctbal") > 0, "connected").otherwise("available").alias("state"))
    return R.channel_summary(c)


CHANNELS_SQL = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN '邮箱渠道' ELSE '社媒渠道' END AS channel_group, sum((s_acctbal > 0)::INT)::BIGINT AS connected, count(*) AS total FROM supplier GROUP BY ALL"


def outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outreach_steps(A.lists(spark, sf_dir).select("list_id", F.to_date("created_at").alias("started_on"))).select("list_id", "step", "day", "channel", F.col("due_on").cast("timestamp").alias("due_on"))


OUTREACH_SQL = f"""WITH {A.LISTS} SELECT list_id, step, day, channel, (created_at::DATE + (day - 1))::TIMESTAMP AS due_on FROM lists CROSS JOIN (VALUES (0, 1, '邮件'), (1, 2, 'LinkedIn'), (2, 3, 'LinkedIn'), (3, 5, 'WhatsApp'), (4, 7, '会议')) t(step, day, channel)"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = A.table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_returnflag").alias("source_id"), F.col("l_linestatus").alias("capability"), F.col("l_quantity").cast("int").alias("latency_ms"), F.col("l_linenumber").cast("double").alias("cost"), (F.col("l_partkey") % 9 != 0).alias("ok"), (F.col("l_partkey") % 4 == 0).alias("cache_hit"), F.col("l_linenumber").alias("tokens"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_costs(_calls(spark, sf_dir))


COSTS_SQL = "SELECT l_returnflag AS source_id, l_linestatus AS capability, count(*) AS calls, sum(trunc(l_quantity)::BIGINT)::BIGINT AS latency_ms, sum(l_linenumber)::DOUBLE AS cost, sum((l_partkey % 9 = 0)::INT)::BIGINT AS failures FROM lineitem GROUP BY ALL"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.criteria_usage(_calls(spark, sf_dir))


USAGE_SQL = "SELECT sum((k % 9 <> 0 AND k % 4 <> 0)::INT)::BIGINT AS calls, sum((k % 4 = 0)::INT)::BIGINT AS cache_hits, sum((k % 9 = 0)::INT)::BIGINT AS failures, sum(CASE WHEN k % 9 <> 0 AND k % 4 <> 0 THEN l_linenumber ELSE 0 END)::BIGINT AS total_tokens FROM (SELECT l_partkey AS k, l_linenumber FROM lineitem)"


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page past the end of every owner's opportunities: the last one."""
    return L.opportunity_page(A.interactions(spark, sf_dir), 10_000_000, "建议跟进").select("owner", "id", "page", F.col("total").cast("long").alias("total"))


OPPORTUNITY_SQL = f"""WITH {A.INTERACTIONS}, x AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY last_message_at DESC, id) AS place, count(*) OVER (PARTITION BY owner) AS total FROM interactions WHERE level = '建议跟进')
SELECT owner, id, ceil(total / 8.0)::INT AS page, total FROM x WHERE place > (ceil(total / 8.0) - 1) * 8"""


def found_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "conversations")
    return L.keyword_search(t, " SYSTEM", "role", "text").select("conv_id", "turn", "role")


FOUND_SQL = "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(role), 'system') OR contains(lower(text), 'system')"


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_first(A.lists(spark, sf_dir), 50).select("id", "list_id", "created_at")


NEWEST_SQL = f"WITH {A.LISTS} SELECT id, list_id, created_at FROM lists ORDER BY created_at DESC, id LIMIT 50"


def kept_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay when the lists of one region are deleted."""
    lists = A.places(spark, sf_dir).select(F.col("n_name").alias("list_id"), "r_name")
    _, rows = io.delete_list(lists, built(spark, sf_dir), lists.where("r_name = 'ASIA'"))
    return rows.select("list_id", "row_id")


KEPT_SQL = f"WITH {ROWS} SELECT list_id, row_id FROM listed JOIN nation ON list_id = n_name JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"


def uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a user would type them, matched to companies."""
    c = A.companies(spark, sf_dir)
    names = c.select("pos", F.lower(F.replace("name", F.lit("#"), F.lit("# "))).alias("name"))
    return io.match_uploaded(names, c).select("pos", "external_id")


UPLOADED_SQL = f"WITH {A.COMPANIES} SELECT pos, external_id FROM companies"


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to JSON text and back."""
    c = A.companies(spark, sf_dir)
    kind = c.select(F.struct("name", "industries", "contact_count", "attributes").alias("r")).schema["r"].dataType.simpleString()
    back = io.from_json_col(io.to_json_col(F.struct("name", "industries", "contact_count", "attributes")), kind)
    return c.select("external_id", back.alias("r")).select("external_id", "r.name", F.array_join("r.industries", "/").alias("industries"), "r.contact_count", F.col("r.attributes")["origin"].alias("origin"))


JSON_SQL = f"WITH {A.COMPANIES} SELECT external_id, name, industry AS industries, contact_count::INT AS contact_count, lower(name) AS origin FROM companies"


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names as an uploaded file, with a header and blank rows, read back; an upload counts up to a thousand names."""
    c = A.companies(spark, sf_dir).select("pos", F.when(F.col("pos") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(", \"x\" "))).alias("name"))
    path = f"{io.shared_folder(spark)}/upload-{uuid.uuid4().hex[:12]}"
    rows = c.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("pos"), F.lit("Company Name").alias("name")))
    rows.coalesce(1).sortWithinPartitions("pos").select("name", F.lit("more").alias("more")).write.csv(path, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.import_names(spark, path)


IMPORTED_SQL = f"""WITH {A.COMPANIES}, n AS (SELECT *, row_number() OVER (ORDER BY pos) AS nr FROM companies), k AS (SELECT nr AS pos, name || ', "x"' AS name, row_number() OVER (ORDER BY nr) AS nth FROM n WHERE pos % 9 <> 0) SELECT pos, name FROM k WHERE nth <= 1000"""


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a JSON table that lacks columns and values, in their schema and without nulls."""
    c = A.companies(spark, sf_dir).select("external_id", "name", F.expr("nullif(location, '')").alias("location"), F.when(F.size("industries") > 0, F.col("industries")).alias("industries"), F.when(F.col("contact_count") > 0, F.col("contact_count")).alias("contact_count"), F.lit("x").alias("unknown"))
    path = f"{io.shared_folder(spark)}/records-{uuid.uuid4().hex[:12]}"
    c.write.json(path)
    r = io.read_records(spark, path, "company", "json")
    return r.select("external_id", "name", "location", "summary", F.array_join("industries", "/").alias("industries"), "contact_count", F.size("evidence").alias("evidence"), F.size("attributes").alias("attributes"))


READ_SQL = f"WITH {A.COMPANIES} SELECT external_id, name, location, '' AS summary, industry AS industries, contact_count::INT AS contact_count, 0 AS evidence, 0 AS attributes FROM companies"


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per nation; those of one region are written again with fewer rows, and no other list changes."""
    c = A.companies(spark, sf_dir).select("external_id", "contact_count", "r_name", F.col("n_name").alias("list_id"))
    path = f"{io.shared_folder(spark)}/lists-{uuid.uuid4().hex[:12]}"
    io.write_list(c, path)
    io.write_list(c.where("r_name = 'ASIA' and contact_count = 0"), path)
    return spark.read.parquet(path).select("list_id", "external_id")


REWRITTEN_SQL = f"WITH {A.COMPANIES} SELECT n_name AS list_id, external_id FROM companies WHERE r_name <> 'ASIA' OR contact_count = 0"


def list_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per nation in buckets; those of one region are replaced by fewer rows, one list is deleted. Read before and after."""
    c = A.companies(spark, sf_dir).select("external_id", "contact_count", "r_name", F.col("n_name").alias("list_id"))
    store = snapshots.ListStore(spark, f"{io.shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}", 8)
    store.replace(c)
    before = store.read()  # stays readable
    store.replace(c.where("r_name = 'ASIA' and contact_count = 0"), c.where("r_name = 'ASIA' or list_id = 'NATION_3'").select("list_id"))
    kept = before.groupBy("list_id").agg(F.count("*").alias("n")).select("list_id", F.lit("before").alias("external_id"), "n")
    return store.read().select("list_id", "external_id", F.lit(1).cast("long").alias("n")).unionByName(kept)


STORE_SQL = f"""WITH {A.COMPANIES} SELECT n_name AS list_id, external_id, 1::BIGINT AS n FROM companies WHERE n_name <> 'NATION_3' AND (r_name <> 'ASIA' OR contact_count = 0)
UNION ALL SELECT n_name, 'before', count(*) FROM companies GROUP BY n_name"""


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lists and rows, some of them broken, read back."""
    lists = A.lists(spark, sf_dir).select("list_id", "status", F.when(F.col("id") % 11 == 0, "oops").otherwise('{"a": "b"}').alias("payload"))
    k = F.col("l_partkey")
    rows = A.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("l"), F.col("l_orderkey").cast("string")).alias("list_id"), F.col("l_linenumber").cast("string").alias("row_id"), F.when(k % 7 == 0, "oops").otherwise(F.concat(F.lit('{"name": "n'), k.cast("string"), F.lit('", "more": 1}'))).alias("row_json"),
        F.when(k % 101 == 0, "{").otherwise("{}").alias("record_json"), F.when(k % 103 == 0, "no").otherwise("{}").alias("judgment_json"),
    )
    good, fine = io.load_lists(lists, rows, "name string")
    return fine.join(good.select("list_id", "status"), "list_id").select("list_id", "row_id", "name", "status")


LOADED_SQL = f"""WITH {A.LISTS}, b AS (SELECT DISTINCT 'l' || l_orderkey AS list_id FROM lineitem WHERE l_partkey % 101 = 0 OR l_partkey % 103 = 0)
SELECT l.list_id, l_linenumber::VARCHAR AS row_id, 'n' || l_partkey AS name, CASE status WHEN 'running' THEN 'completed' ELSE status END AS status
FROM lists l JOIN lineitem ON l.list_id = 'l' || l_orderkey WHERE id % 11 <> 0 AND l_partkey % 7 <> 0 AND l.list_id NOT IN (FROM b)"""


# Streams, run over the table as it is until it is read


def _ended(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """The final state of a stream over what its source has now, as a table in the shared folder."""
    root = f"{io.shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.parquet(f"{root}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(A.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def streamed_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("happened_at"), F.when(F.col("event_type") == "purchase", "high").otherwise("none").alias("level"))
    return _ended(jobs.stream_trends(e), spark, "complete")


STREAM_TRENDS_SQL = "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS interaction, sum((event_type = 'purchase')::INT)::BIGINT AS opportunity FROM events GROUP BY ALL"


def streamed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users found by each kind of event, once each."""
    e = _events(spark, sf_dir).select(F.col("event_type").alias("run_id"), F.col("user_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("found_at"))
    return _ended(jobs.stream_dedupe(e, "60 days"), spark, "append").select("run_id", "name")


STREAM_NAMES_SQL = "SELECT DISTINCT event_type AS run_id, user_id::VARCHAR AS name FROM events"


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as arriving candidates, judged with their nation's frozen criteria."""
    from leadmill.plans.judging import company_lists

    schema = A.table(spark, sf_dir, "customer").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    records = A.companies(spark, sf_dir).drop("n_name", "r_name")
    known = A.places(spark, sf_dir)
    ids = arriving.select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("nationkey")).join(known.select("nationkey", F.col("n_name").alias("list_id")), "nationkey").drop("nationkey")
    judged = jobs.stream_judge(ids.join(records, "pos"), company_lists(spark, sf_dir).select("list_id", "criteria"))
    return _ended(judged.select("list_id", "external_id", "score", "match_level"), spark, "append")


STREAM_SCORES_SQL = f"WITH {JUDGED} SELECT list_id, external_id, score, match_level FROM j WHERE list_id = n_name"



def streamed_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company master from a stream of sightings that arrive in three files."""
    root = f"{io.shared_folder(spark)}/master-{uuid.uuid4().hex[:12]}"
    seen = A.sightings(spark, sf_dir)
    seen.repartition(3, F.xxhash64("name")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.stream_company_master(stream, f"{root}/out", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.read_master(spark, f"{root}/out")


QUERIES = {
    "p_list_progress": progress, "p_overview": overview, "p_opportunity_levels": levels, "p_activity_feed": feed, "p_kpi_cards": kpis, "p_trend_chart": trends, "p_channels": channels, "p_outreach": outreach, "p_source_costs": costs, "p_criteria_usage": usage,
    "l_opportunity_page": opportunities, "l_keyword_search": found_turns, "l_recent_first": newest, "s_deleted_lists": kept_lists, "s_uploaded_names": uploaded, "s_record_json": record_json, "m_stream_trends": streamed_trends, "m_stream_dedupe": streamed_names, "m_stream_judge": streamed_scores, "m_stream_company_master": streamed_master, "s_imported_names": imported, "s_read_records": read_back, "s_rewritten_lists": rewritten, "s_list_store": list_store, "s_loaded_lists": loaded,
}
ORACLE = {
    "p_list_progress": PROGRESS_SQL, "p_overview": OVERVIEW_SQL, "p_opportunity_levels": LEVELS_SQL, "p_activity_feed": FEED_SQL, "p_kpi_cards": KPI_SQL, "p_trend_chart": TRENDS_SQL, "p_channels": CHANNELS_SQL, "p_outreach": OUTREACH_SQL, "p_source_costs": COSTS_SQL, "p_criteria_usage": USAGE_SQL,
    "l_opportunity_page": OPPORTUNITY_SQL, "l_keyword_search": FOUND_SQL, "l_recent_first": NEWEST_SQL, "s_deleted_lists": KEPT_SQL, "s_uploaded_names": UPLOADED_SQL, "s_record_json": JSON_SQL, "m_stream_trends": STREAM_TRENDS_SQL, "m_stream_dedupe": STREAM_NAMES_SQL, "m_stream_judge": STREAM_SCORES_SQL, "m_stream_company_master": MASTER_SQL, "s_imported_names": IMPORTED_SQL, "s_read_records": READ_SQL, "s_rewritten_lists": REWRITTEN_SQL, "s_list_store": STORE_SQL, "s_loaded_lists": LOADED_SQL,
}
