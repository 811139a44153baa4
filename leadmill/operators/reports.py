"""Counts and charts: one aggregation each, with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill import vocab

#: Ranges with their days and number of points.
RANGES = {"7d": (7, 7), "30d": (30, 10), "12m": (365, 12)}


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


def list_progress(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (list_id, pos, match_level, contact_count), lists (list_id, verified, completed): full <= qualified <= verified <= goal."""
    joined = rows.join(lists, "list_id")
    seen = F.col("pos") < F.col("verified")
    counted = joined.groupBy("list_id").agg(
        F.count("*").alias("goal"), _n(seen).alias("verified"), _n(seen & (F.col("match_level") != vocab.UNCONFIRMED)).alias("qualified"), _n(seen & (F.col("match_level") == vocab.FULL)).alias("full"),
        F.coalesce(F.sum(F.when(seen, F.col("contact_count"))), F.lit(0)).cast("long").alias("contacts"), F.max("completed").alias("completed"),
    )
    reason = F.when(F.col("completed"), F.when(F.col("verified") >= F.col("goal"), "已达到目标数量").otherwise("候选已耗尽"))
    return counted.withColumn("stop_reason", reason).drop("completed")


def overview_stats(lists: DataFrame) -> DataFrame:
    """Rows of completed lists, running lists, lists."""
    done = F.when(F.col("status") == "completed", F.col("discovered_count"))
    return lists.agg(F.coalesce(F.sum(done), F.lit(0)).cast("long").alias("rows"), _n(F.col("status") == "running").alias("running"), F.count("*").alias("lists"))


def report_stats(reports: DataFrame) -> DataFrame:
    return reports.agg(_n(F.col("status") == "completed").alias("report_count"), _n(F.col("status") == "running").alias("running_count"))


def opportunity_levels(opportunities: DataFrame, levels: Sequence[str], none: str) -> DataFrame:
    """Count per level, zeros included, and the analysed percentage, rounded half to even; 100 without rows."""
    spark = opportunities.sparkSession
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "pos int, level string")
    counts = opportunities.groupBy("level").agg(F.count("*").alias("n"))
    whole = opportunities.agg(F.count("*").alias("total"), _n(F.col("level") == none).alias("open"))
    percent = F.bround(100 * (1 - F.col("open") / F.greatest(F.col("total"), F.lit(1)))).cast("int")
    return F.broadcast(listed).join(counts, "level", "left").join(F.broadcast(whole)).select("pos", "level", F.coalesce("n", F.lit(0)).alias("n"), percent.alias("analyzed_percent"))


def activity_feed(opportunities: DataFrame, follow_up: str, now: Column, n: int = 4) -> DataFrame:
    """The first follow-ups as entries, and one that sums up."""
    ours = opportunities.where(F.col("level") == follow_up)
    entries = ours.orderBy("pos").limit(n).select(F.col("pos").cast("long").alias("pos"), F.concat("company_name", F.lit(" · "), "signal").alias("title"), F.col("summary").alias("detail"), F.col("last_message_at").alias("happened_at"))
    whole = opportunities.agg(F.count("*").alias("n"), _n(F.col("level") == follow_up).alias("m"))
    text = F.concat(F.lit("当前有 "), F.col("n").cast("string"), F.lit(" 条商机记录，其中 "), F.col("m").cast("string"), F.lit(" 条处于建议跟进状态，建议在今日内完成首轮跟进。"))
    last = whole.select(F.lit(2**31).cast("long").alias("pos"), F.lit("智能体运行状态正常").alias("title"), text.alias("detail"), (now - F.expr("interval 30 minutes")).alias("happened_at"))
    return entries.unionByName(last)


def kpi_cards(interactions: DataFrame, now: Column, kinds: dict[str, Column]) -> DataFrame:
    """Totals of each kind over 7 days, 30 days and 12 months before ``now``."""
    age = F.unix_timestamp(now) - F.unix_timestamp("happened_at")
    inside = lambda days: (age >= 0) & (age < days * 86400)
    sums = interactions.agg(*[_n(inside(days) & test).alias(f"{key}_{name}") for key, (days, _) in RANGES.items() for name, test in kinds.items()])
    rows = F.array(*[F.struct(F.lit(key).alias("range"), *[F.col(f"{key}_{name}").alias(name) for name in kinds]) for key in RANGES])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def trend_chart(interactions: DataFrame, now: Column, key: str, is_opportunity: Column) -> DataFrame:
    """Interactions and opportunities per bucket of a range, empty buckets included; the last ends at ``now``."""
    days, points = RANGES[key]
    step = days * 86400 / points
    age = F.unix_timestamp(now) - F.unix_timestamp("happened_at")
    bucket = (F.lit(points - 1) - F.floor(age / step)).cast("int")
    counts = interactions.where((age >= 0) & (age < days * 86400)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("interaction"), _n(is_opportunity).alias("opportunity"))
    every = interactions.sparkSession.range(points).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("interaction", F.lit(0)).alias("interaction"), F.coalesce("opportunity", F.lit(0)).alias("opportunity"))


def channel_summary(channels: DataFrame) -> DataFrame:
    return channels.groupBy("channel_group").agg(_n(F.col("state") == "connected").alias("connected"), F.count("*").alias("total"))


def outreach_steps(lists: DataFrame, template: Sequence[tuple] = vocab.OUTREACH) -> DataFrame:
    """The touches of each list's plan with their dates."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(d).alias("day"), F.lit(label).alias("day_label"), F.lit(title).alias("title"), F.lit(channel).alias("channel")) for i, (d, label, title, channel) in enumerate(template)])
    return lists.select("list_id", "started_on", F.explode(steps).alias("s")).select("list_id", "s.*", F.date_add("started_on", F.col("s.day") - 1).alias("due_on"))


def source_costs(calls: DataFrame) -> DataFrame:
    return calls.groupBy("source_id", "capability").agg(F.count("*").alias("calls"), F.sum("latency_ms").cast("long").alias("latency_ms"), F.sum("cost").alias("cost"), _n(~F.col("ok")).alias("failures"))


def criteria_usage(calls: DataFrame) -> DataFrame:
    """Model calls, answers from the cache, failures, tokens."""
    own = F.col("ok") & ~F.col("cache_hit")
    return calls.agg(_n(own).alias("calls"), _n(F.col("cache_hit")).alias("cache_hits"), _n(~F.col("ok")).alias("failures"), F.coalesce(F.sum(F.when(own, F.col("tokens"))), F.lit(0)).cast("long").alias("total_tokens"))
