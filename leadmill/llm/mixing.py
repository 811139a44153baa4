"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a token budget. Whole passes over a source come first; for the rest of its budget a
document is taken when a fixed hash of its id is below the source's threshold. Tokens are summed by source
and hash bucket, the bucket in which the running sum meets the budget is the boundary, and only boundary
buckets are summed again at a finer grain until they hold one hash value. Nothing is sorted, and larger
budgets take supersets of smaller ones.

Nulls: a null text has size 0; null sources form one source, last in order; rows with a null id hash alike.
Rows that repeat an id share their decision. Empty tables give empty results; other columns are ignored, and
``resample`` keeps them, whatever their names. Very long texts count like any other. Budgets are windows over
one row per source: made for sources by the thousand, not for a source per host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.columns import col, free
from leadmill.llm.scratch import Scratch

#: A token is a run of characters other than ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
HASH_BITS, STEP_BITS = 60, 10


def token_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def unit_hash(ident):
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the total, shared by weight under caps.

    One row per source; in the order of cap per weight, the capped sources are a prefix.
    """
    order, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    out = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    out = out.withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("from", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("from"))
    # the level of the first source that isn't capped holds for all that follow
    first = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select("source", "source_size", F.when(F.col("level") > F.col("ratio"), F.col("cap").cast("double")).otherwise(F.least(first * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """rows: (source, size, h); goals: (source, ..., rest). Adds ``below``: take documents with h < below.

    ``rest`` is the budget of the partial pass. The block of rows with one hash at the boundary is taken
    when its middle is within the budget.
    """
    state = goals.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("start"))
    done = None
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        wide = F.shiftright("h", shift + STEP_BITS)
        s = state.select(F.col("source").alias("s"), "rest", "prefix", "start")
        hist = (
            rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).join(s, F.col("source").eqNullSafe(F.col("s")))
            if shift == HASH_BITS - STEP_BITS
            else rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (wide == F.col("prefix"))).groupBy("source", "rest", "start", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("end", F.col("start") + F.sum("n").over(run))
        edge = hist.where("end > rest").groupBy("source").agg(F.min(F.struct("bucket", "n", "lo", "hi", "end", "rest")).alias("e")).select("source", "e.*")
        edge = scratch.write(edge.withColumn("begin", F.col("end") - F.col("n")), f"boundary{shift}")
        single = edge.where("lo = hi").select("source", F.when(F.col("begin") + F.col("n") / 2 <= F.col("rest"), F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))
        done = single if done is None else done.union(single)
        state = edge.where("lo < hi").select("source", "rest", F.col("bucket").alias("prefix"), F.col("begin").alias("start"))
        if not state.limit(1).count():
            break
    found = done.select(F.col("source").alias("s"), "below")
    return goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("below", F.coalesce("below", F.lit(1 << HASH_BITS)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), token_count(col(text_col)).alias("size"), unit_hash(col(id_col)).alias("h"))


def _goals(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, source_size, target, passes, below) of each source: whole passes, and the hash below which one more copy is taken."""
    goals = scratch.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    goals = scratch.write(thresholds(rows, goals, scratch), "thresholds")
    return goals.select(F.col("source").alias("s"), "source_size", "target", "passes", "below")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; taken is a multiple of size, up to ``most``."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_sized(docs, id_col, text_col, source_col), "sizes")
    g = _goals(rows, scratch, weights, most)
    taken = F.col("size") * F.least(F.col("passes") + (F.col("h") < F.col("below")).cast("long"), F.lit(most))
    return rows.join(g, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; rows without tokens go. Texts stay where they are."""
    scratch = Scratch(docs.sparkSession, "mix")
    own, passes, below, n, copy = free(docs.columns, "__source", "__passes", "__below", "__times", "__copy")
    g = _goals(scratch.write(_sized(docs, id_col, text_col, source_col), "sizes"), scratch, weights, most).select(F.col("s").alias(own), F.col("passes").alias(passes), F.col("below").alias(below))
    times = F.least(F.col(passes) + (unit_hash(col(id_col)) < F.col(below)).cast("long"), F.lit(most)).cast("int")
    taken = docs.where(token_count(col(text_col)) > 0).join(g, col(source_col).eqNullSafe(F.col(own))).withColumn(n, times).where(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*map(col, docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, source_size * 3 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS free FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN level > ratio THEN cap::DOUBLE ELSE least(free * w, cap::DOUBLE) END AS target FROM l LEFT JOIN f ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS block
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * least(passes + CASE WHEN (upto - block)::DOUBLE + block::DOUBLE / 2 <= rest THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM c
"""
