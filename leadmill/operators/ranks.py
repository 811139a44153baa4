"""Row numbers within keys of any size, and ranks that are looked up instead of counted.

A window numbers a key's rows in one task. Keys with more than ``MOST`` rows are numbered in two levels: their rows
are sorted over all tasks by a range partitioning, written once with the number of their range, numbered per range
and moved by the rows of the key in the ranges before. A boundary cuts one key at most, so the table of what to move
by has fewer rows than there are ranges, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.sources.io import stored

#: Rows of a key that one task numbers, and rows of a range of a larger key.
MOST, RANGE = 1_000_000, 500_000


def free(columns: Sequence[str], name: str) -> str:
    """The name, with underscores added until no column has it; Spark ignores case in names."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` (keys, ...) by keys that may be null; keys of the right side are dropped."""
    names = {k: free([*left.columns, *right.columns], f"right_{k}") for k in keys}
    other = right.withColumnsRenamed(names)
    on = None
    for k, name in names.items():
        on = F.col(k).eqNullSafe(F.col(name)) if on is None else on & F.col(k).eqNullSafe(F.col(name))
    return left.join(other, on, how).drop(*names.values())


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, most: int = MOST, size: int = RANGE) -> DataFrame:
    """``df`` with ``name``, the place of a row from 1 on among the rows with its keys.

    The order should be total; rows that it leaves equal are numbered in any order. Null keys are a key. Keys of up
    to ``most`` rows take one task each, larger ones a task per about ``size`` rows. One count of the keys runs at once.
    """
    plain = lambda part: part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counted = free(df.columns, "n")
    large = df.groupBy(*keys).agg(F.count("*").alias(counted)).where(F.col(counted) > most)
    rows = large.agg(F.count("*").alias("keys"), F.coalesce(F.sum(counted), F.lit(0)).alias("rows")).first()
    if not rows["keys"]:
        return plain(df)
    large = F.broadcast(large.drop(counted)) if rows["keys"] <= 100_000 else large.drop(counted)
    return plain(same_keys(df, large, keys, "left_anti")).unionByName(_in_ranges(same_keys(df, large, keys, "left_semi"), keys, order, name, -(-rows["rows"] // size)))


def _in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, ranges: int) -> DataFrame:
    part = free([*df.columns, name], "part")
    kept = stored(df.repartitionByRange(ranges, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    at = F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order))
    n, last = free([part, *keys], "n"), free([part, *keys], "before")
    counts = kept.groupBy(part, *keys).agg(F.count("*").alias(n))
    before = counts.withColumn(last, F.sum(n).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where(F.col(last).isNotNull()).drop(n)  # fewer rows than ranges
    moved = free(kept.columns, "moved")
    out = same_keys(kept.withColumn(name, at), F.broadcast(before.withColumnRenamed(last, moved)), [part, *keys], "left")
    return out.withColumn(name, (F.col(name) + F.coalesce(moved, F.lit(0))).cast("int" if ranges < 2000 else "long")).drop(part, moved)
