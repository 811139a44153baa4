"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadmill.plans import enriching, judging, recalling, reporting, texts

PARTS = (texts, judging, recalling, enriching, reporting)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
