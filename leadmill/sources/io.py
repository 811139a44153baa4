"""Reading and writing records and lists."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.functions import text as X
from leadmill.schemas import KINDS


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster that all executors share; a temporary one only in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def _own_folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/leadmill-{app}"
    return _FOLDERS[app]


_FOLDERS: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: what several plans read is computed once.

    The table outlives lost executors. It stays, as frames that read it may be used at any time, until ``drop_stored``.
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the tables that this application has stored; no frame may read them afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def no_nulls(df: DataFrame) -> DataFrame:
    """Nulls as the empty value of their type."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType
        empty = {T.StringType: F.lit(""), T.IntegerType: F.lit(0)}.get(type(kind))
        if isinstance(kind, T.ArrayType):
            empty = F.array().cast(kind)
        if isinstance(kind, T.MapType):
            empty = F.expr(f"cast(map() as {kind.simpleString()})")
        out.append(F.coalesce(F.col(f.name), empty).alias(f.name) if empty is not None else F.col(f.name))
    return df.select(*out)


def read_records(spark: SparkSession, path: str, kind: str, form: str = "parquet") -> DataFrame:
    """Records of a kind with their fixed schema; missing columns and nulls become empty."""
    return no_nulls(spark.read.schema(KINDS[kind]).format(form).load(path))


HINTS = ("公司", "企业", "名称", "name", "company")


def import_names(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """(pos, name) of an uploaded CSV: first column, trimmed, blanks and a header dropped, the first ``most``.

    The file is one upload, so its rows come from one task in their order.
    """
    schema = T.StructType([T.StructField("name", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=False, multiLine=True, mode="PERMISSIVE", quote='"', escape='"', enforceSchema=True)
    rows = rows.select(F.monotonically_increasing_id().alias("pos"), X.strip(F.regexp_replace(F.coalesce("name", F.lit("")), "^\\x{feff}", "")).alias("name"))
    header = (F.col("pos") == 0) & X.any_in(F.lower("name"), X.literals(HINTS))
    return rows.where((F.col("name") != "") & ~header).orderBy("pos").limit(most)


def match_uploaded(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Uploaded names with the records of the same normalised name; the first by external_id."""
    known = companies.withColumn("norm", X.normalize_name(F.col("name"))).where("norm <> ''").groupBy("norm").agg(F.min("external_id").alias("external_id"))
    return names.withColumn("norm", X.normalize_name(F.col("name"))).join(known, "norm", "left").select("pos", "name", "external_id")


def to_json_col(record):
    """A nested record as JSON text; arrays stay arrays."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def from_json_col(text, schema: str):
    """A record from JSON text; unknown keys are ignored, broken text is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def write_list(rows: DataFrame, path: str) -> None:
    """Replace all rows of the lists in ``rows``, and only of those.

    Rows are dealt by list first, so a list is a file and not one per task; Spark splits a list that is much larger than others.
    """
    rows.hint("rebalance", "list_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("list_id").parquet(path)


def load_lists(lists: DataFrame, rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """lists (list_id, status, payload) and rows (list_id, row_id, row_json, record_json, judgment_json), read back.

    A row that doesn't parse is skipped; a list whose own text, a record or a judgment is broken is skipped
    whole; running lists come back completed.
    """
    whole = "map<string, string>"
    parsed = rows.select("list_id", "row_id", from_json_col(F.col("row_json"), schema).alias("row"), (F.try_parse_json("record_json").isNotNull() & F.try_parse_json("judgment_json").isNotNull()).alias("sound"))
    broken = parsed.where(~F.col("sound")).select("list_id").distinct()
    good = lists.where(from_json_col(F.col("payload"), whole).isNotNull() & F.try_parse_json("payload").isNotNull()).join(broken, "list_id", "left_anti")
    good = good.withColumn("status", F.when(F.col("status") == "running", "completed").otherwise(F.col("status")))
    fine = parsed.join(good.select("list_id"), "list_id", "left_semi").where(F.col("row").isNotNull() & F.col("row.name").isNotNull())
    return good, fine.select("list_id", "row_id", "row.*")


def delete_list(lists: DataFrame, rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists and rows without the given lists."""
    ids = gone.select("list_id").distinct()
    return lists.join(ids, "list_id", "left_anti"), rows.join(ids, "list_id", "left_anti")


def file_order(df: DataFrame, key: str) -> DataFrame:
    """Rows numbered per key in reading order."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(F.monotonically_increasing_id())) - 1)
