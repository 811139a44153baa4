"""Tables of lists that are replaced in one step: buckets of files and numbered manifests."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.operators.ranks import free


class Conflict(RuntimeError):
    """Another writer was first."""


class ListStore:
    """Lists (rows with a list_id) under a path, dealt to buckets by the hash of their id.

    Data lies in ``v-<name>/bucket=<n>``; a manifest names the folder of every bucket. Replacing lists rewrites their buckets
    in a new folder and then adds the next manifest, by a rename that fails where one of that number exists: a reader sees
    all lists as before or all as after, a writer that comes second starts again on what the first left, and one that broke
    off changed nothing. Files follow buckets, not lists or tasks; a bucket far larger than the others is split over tasks.

    A frame that was read stays readable until ``keep`` further replacements. What no manifest names, left by
    writers that broke off, goes by ``sweep``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.buckets, self.keep = spark, path.rstrip("/"), buckets, keep
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self._at(""))] if self.files.exists(self._at("")) else []

    def versions(self) -> list[int]:
        """The numbers of the manifests at hand, ascending."""
        return sorted(int(n[9:]) for n in self._names() if re.fullmatch(r"manifest-\d{12}", n))

    def manifest(self, version: int | None = None) -> dict:
        """version, buckets, schema and the folder of each bucket; of the last version where none is given."""
        if version is None:
            have = self.versions()
            if not have:
                return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}}
            version = have[-1]
        stream = self.files.open(self._at(f"manifest-{version:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Add the manifest under its number, or raise Conflict where that number is taken."""
        new = self._at(f"new-{uuid.uuid4().hex[:12]}")
        out = self.files.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self.jvm.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        target = self._at(f"manifest-{manifest['version']:012d}")
        try:
            context.rename(self.files.makeQualified(new), self.files.makeQualified(target), none)
        except Exception as e:
            self.files.delete(new, False)
            if self.files.exists(target):
                raise Conflict(f"version {manifest['version']} exists") from e
            raise

    def _read(self, held: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        paths = [f"{self.path}/{folder}" for k, folder in sorted(held["folders"].items()) if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, lists: list[str] | None = None) -> DataFrame:
        """All lists, or the given ones, whose buckets alone are opened."""
        held = self.manifest()
        if held["schema"] is None:
            raise FileNotFoundError(f"no lists at {self.path}")
        if lists is None:
            return self._read(held)
        ids = self.spark.createDataFrame([(x,) for x in lists], T.StructType([T.StructType.fromJson(held["schema"])["list_id"]]))
        buckets = {r[0] for r in ids.select(self._bucket(held)).distinct().collect()}
        return self._read(held, buckets).join(F.broadcast(ids.distinct()), "list_id", "left_semi")

    @staticmethod
    def _bucket(held: dict):
        return F.pmod(F.xxhash64("list_id"), F.lit(held["buckets"])).cast("int")

    def replace(self, rows: DataFrame, lists: DataFrame | None = None, tries: int = 8) -> int:
        """Replace all rows of ``lists`` (list_id), by default the lists in ``rows``, by ``rows``; the new version's number.

        Rows are computed once. Lists of ``rows`` are always among the replaced; ``lists`` without rows are deleted. Columns are those
        of the first replacement, others raise. A null list_id is a list like others.
        """
        staged = f"staged-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{staged}/rows")
        new = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{staged}/rows")
        ids = new.select("list_id")
        if lists is not None:
            ids = ids.union(lists.select(F.col("list_id").cast(new.schema["list_id"].dataType)))
        ids.distinct().write.parquet(f"{self.path}/{staged}/lists")
        gone = self.spark.read.schema(ids.schema).parquet(f"{self.path}/{staged}/lists")
        try:
            for left in reversed(range(tries)):
                try:
                    return self._replace(new, gone)
                except Conflict:
                    if not left:
                        raise
        finally:
            self.files.delete(self._at(staged), True)

    def _replace(self, new: DataFrame, gone: DataFrame) -> int:
        held = self.manifest()
        schema = new.schema if held["schema"] is None else T.StructType.fromJson(held["schema"])
        if {(f.name, f.dataType) for f in schema} != {(f.name, f.dataType) for f in new.schema}:
            raise ValueError(f"lists have {schema.simpleString()}, rows {new.schema.simpleString()}")
        touched = {r[0] for r in gone.select(self._bucket(held)).distinct().collect()}  # at most a number per bucket
        replaced = gone.select(F.col("list_id").alias("id"))
        kept = self._read({**held, "schema": schema.jsonValue()}, touched)
        kept = kept.join(replaced, kept["list_id"].eqNullSafe(replaced["id"]), "left_anti")
        bucket, folder = free(schema.names, "bucket"), f"v-{uuid.uuid4().hex[:12]}"
        dealt = kept.unionByName(new).withColumn(bucket, self._bucket(held))
        dealt.hint("rebalance", bucket).write.partitionBy(bucket).parquet(f"{self.path}/{folder}")
        made = {n.rsplit("=", 1)[1]: f"{folder}/{n}" for f in self.files.listStatus(self._at(folder)) if (n := f.getPath().getName()).startswith(f"{bucket}=")}
        folders = {k: f for k, f in held["folders"].items() if int(k) not in touched} | made
        version = held["version"] + 1
        try:
            self.commit({"version": version, "buckets": held["buckets"], "schema": schema.jsonValue(), "folders": folders})
        except Conflict:
            self.files.delete(self._at(folder), True)
            raise
        self._forget(version - self.keep)
        return version

    def _forget(self, oldest: int) -> None:
        """Delete manifests before ``oldest`` with the folders that no later one names."""
        have = self.versions()
        old = [v for v in have if v < oldest]
        if not old:
            return
        live = {f for v in have if v >= oldest for f in self.manifest(v)["folders"].values()}
        for v in old:
            for folder in set(self.manifest(v)["folders"].values()) - live:
                self.files.delete(self._at(folder), True)
            self.files.delete(self._at(f"manifest-{v:012d}"), False)

    def sweep(self) -> None:
        """Delete all that no manifest names; not while lists are being replaced."""
        live = {f.split("/")[0] for v in self.versions() for f in self.manifest(v)["folders"].values()}
        for name in self._names():
            if name.startswith(("v-", "staged-", "new-")) and name not in live:
                self.files.delete(self._at(name), True)
