"""Streaming forms of the batch jobs. Late rows are those behind each job's watermark."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators.enrich import company_master, merged_master
from leadmill.operators.judge import judge
from leadmill.schemas import MASTER


def stream_judge(candidates: DataFrame, criteria: DataFrame, people: bool = False) -> DataFrame:
    """Arriving candidates (list_id, ...) judged with their list's frozen criteria (list_id, criteria): stream-static join, append."""
    return judge(candidates.join(criteria, "list_id"), people)


def stream_dedupe(entities: DataFrame, life: str | None = None) -> DataFrame:
    """Entities (run_id, name, found_at) whose name the run doesn't have yet.

    Without ``life`` a run never forgets a name, whenever it returns: the names seen are durable state of the query,
    a row per run and name, which lies on disk with Spark's RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). With it a name may return once its watermark is that much later.
    """
    if life is None:
        return entities.dropDuplicates(["run_id", "name"])
    return entities.withWatermark("found_at", life).dropDuplicatesWithinWatermark(["run_id", "name"])


#: Runs of a master of which the larger has less than this many times the rows of the smaller are merged.
GROWTH = 4


class MasterFiles:
    """A company master as runs of growing size, and a manifest that names the live ones.

    A batch adds one run; runs of similar size are merged, so a row is rewritten a number of times that grows with the
    logarithm of the master, and there are as few runs. The manifest is one file, replaced by a rename, with the last
    batch that it holds: what is read are the runs that it names, nothing is listed. A run that was written but not
    named, by a batch that broke off, is no part of the master; ``sweep`` deletes such runs. Runs that a merge
    replaces are deleted one batch later, so a reader that opened the manifest before can finish.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """batch, runs (name, rows) from the largest on, and gone: runs to delete next."""
        place = self.jvm.Path(f"{self.path}/MANIFEST")
        if not self.files.exists(place):
            return {"batch": -1, "runs": [], "gone": []}
        stream = self.files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, manifest: dict) -> None:
        """Replace the manifest in one step."""
        new = self.jvm.Path(f"{self.path}/MANIFEST.{uuid.uuid4().hex[:12]}")
        out = self.files.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self.jvm.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(self.files.makeQualified(new), self.files.makeQualified(self.jvm.Path(f"{self.path}/MANIFEST")), how)

    def read(self, runs: list[dict]) -> DataFrame:
        paths = [f"{self.path}/{r['name']}" for r in runs]
        return self.spark.read.schema(MASTER).parquet(*paths) if paths else self.spark.createDataFrame([], MASTER)

    def write(self, df: DataFrame) -> dict:
        name = f"run-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{name}")
        return {"name": name, "rows": self.read([{"name": name}]).count()}  # from the files' own counts

    def drop(self, names: list[str]) -> None:
        for name in names:
            self.files.delete(self.jvm.Path(f"{self.path}/{name}"), True)

    def add(self, new: DataFrame, batch: int) -> None:
        """The master of one batch; a batch that the manifest already holds changes nothing."""
        held = self.manifest()
        if batch <= held["batch"]:
            return
        run = self.write(new)
        runs, gone = held["runs"], []
        if run["rows"]:
            near = [run]
            while runs and runs[-1]["rows"] < GROWTH * sum(r["rows"] for r in near):
                near.append(runs.pop())
            if len(near) > 1:
                merged = self.write(merged_master(self.read(near)))
                gone = [r["name"] for r in near]
                run = merged
            runs = [*runs, run]
        else:
            gone = [run["name"]]
        self.put({"batch": batch, "runs": runs, "gone": gone})
        self.drop(held["gone"])

    def sweep(self) -> None:
        """Delete what the manifest doesn't name; not while a batch is being added."""
        held = self.manifest()
        live = {*(r["name"] for r in held["runs"]), *held["gone"]}
        if self.files.exists(self.jvm.Path(self.path)):
            self.drop([name for f in self.files.listStatus(self.jvm.Path(self.path)) if (name := f.getPath().getName()).startswith(("run-", "MANIFEST.")) and name not in live])


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The master at ``path``, a row per company; empty where there is none."""
    files = MasterFiles(spark, path)
    runs = files.manifest()["runs"]
    return files.read(runs) if len(runs) < 2 else merged_master(files.read(runs))


def stream_company_master(sightings: DataFrame, path: str, checkpoint: str):
    """Keeps the company master at ``path`` from a stream of sightings; read it by ``read_master``.

    The work of a batch follows the batch, not the master or the number of batches (``MasterFiles``); a batch that
    runs again after it broke off gives the same master.
    """
    files = MasterFiles(sightings.sparkSession, path)
    files.sweep()
    return sightings.writeStream.foreachBatch(lambda batch, number: MasterFiles(batch.sparkSession, path).add(company_master(batch), number)).option("checkpointLocation", checkpoint)


def stream_trends(interactions: DataFrame, bucket: str = "1 day", late: str = "1 day") -> DataFrame:
    """Interactions (happened_at, level) per tumbling bucket."""
    timed = interactions.withWatermark("happened_at", late).groupBy(F.window("happened_at", bucket).alias("w"))
    return timed.agg(F.count("*").alias("interaction"), F.sum((F.col("level") == "high").cast("long")).alias("opportunity")).select(F.col("w.start").alias("bucket"), "interaction", "opportunity")
