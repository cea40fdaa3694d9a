"""Tables that change by publishing a manifest: readers see one whole version, writers do not undo each other.

A table is a folder with ``data/`` and ``manifest/``. Data folders are written under names of their own and never touched
again; a version is a small JSON file that maps each partition to its folder, put in place by a rename that fails where the
version exists already. A writer that loses the race looks at the version that won: it merges again if that one touched its
partitions, otherwise it publishes on top of it. A version also keeps the last batch of each stream, so a replayed batch
changes nothing. The manifest holds one entry for each partition, whatever the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.sinks import merge_latest

EMPTY = {"version": 0, "partitions": {}, "batches": {}, "by": None, "schema": None}


class Manifests:
    """The versions of one table, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self._path(f"{self.path}/manifest")
        self.files = self.folder.getFileSystem(self.conf)

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def newest(self) -> dict:
        """The last version published; an empty one before the first."""
        if not self.files.exists(self.folder):
            return dict(EMPTY)
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return dict(EMPTY)
        source = self.files.open(self._path(f"{self.path}/manifest/{max(numbers):012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def publish(self, manifest: dict) -> bool:
        """Put ``manifest`` in place as its version; False where another writer was first."""
        draft = self._path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        never_over = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(self._path(f"{self.path}/manifest/{manifest['version']:012d}.json")), never_over)
            return True
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in str(problem.java_exception.getClass().getName()):
                raise
            self.files.delete(draft, False)
            return False


def read_published(spark: SparkSession, path: str, manifest: dict | None = None, only: Sequence[str] | None = None) -> DataFrame | None:
    """The newest version (or the one given), of the partitions ``only``; None before the first."""
    manifest = manifest or Manifests(spark, path).newest()
    if manifest["schema"] is None:
        return None
    schema = _schema(manifest["schema"])
    folders = sorted({f for value, f in manifest["partitions"].items() if only is None or value in only})
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{f}" for f in folders])


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def upsert_published(new: DataFrame, path: str, keys: Sequence[str], by: str, batch: tuple[str, int] | None = None, before_publish=None) -> int:
    """Merge ``new`` into the table, equal ``keys`` replaced, and return the version that holds it.

    ``by`` is the partition column and one of a row's own; only partitions that ``new`` touches are read and written. With
    ``batch``, a stream's name and number, a batch that is published already changes nothing.
    """
    spark = new.sparkSession
    table = Manifests(spark, path)
    new = new.persist()
    try:
        touched = sorted(str(r[0]) for r in new.select(F.col(by).cast("string")).distinct().collect())  # partitions, not rows
        base, written = table.newest(), None
        while True:
            if batch and base["batches"].get(batch[0], -1) >= batch[1]:
                return base["version"]
            held = {v: base["partitions"].get(v) for v in touched}
            if written is None or written[0] != held:
                written = held, _write(new, read_published(spark, path, base, touched) if base["schema"] else None, table.path, keys, by, touched)
            folders, schema = written[1]
            manifest = {
                "version": base["version"] + 1, "partitions": base["partitions"] | folders, "by": by, "schema": schema,
                "batches": base["batches"] | ({batch[0]: batch[1]} if batch else {}),
            }
            if before_publish:
                before_publish()
            if table.publish(manifest):
                return manifest["version"]
            base = table.newest()
    finally:
        new.unpersist()


def _write(new: DataFrame, current: DataFrame | None, path: str, keys: Sequence[str], by: str, touched: list[str]) -> tuple[dict, str]:
    """Write the merged partitions under a name of their own: partition value to folder, and the schema."""
    merged = new if current is None else merge_latest(current, new, keys)
    run = uuid.uuid4().hex
    # the column itself stays in the files; folders go by a copy
    folder = F.concat(F.lit("p"), F.sha2(F.coalesce(F.col(by).cast("string"), F.lit("None")), 256))
    merged.withColumn("_folder", folder).write.partitionBy("_folder").parquet(f"{path}/data/{run}")
    names = {r[0]: r[1] for r in new.select(F.coalesce(F.col(by).cast("string"), F.lit("None")), folder).distinct().collect()}
    return {v: f"{run}/_folder={names[v]}" for v in touched}, merged.schema.json()


def start_upsert(stream: DataFrame, path: str, keys: Sequence[str], by: str, checkpoint: str, name: str, every: str | None = "10 seconds"):
    """Merge a stream batch by batch; ``name`` tells its batches from another stream's. ``every=None`` drains and stops."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: upsert_published(batch, path, keys, by, (name, number)) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def publish_run(df: DataFrame, base: str, run_id: str) -> None:
    """Write a run's rows, then publish them: a reader sees all rows of a run or none."""
    spark = df.sparkSession
    table, folder = Manifests(spark, base), f"{run_id}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table.path}/data/{folder}")
    while True:
        newest = table.newest()
        runs = newest["partitions"] | {run_id: folder}
        if table.publish({"version": newest["version"] + 1, "partitions": runs, "by": "run_id", "schema": newest["schema"], "batches": newest["batches"] | {f"schema {run_id}": df.schema.json()}}):
            return


def published_run(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame | None:
    """Rows of a run, without one named those of the greatest id; other runs are neither listed nor read."""
    newest = Manifests(spark, base).newest()
    if not newest["partitions"]:
        return None
    run_id = run_id or max(newest["partitions"])
    return spark.read.schema(_schema(newest["batches"][f"schema {run_id}"])).parquet(f"{base.rstrip('/')}/data/{newest['partitions'][run_id]}")
