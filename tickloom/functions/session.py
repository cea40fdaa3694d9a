"""Session-level helpers: checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; set one only where none is named (tests)."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    current = spark.sparkContext.getCheckpointDir()
    if named and current is None:
        spark.sparkContext.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so a lost executor re-reads files instead of the whole plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: lineage ends there.

    All later readings see the same rows in the same partitions of files. The files go when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    return (named or ensure_checkpoint_dir(spark)).rstrip("/")


def in_ranges(df: DataFrame, order: list, name: str = "ranges") -> DataFrame:
    """``df`` cut into ranges of ``order`` by one exchange on sampled splitters, sorted and stored; ``_at`` tells the place.

    The upper bits of ``_at`` are the number of the range, the lower 33 the row's place in it. As ``order`` also decides which
    rows may part, equal rows stay together: end it with a column that tells copies apart where those can be many.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # stored, as a second exchange would sample other splitters
    return stored(ranged.withColumn("_at", F.monotonically_increasing_id()), name)
