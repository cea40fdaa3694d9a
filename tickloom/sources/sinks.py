"""Sinks: upsert, partitioned Parquet, versioned runs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.cleaning import keep_last


def merge_latest(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both frames, the new one winning on equal keys."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in new.columns if c not in keys]
    return keep_last(both, keys, [F.col("_v"), *rest]).drop("_v")


def upsert(new: DataFrame, path: str, keys: Sequence[str], by: str) -> None:
    """Merge ``new`` into a Parquet tree partitioned by ``by``, rewriting only the partitions it touches.

    The merged partitions are written to a staging folder of this call first and swapped in by dynamic overwrite, so the table is
    never read and replaced in the same job. For several writers, or readers meanwhile, see ``published``.
    """
    spark = new.sparkSession
    try:
        current = spark.read.parquet(path)
    except AnalysisException:
        new.write.partitionBy(by).parquet(path)
        return
    touched = new.select(by).distinct()
    merged = merge_latest(current.join(touched, by, "left_semi"), new, keys)
    staging = f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}"
    merged.write.partitionBy(by).parquet(staging)
    staged = spark.read.schema(merged.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Zstd Parquet by partition columns; rows of a partition are not gathered into one task."""
    df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_run(df: DataFrame, base: str, run_id: str) -> None:
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/run_id={run_id}")


def latest_run(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the run with the greatest id; the id is a partition column, so other runs are not scanned."""
    runs = spark.read.option("inferSchema", True).parquet(base)
    newest = runs.select(F.max("run_id").alias("m"))
    # a one-row table
    return runs.join(F.broadcast(newest), F.col("run_id").cast("string") == F.col("m").cast("string")).drop("m", "run_id")
