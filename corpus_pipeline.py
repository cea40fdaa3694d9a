"""The corpus pipeline: quality filter, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again as the next one's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import neardup, packing, quality, spans
from tickloom.llm.text import stored

WORD_BPE = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality.with_scores(docs, quality.train(docs, labels), "_quality_score")
    return scored.where(scored["_quality_score"] >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return neardup.without_near_duplicates(docs, size=5, over=80, under=100).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 35 words or more that also stand elsewhere; emptied texts go."""
    cut = spans.without_repeats(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"))
    changed = cut.withColumn("n_chars", F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where(~F.col("changed") | (F.trim("text") != "")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts, packed into windows."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]
#: No SQL for a trained classifier, BPE or differencing; the tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}") if number + 1 < len(STAGES) else stage(spark, docs, sf_dir)
    return docs
