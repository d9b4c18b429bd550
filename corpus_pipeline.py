"""The training-data pipeline over ``documents``: stages read what their predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next stage's docs.  Rows without a
language leave, a line found in many documents stays in the first of them only and documents that lose
all their text by it leave, one document of each near-duplicate group
stays, contaminated documents leave, and the rest is encoded.  Null ids form no group and stay."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinlink.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from twinlink.llm.frames import written


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _short_batches(spark: SparkSession) -> None:
    """Whole documents go through Python in every stage: where the session leaves Spark's default of 10,000 rows a
    batch, 1,000 bound what executors and workers hold of them at once."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return language_id.identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    out = line_dedup.line_dedup(docs, min_docs=10, keep="first")
    # Copies whose every line stands in an earlier document are left without a word; the first copy has its text.
    emptied = (F.col("n_dropped") > 0) & (F.translate(F.col("doc")["text"], line_dedup.SPACE, "") == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).select("doc.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    # An id that is repeated leaves only if none of its rows stands for its group.
    gone = (near_dedup.report(docs, percent=75).groupBy("doc_id").agg(F.max("kept").alias("kept"))
            .where("not kept").select(F.col("doc_id").alias("gone_id")))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return bpe.report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

# Trained and learned stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
