"""Incremental scoring of stored pairs (E3 / R4 as a stream).

Pairs land as Parquet files under a folder partitioned by ``dataset`` and
``split`` (K1's layout).  A file stream picks up new files, scores each pair
without state (rule or similarity matcher, the same operators as the batch
jobs) and keeps running confusion counts per dataset in Spark's state store; the
running report (counts, F1, accuracy) is rewritten to Parquet after each
micro-batch.  The source and the state are checkpointed under the session's
shared checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from twinlink.operators.report import accuracy_expr, confusion_aggs, f1_expr
from twinlink.schema import PAIR_SCHEMA


def read_pair_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Canonical pairs from a folder written by ``sources.files.write_pairs``."""
    reader = spark.readStream.schema(PAIR_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(root)


def score_stream(pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame], tasks: int | None = None) -> DataFrame:
    """Stateless: ``scorer(pairs) -> pairs + prediction`` (row-independent).  With ``tasks`` the rows of a
    micro-batch are dealt evenly to so many tasks first: a costly scorer would otherwise have one task a file."""
    return scorer(pairs.repartition(tasks) if tasks else pairs).select("pair_id", "dataset", "split", "label", "prediction")


def running_report(scored: DataFrame, by=("dataset",)) -> DataFrame:
    """Confusion counts per group, kept in the state store across micro-batches."""
    return scored.groupBy(*by).agg(*confusion_aggs())


def start_report(scored: DataFrame, report_path: str, checkpoint: str, by=("dataset",),
                 available_now: bool = True):
    """Run the running report; each micro-batch rewrites ``report_path`` with the
    complete counts plus F1 and accuracy.  Returns the ``StreamingQuery``."""
    by = list(by)

    def write(batch: DataFrame, _batch_id: int):
        (batch.select(*by, "n_pairs", "tp", "fp", "fn", "tn",
                      f1_expr().alias("f1"), accuracy_expr().alias("accuracy"))
              .write.mode("overwrite").parquet(report_path))

    w = (running_report(scored, by).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(write))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_scored_sink(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append every scored pair to Parquet, partitioned like the input."""
    w = (scored.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy("dataset", "split"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
