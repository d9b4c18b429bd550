"""Plan properties that matter at scale: partition pruning, column pruning, pushed
filters, native (codegen) expressions and hash aggregation on the hot paths."""

from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.attributes import attribute_pairs
from twinlink.operators.classifier import rule_predictions
from twinlink.operators.pairs import attach_predictions
from twinlink.operators.serialise import serialise
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.session import scratch_dir
from twinlink.sources.files import read_pairs, read_predictions, write_pairs, write_predictions
from twinlink.sources.fixtures import read_table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_filter_prunes_partitions(spark):
    path = scratch_dir(spark, "pairs")
    write_pairs(fixture_pairs(spark, SF001), path)
    plan = _plan(read_pairs(spark, path, dataset="prod", split="test"))
    assert "PartitionFilters: [isnotnull(dataset" in plan and "prod" in plan and "test" in plan


def test_scan_reads_only_used_columns(spark):
    plan = _plan(fixture_pairs(spark, SF001))
    assert "p_comment" not in plan and "c_address" not in plan and "s_phone" not in plan
    docs = read_table(spark, SF001, "documents").where(F.col("lang") == "en").select("doc_id")
    plan = _plan(docs)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_hot_paths_are_native_and_hash_aggregated(spark):
    pairs = fixture_pairs(spark, SF001)
    for df in (attribute_pairs(pairs), serialise(pairs, "mode4")):
        plan = _plan(df)
        assert "Python" not in plan and "SortAggregate" not in plan


def test_records_and_predictions_are_not_collected_for_a_broadcast(spark):
    pairs = fixture_pairs(spark, SF001)         # files far below the broadcast threshold
    path = scratch_dir(spark, "predictions")
    write_predictions(rule_predictions(pairs).withColumn("dataset", F.lit("all")), path)
    stored = scratch_dir(spark, "pairs")
    write_pairs(pairs, stored)
    few = read_pairs(spark, stored)
    for df, joins in ((pairs, 6), (attach_predictions(few, read_predictions(spark, path)), 1),
                      (attach_predictions(few, read_predictions(spark, path), check=False), 1)):
        plan = _plan(df)
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") == joins
