"""Records and pairs are never collected for a broadcast: not in a query's own plan, nor in the plans of the tables it
writes on the way.  At sf0.01 every record file lies far below the broadcast threshold."""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from conftest import SF01
from twinlink.plans.catalog import QUERIES

TABLES = ("part.parquet", "customer.parquet", "supplier.parquet")
CHECKED = [
    "st_streaming_similarity_scores",
    "d3_attribute_sets_per_fold",
    "d3_attribute_sets_per_fold_sizes",
    "d8_attr_plus_row_balanced",
    "d9_attr_then_row_sizes",
    "e2_hold_out_attr_then_row",
    "k1_s4_pairs_roundtrip",
    "k2_s5_attribute_pairs_roundtrip",
    "k3_s6_predictions_roundtrip",
    "m5_balance_attribute_pairs",
    "m5_balance_bucketed",
    "m6_cap_attribute_pairs_sizes",
    "p6_p7_merge_price_currency",
    "r7_padded_token_report",
    "s7_test_split_pruned",
    "t8_prompts",
    "t_serialise_mode3",
    "d1_read_datasets",
    "p14_model_examples",
    "d2_read_datasets_flip_permute",
    "d10_example_texts",
    "r6_holdout_evaluation",
    "d3_attribute_datasets_sizes",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _broadcast_records(plan):
    """Scans of record tables below a broadcast, by the indentation of the plan's lines."""
    found, at = [], None
    for line in plan.splitlines():
        depth = re.search(r"[A-Za-z*(]", line).start() if re.search(r"[A-Za-z*(]", line) else 0
        if at is not None and depth <= at:
            at = None
        if at is None and "BroadcastExchange" in line:
            at = depth
        elif at is not None and any(t in line for t in TABLES):
            found.append(line.strip())
    return found


@pytest.mark.parametrize("name", CHECKED)
def test_no_broadcast_of_records(spark, monkeypatch, name):
    plans, parquet = [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        plans.append(_plan(self._df))
        return parquet(self, *args, **kwargs)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    plans.append(_plan(QUERIES[name](spark, SF01)))
    assert any("SortMergeJoin" in p for p in plans) and any(t in p for p in plans for t in TABLES)
    assert not [x for p in plans for x in _broadcast_records(p)]


def test_no_broadcast_of_records_before_a_checkpoint(spark, monkeypatch):
    """m1_sample_exact cuts its sample with a checkpoint, which no later plan shows."""
    plans, checkpoint = [], DataFrame.checkpoint

    def noted(self, *args, **kwargs):
        plans.append(_plan(self))
        return checkpoint(self, *args, **kwargs)
    monkeypatch.setattr(DataFrame, "checkpoint", noted)
    QUERIES["m1_sample_exact"](spark, SF01)
    assert plans and all("SortMergeJoin" in p and any(t in p for t in TABLES) for p in plans)
    assert not [x for p in plans for x in _broadcast_records(p)]
