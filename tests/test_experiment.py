"""E2 inputs: every fold leaves its dataset out; tests are stored once for all folds."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.attributes import attribute_pairs
from twinlink.operators.classifier import with_rule_prediction
from twinlink.plans import experiment as XP
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.session import scratch_dir

FOLDS = ["prod", "cust", "supp"]


@pytest.mark.parametrize("mix", ["row", "attr+row", "attr-row"])
def test_folds_leave_their_dataset_out(spark, mix):
    pairs = fixture_pairs(spark, SF001)
    sets = XP.hold_out_sets(pairs, FOLDS, mix, attr_pairs=attribute_pairs(pairs), predictions=with_rule_prediction)
    leaks = sets.where((F.col("fold") == F.col("dataset")) | ((F.col("fold") == "all") != (F.col("split") == "test")))
    assert leaks.count() == 0
    phases = {r.phase for r in sets.select("phase").distinct().collect()}
    assert phases == ({1, 2} if mix == "attr-row" else {1})
    if mix == "attr+row":
        dup = sets.where("split = 'train'").groupBy("fold", "text", "label").count().where("count > 1")
        assert dup.count() == 0


def test_written_inputs_and_report(spark):
    pairs = fixture_pairs(spark, SF001)
    sets = XP.hold_out_sets(pairs, FOLDS, "row", predictions=with_rule_prediction)
    path = scratch_dir(spark, "inputs")
    rep = XP.write_hold_out_inputs(sets, path, max_tokens={"train": 25, "valid": 25, "test": 10000})
    back = spark.read.parquet(path)
    total, dropped = rep.agg(F.sum("n_texts"), F.sum("n_dropped")).first()
    assert back.count() == total - dropped and dropped > 0
    assert back.where("fold = 'cust' AND dataset = 'cust'").count() == 0
    assert {r.split for r in back.where("fold = 'all'").select("split").distinct().collect()} == {"test"}


def test_attribute_sets_are_balanced_per_fold(spark):
    from twinlink.operators import assemble as D
    pairs = fixture_pairs(spark, SF001)
    ap = attribute_pairs(pairs)
    per_fold = D.read_attribute_datasets(D.all_folds(ap, FOLDS), "mode1", cap=None, by=("fold",))
    for f in FOLDS:
        alone = D.read_attribute_datasets(ap.where(F.col("dataset") != f), "mode1", cap=None)
        got = sorted(r.pair_id for r in per_fold.where(F.col("fold") == f).collect())
        assert got == sorted(r.pair_id for r in alone.collect())


def test_a_folder_is_written_by_few_tasks(spark):
    pairs = fixture_pairs(spark, SF001)
    sets = XP.hold_out_sets(pairs, FOLDS, "row", predictions=with_rule_prediction).repartition(8)
    path = scratch_dir(spark, "inputs")
    XP.write_hold_out_inputs(sets, path)
    files = [f.rsplit("/", 1)[0] for f in spark.read.parquet(path).inputFiles()]
    assert len(set(files)) == 7 and len(files) == 7     # small folders, not one file for each of 8 tasks
