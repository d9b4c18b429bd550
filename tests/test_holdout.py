"""All folds scored in one pass, phases, labels carried, rows without a prediction."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.attributes import attribute_pairs
from twinlink.operators.classifier import (attribute_examples, feature_table, fit_pair_classifier, predict_pairs,
                                           with_rule_prediction)
from twinlink.operators.report import metrics_report
from twinlink.plans import holdout as H
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.tables import written

DATASETS = ["prod", "cust", "supp"]


@pytest.fixture(scope="module")
def pairs(spark):
    return fixture_pairs(spark, SF001)


def test_labels_are_carried_and_nothing_is_joined_after_scoring(spark, pairs):
    stored = written(pairs, "t")
    model = fit_pair_classifier(stored.where("split = 'train'"), max_iter=2)
    out = predict_pairs(model, stored.where("split = 'test'"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r.pair_id: r.label for r in pairs.where("split = 'test'").collect()}
    assert {r.pair_id: r.label for r in out.collect()} == want


def test_one_scan_serves_all_folds_and_phases_and_equals_single_models(spark, pairs):
    rows = written(feature_table(pairs), "rows")
    attrs = written(feature_table(attribute_examples(attribute_pairs(pairs).withColumn("fold", F.explode(F.array(
        *[F.lit(d) for d in DATASETS]))).where("fold <> dataset")), "fold"), "attrs")
    tests = rows.where("split = 'test'")
    models = {d: H.fold_models(rows, attrs, d, "attr-row", max_iter=2) for d in ("prod", "supp")}
    out = H.score_folds(tests, models)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    got = {(r.fold, r.phase, r.pair_id): (r.prediction, round(r.proba_1, 12)) for r in out.collect()}
    assert len(got) == 4 * tests.count()
    for fold, phases in models.items():
        for phase, chain in phases:
            own = tests
            for m in chain[:-1]:
                own = H._with_first(m, own)
            for r in H.score_features(chain[-1], own, "p").collect():
                assert got[fold, phase, r.pair_id] == (r.p.prediction, round(r.p.proba_1, 12))


def test_mixes_need_their_inputs(spark, pairs):
    with pytest.raises(ValueError):
        H.holdout_predictions(pairs, DATASETS, "one_pos_two_neg", mix="attr+row")
    with pytest.raises(ValueError):
        H.holdout_predictions(pairs, DATASETS, "one_pos_two_neg", mix="rows")


def test_equal_records_of_both_kinds_train_once(spark):
    rows = [("a", "d", "train", 1, [("n", "x", "y", False)]), ("b", "d", "train", 1, [("n", "x", "y", False)]),
            ("c", "d", "train", 0, [("n", "x", "y", False)]), ("e", "d", "train", 1, [("n", "x", None, False)])]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int, "
                                     "attrs array<struct<name:string,left:string,right:string,numeric:boolean>>")
    assert feature_table(df).dropDuplicates(["content", "label"]).count() == 3


def test_report_marks_the_held_out_dataset(spark, pairs):
    rep = H.holdout_evaluation(pairs, ["cust"], predictions=with_rule_prediction, max_iter=2).collect()
    assert {(r.fold, r.phase, r.dataset, r.zero_shot) for r in rep} == {("cust", 1, d, d == "cust") for d in DATASETS}


def test_rows_without_a_prediction_fail_the_report(spark):
    df = spark.createDataFrame([("d", 1, 1), ("d", None, 1)], "dataset string, prediction int, label int")
    with pytest.raises(Exception, match="without prediction"):
        metrics_report(df).collect()
