"""Spark ML classifier on schema-independent features, hold-out flags."""

import threading
from functools import partial

from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.classifier import (FEATURES, fit_each, fit_features, fit_pair_classifier, pair_features,
                                           predict_pairs)
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.plans.holdout import holdout_fold


def test_features_defined_for_every_schema(spark):
    feats = pair_features(fixture_pairs(spark, SF001))
    nulls = feats.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURES]).first()
    assert all(v == 0 for v in nulls)
    plan = feats._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_probabilities_and_prediction_agree(spark):
    pairs = fixture_pairs(spark, SF001)
    model = fit_pair_classifier(pairs.where("split = 'train'"), pairs.where("split = 'valid'"), max_iter=5)
    out = predict_pairs(model, pairs.where("split = 'test'"))
    bad = out.where((F.abs(F.col("proba_0") + F.col("proba_1") - 1) > 1e-9)
                    | (F.col("prediction") != (F.col("proba_1") > F.col("proba_0")).cast("int")))
    assert bad.count() == 0
    assert out.count() == pairs.where("split = 'test'").count()


def test_holdout_fold_marks_zero_shot(spark):
    pairs = fixture_pairs(spark, SF001)
    rep = holdout_fold(pairs, "cust").collect()
    assert {r.dataset for r in rep} == {"prod", "cust", "supp"}
    assert {r.dataset for r in rep if r.zero_shot} == {"cust"}


def test_a_fit_computes_its_features_once(spark):
    table = pair_features(fixture_pairs(spark, SF001).where("split <> 'test'"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    counted = table.select("split", "label", *FEATURES)
    counted = counted.mapInArrow(count, counted.schema)
    train, valid = counted.where("split = 'train'"), counted.where("split = 'valid'")
    fit_features(train, valid, max_iter=2)
    assert seen.value <= 2 * table.count()          # once on the way to train, once to valid


def test_fits_run_side_by_side_and_keep_their_order(spark):
    gate = threading.Barrier(2, timeout=60)

    def fit(i):
        gate.wait()
        return spark.range(i).count()
    assert fit_each(spark, [partial(fit, i) for i in (5, 3)]) == [5, 3]
