"""R2-R5, R7, U7 and J3."""

import pytest
from pyspark.sql import functions as F

from twinlink.operators.report import mean_f1, metrics_report, token_cost_report, usd_per_1k_tokens
from twinlink.operators.score import argmax_class
from twinlink.operators.pairs import attach_predictions


def test_f1_zero_when_undefined(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("b", 1, 1), ("b", 0, 1), ("b", 1, 0)],
                               "dataset string, prediction int, label int")
    rep = {r.dataset: r for r in metrics_report(df).collect()}
    assert rep["a"].f1 == 0.0 and rep["a"].accuracy == 1.0
    assert rep["b"].f1 == pytest.approx(0.5) and rep["b"].accuracy == pytest.approx(1 / 3)
    assert mean_f1(metrics_report(df)).first().mean_f1 == pytest.approx(0.25)


def test_rule_report_matches_fixture_numbers(spark):
    import __spark_entry__ as E
    from conftest import SF01
    rep = {r.dataset: r.f1 for r in E.queries()["r4_rule_report"](spark, SF01).collect()}
    assert rep == {"prod": 0.8953168044077136, "cust": 0.90234375, "supp": 0.8333333333333334}


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9],), ([2.0, 1.0],)], "l array<float>")
    assert [r.c for r in df.select(argmax_class("l").alias("c")).collect()] == [1, 0]


def test_cost_formula():
    assert usd_per_1k_tokens(26721, 8) == pytest.approx(19.22 / (26721 * 8 * 3600) * 1000)


def test_attach_predictions_requires_each_pair(spark):
    pairs = spark.createDataFrame([("p1", 1), ("p2", 0)], "pair_id string, label int")
    preds = spark.createDataFrame([("p1", 1)], "pair_id string, prediction int")
    with pytest.raises(Exception, match="no prediction"):
        attach_predictions(pairs, preds).collect()
    twice = spark.createDataFrame([("p1", 1), ("p2", 0), ("p2", 1)], "pair_id string, prediction int")
    with pytest.raises(Exception, match="more than one prediction"):
        attach_predictions(pairs, twice).collect()
    ok = spark.createDataFrame([("p1", 1), ("p2", 0)], "pair_id string, prediction int")
    assert sorted(tuple(r) for r in attach_predictions(pairs, ok).collect()) == [("p1", 1, 1), ("p2", 0, 0)]


def test_metrics_do_not_depend_on_row_order_or_partitioning(spark):
    import random
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c"]), rng.randint(0, 1), rng.randint(0, 1), i) for i in range(500)]
    df = spark.createDataFrame(rows, "dataset string, prediction int, label int, i int")
    base = sorted(tuple(r) for r in metrics_report(df).collect())
    for other in (df.repartition(7), df.orderBy(F.col("i").desc()), df.coalesce(1)):
        assert sorted(tuple(r) for r in metrics_report(other).collect()) == base
