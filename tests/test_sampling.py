"""M1-M7: exact sizes, branches, determinism, bounded plans."""

import math

import pytest
from pyspark.sql import functions as F

from twinlink.operators import sampling as M


def _pairs(spark, n_pos, n_neg, ds="d"):
    rows = [(f"{ds}|{i}", ds, "train", 1 if i < n_pos else 0) for i in range(n_pos + n_neg)]
    return spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int")


def test_small_set_boundary(spark):
    kept = M.one_pos_two_neg(_pairs(spark, 100, 1099))          # 1199 rows -> whole
    assert kept.count() == 1199
    sampled = M.one_pos_two_neg(_pairs(spark, 100, 1100))       # 1200 rows -> sampled
    c = {r.label: r["count"] for r in sampled.groupBy("label").count().collect()}
    assert c == {1: 100, 0: 200}


def test_capped_branch_exact_size_and_deterministic(spark):
    df = _pairs(spark, 700, 2000)
    a = M.one_pos_two_neg(df)
    b = M.one_pos_two_neg(df.repartition(5))
    assert a.count() == 1200
    assert sorted(r.pair_id for r in a.collect()) == sorted(r.pair_id for r in b.collect())


def test_raises_when_pool_too_small(spark):
    with pytest.raises(ValueError):
        M.one_pos_two_neg(_pairs(spark, 700, 600))


def test_sample_exact_fallback_recovers_short_groups(spark):
    df = _pairs(spark, 0, 5000)
    # a negative margin makes the key threshold too tight; the check must recompute exactly
    got = M.sample_groups(df.where(F.lit(True)), ["dataset"], {("d",): 300}, {("d",): 5000}, 3, "t",
                          margin_sd=-20.0, margin_rows=-200)
    ref = M.sample_groups(df, ["dataset"], {("d",): 300}, {("d",): 5000}, 3, "t")
    assert got.count() == 300
    assert sorted(r.pair_id for r in got.collect()) == sorted(r.pair_id for r in ref.collect())


def test_threshold_keeps_plan_bounded(spark):
    df = _pairs(spark, 0, 20000).withColumn("_key", F.md5("pair_id"))
    out = M.take_smallest(df, ["dataset"], {("d",): 100}, {("d",): 20000}, "_key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert out.count() == 100


def _hard(spark, wrong, right, neg):
    rows = ([(f"w{i}", "d", "train", 1, 0) for i in range(wrong)]
            + [(f"r{i}", "d", "train", 1, 1) for i in range(right)]
            + [(f"n{i}", "d", "train", 0, 0) for i in range(neg)])
    return spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int, prediction int")


def test_hard_positives_more_than_n(spark):
    out = M.automl_filter(_hard(spark, 500, 300, 1500)).collect()
    pos = [r for r in out if r.label == 1]
    assert len(pos) == 400 and all(r.pair_id.startswith("w") for r in pos)
    assert sum(r.label == 0 for r in out) == 800


def test_hard_positives_topped_up(spark):
    out = M.automl_filter(_hard(spark, 150, 300, 1500)).collect()
    pos = [r for r in out if r.label == 1]
    assert len(pos) == 400 and sum(r.pair_id.startswith("w") for r in pos) == 150


def _attrs(spark, counts):
    rows = []
    for (attr, label), n in counts.items():
        rows += [(f"{attr}{label}#{i}", "d", "train", attr, str(i), str(i), label) for i in range(n)]
    return spark.createDataFrame(rows, "attr_pair_id string, dataset string, split string, attribute string, "
                                       "left_value string, right_value string, label int")


def test_balance_one_label_group_kept_and_capped(spark):
    df = _attrs(spark, {("a", 0): 50, ("a", 1): 7, ("b", 1): 30, ("c", 0): 900, ("c", 1): 1000})
    bal = M.balance_attribute_pairs(df, cap=None)
    c = {(r.attribute, r.label): r["count"] for r in bal.groupBy("attribute", "label").count().collect()}
    assert c == {("a", 0): 7, ("a", 1): 7, ("b", 1): 30, ("c", 0): 900, ("c", 1): 900}
    capped = M.balance_attribute_pairs(df, cap=800)
    sizes = {r.attribute: r["count"] for r in capped.groupBy("attribute").count().collect()}
    assert sizes == {"a": 14, "b": 30, "c": 800}


def test_validation_subsample(spark):
    df = _pairs(spark, 0, 2500)
    assert M.validation_subsample(df, 0).count() == 2000
    e0 = {r.pair_id for r in M.validation_subsample(df, 0).collect()}
    e1 = {r.pair_id for r in M.validation_subsample(df, 1).collect()}
    assert e0 != e1
    assert M.validation_subsample(_pairs(spark, 0, 100), 0).count() == 100


def test_sample_exact_many_groups_distributed_path(spark):
    rows = [(f"g{i % 40}|{i}", f"g{i % 40}" if i % 40 else None, "train", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int")
    driver = M.sample_exact(df, 7, seed=5, op="t", by=["dataset"])
    dist = M.sample_exact(df, 7, seed=5, op="t", by=["dataset"], max_driver_groups=3)
    assert dist.count() == 40 * 7
    assert sorted(r.pair_id for r in dist.collect()) == sorted(r.pair_id for r in driver.collect())
    with pytest.raises(ValueError):
        M.sample_exact(df, 101, seed=5, op="t", by=["dataset"], max_driver_groups=3)


def test_group_counts_collect_is_bounded(spark):
    df = spark.range(50).withColumnRenamed("id", "g")
    with pytest.raises(M.TooManyGroups):
        M.group_counts(df, ["g"], max_groups=10)


def test_large_k_bucket_path_equals_threshold_path(spark):
    rows = [(f"g{i % 3}|{i}", f"g{i % 3}", "train", 0) for i in range(9000)]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int")
    k, n = {("g0",): 2500, ("g1",): 1, ("g2",): 3000}, {("g0",): 3000, ("g1",): 3000, ("g2",): 3000}
    small = M.sample_groups(df, ["dataset"], k, n, 9, "t", large_k=10 ** 9)
    large = M.sample_groups(df, ["dataset"], k, n, 9, "t", large_k=0)
    assert sorted(r.pair_id for r in small.collect()) == sorted(r.pair_id for r in large.collect())
    assert large.count() == 5501
    # ungrouped
    a = M.sample_groups(df, [], {(): 4000}, {(): 9000}, 9, "u", large_k=10 ** 9)
    b = M.sample_groups(df, [], {(): 4000}, {(): 9000}, 9, "u", large_k=0)
    assert sorted(r.pair_id for r in a.collect()) == sorted(r.pair_id for r in b.collect())


def test_bucket_digits():
    assert M._bucket_digits(10) == 1
    assert 16 ** M._bucket_digits(10 ** 12) * M.BUCKET_ROWS >= 10 ** 12


def test_sampler_leaves_a_callers_cache_alone(spark):
    df = _pairs(spark, 700, 2000).groupBy("pair_id", "dataset", "split", "label").count().drop("count")
    df.cache()
    df.count()
    M.one_pos_two_neg(df)
    assert df.storageLevel.useMemory
    df.unpersist()


def test_large_pool_draws(monkeypatch):
    rng = M._rng(1, "t")
    for sizes in ([10 ** 12, 2 * 10 ** 12], [10 ** 12] * 3):
        means = [sum(x) / 200 for x in zip(*(M._draw(rng, sizes, 1200, many=True) for _ in range(200)))]
        assert sum(means) == pytest.approx(1200)
        assert all(abs(m - 1200 * s / sum(sizes)) < 6 for m, s in zip(means, sizes))
    monkeypatch.setattr(M, "NUMPY_POOL", 0)
    draws = [M._draw(rng, [6, 4], 5) for _ in range(4000)]
    assert all(a <= 6 and b <= 4 and a + b == 5 for a, b in draws)
    exact = {a: math.comb(6, a) * math.comb(4, 5 - a) / math.comb(10, 5) for a in range(1, 6)}
    assert all(abs(sum(d[0] == a for d in draws) / 4000 - p) < 0.04 for a, p in exact.items())


def test_evaluation_rows_are_capped_only_on_request(spark):
    train = _attrs(spark, {("c", 0): 900, ("c", 1): 1000})
    df = train.unionByName(train.withColumn("split", F.lit("valid")).withColumn("attr_pair_id", F.concat(F.lit("v"), "attr_pair_id")))
    for options, most in (({}, 1800), ({"eval_cap": 500}, 500)):
        out = M.balance_attribute_pairs(df, **options).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in out} == {"train": 800, "valid": most}
