"""M2-M6 on counts tables: members against brute force, any number of groups, two reads, folds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from twinlink.operators import assemble as D
from twinlink.operators import group_sampling as GS
from twinlink.operators import sampling as M


def _key(seed, op, i):
    return hashlib.md5(f"{seed}|{op}|{i}".encode()).hexdigest()


def _smallest(ids, k, seed, op):
    return sorted(sorted(ids, key=lambda i: (_key(seed, op, i), i))[:k])


def test_more_groups_than_any_driver_table_holds(spark):
    n = M.MAX_DRIVER_GROUPS + 1
    rows = spark.range(4 * n).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("pair_id"),
        F.concat(F.lit("d"), F.floor(F.col("id") / 4).cast("string")).alias("dataset"), F.lit("train").alias("split"),
        (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit(0).alias("prediction"))
    out = M.automl_filter(rows, small_set=2).cache()
    sizes = {(r.label, r.n): r["count"] for r in out.groupBy("dataset", "label").agg(F.count("*").alias("n"))
             .groupBy("label", "n").count().collect()}
    assert sizes == {(1, 1): n, (0, 2): n}
    for at in (0, 17, n - 1):
        got = sorted(r.pair_id for r in out.where(F.col("dataset") == f"d{at}").where("label = 0").collect())
        assert got == _smallest([f"p{4 * at + j}" for j in (1, 2, 3)], 2, 42, "automl_filter")
    out.unpersist()


def _rows(spark):
    rows = [(f"p{i}", "big" if i % 3 else None, "train", int(i % 7 == 0)) for i in range(6000)]
    rows += [(f"q{i}", "small", "train", i % 2) for i in range(50)] + [(f"x{i}", "big", "train", None) for i in range(5)]
    return rows, spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int").repartition(6)


def test_one_pos_two_neg_members_and_null_groups(spark):
    rows, df = _rows(spark)
    got = {(r.dataset, r.label): [] for r in df.collect()}
    for r in M.one_pos_two_neg(df, cap=10 ** 6).collect():
        got[r.dataset, r.label].append(r.pair_id)
    for ds in ("big", None, "small"):
        ids = {lb: [i for i, d, _, label in rows if d == ds and label == lb] for lb in (0, 1)}
        whole = len(ids[0]) + len(ids[1]) < 1200
        k = {1: len(ids[1]), 0: len(ids[0]) if whole else 2 * len(ids[1])}
        for lb in (0, 1):
            assert sorted(got[ds, lb]) == _smallest(ids[lb], k[lb], 42, "one_pos_two_neg")


@pytest.mark.parametrize("margin", [(8.0, 64), (0.0, 0), (-20.0, -50), (0.3, 1)])
def test_any_band_gives_the_same_members(spark, margin):
    rows, df = _rows(spark)
    k = {"big": 900, None: 3, "small": 50}
    sizes = GS.written(GS.counted(df, ["dataset"]).withColumn(
        "_k", F.when(F.col("dataset") == "big", 900).when(F.col("dataset").isNull(), 3).otherwise(F.col("_n")).cast("long")), "t")
    got = GS.sample_sizes(df, ["dataset"], sizes, 3, "t", margin=margin).collect()
    for ds, n in k.items():
        assert sorted(r.pair_id for r in got if r.dataset == ds) == _smallest([i for i, d, *_ in rows if d == ds], n, 3, "t")


def test_the_input_is_read_twice(spark):
    rows, df = _rows(spark)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    out = M.one_pos_two_neg(df.mapInArrow(count, df.schema)).collect()
    assert out and seen.value <= 2 * len(rows)
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()


def _attrs(spark):
    rows = [(f"a{i}", ("x", "y", "z")[i % 3], "train" if i % 4 else "valid", ("name", "price", None)[i % 11 % 3], int(i % 5 == 0)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "attr_pair_id string, dataset string, split string, attribute string, label int") \
        .withColumn("left_value", F.col("attr_pair_id")).withColumn("right_value", F.lit("r"))


@pytest.mark.parametrize("cap", [None, 100])
def test_folds_equal_copies_balanced_one_by_one(spark, cap):
    rows, df = _attrs(spark)
    folds = ["x", "y", "none"]
    one = M.balance_attribute_pairs(df, cap=cap, folds=folds).select("fold", "attr_pair_id", "label")
    two = M.balance_attribute_pairs(D.all_folds(df, folds), cap=cap, by=("fold",)).select("fold", "attr_pair_id", "label")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_rows_are_filtered_before_they_are_copied_into_folds(spark):
    _, df = _attrs(spark)
    cols = ["fold", "split", "attribute", "label"]
    sizes = GS.written(GS.counted_by_fold(df, cols[1:], ["x", "y"]).withColumn("_k", F.lit(5).cast("long")), "t")
    out = GS._candidates(df, cols, sizes, 1, "t", "attr_pair_id", GS.MARGIN, "dataset")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "size(filter(_folds" in join and "_hi" in join and plan.index("Generate inline") < plan.index(join)


def test_a_pool_that_is_too_small_raises(spark):
    df = spark.createDataFrame([(f"p{i}", "d", "train", int(i > 3)) for i in range(10)],
                               "pair_id string, dataset string, split string, label int")
    with pytest.raises(ValueError):
        M.one_pos_two_neg(df, small_set=5)
    with pytest.raises(ValueError):
        M.automl_filter(df.withColumn("prediction", F.lit(0)), small_set=5)


def test_empty_input_gives_no_rows(spark):
    df = spark.createDataFrame([], "pair_id string, dataset string, split string, label int, prediction int")
    assert M.one_pos_two_neg(df).count() == M.automl_filter(df).count() == 0


def test_a_null_prediction_is_a_wrong_one(spark):
    rows = [(f"w{i}", "d", "train", 1, None) for i in range(20)] + [(f"r{i}", "d", "train", 1, 1) for i in range(50)]
    rows += [(f"n{i}", "d", "train", 0, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int, prediction int")
    out = M.automl_filter(df, small_set=10, max_pos=30).collect()
    assert sum(r.pair_id[0] == "w" for r in out) == 20 and sum(r.pair_id[0] == "r" for r in out) == 10
