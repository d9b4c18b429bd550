"""Pair classifiers producing prediction tables ``pair_id, prediction, proba_0, proba_1``.

``rule_predictions`` is a native rule (one attribute equal ignoring case); it
stands in for a trained model where a deterministic predictor is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attr_value(attrs: Column, name: str, side: str) -> Column:
    """Value of attribute ``name`` on ``side``; null when the dataset lacks it."""
    return F.get(F.filter(attrs, lambda a: a["name"] == F.lit(name)), 0)[side]


def _rule(attribute: str) -> Column:
    a = F.col("attrs")
    same = F.coalesce(F.lower(attr_value(a, attribute, "left")) == F.lower(attr_value(a, attribute, "right")),
                      F.lit(False))
    return same.cast("int")


def rule_predictions(pairs: DataFrame, attribute: str = "name") -> DataFrame:
    """A prediction table ``pair_id, prediction, proba_0, proba_1`` from the rule."""
    pred = _rule(attribute)
    return pairs.select("pair_id", pred.alias("prediction"),
                        (1 - pred).cast("double").alias("proba_0"), pred.cast("double").alias("proba_1"))


def with_rule_prediction(pairs: DataFrame, attribute: str = "name") -> DataFrame:
    """The rule as an inline scorer: ``pairs`` plus ``prediction`` (no join)."""
    return pairs.withColumn("prediction", _rule(attribute))


# --- U3-U5: Spark ML pair classifier on schema-independent native features ---

from functools import partial, reduce  # noqa: E402
from multiprocessing.pool import ThreadPool  # noqa: E402
from typing import Callable  # noqa: E402

from pyspark import inheritable_thread_target  # noqa: E402
from pyspark.ml import Pipeline  # noqa: E402
from pyspark.ml.classification import GBTClassifier  # noqa: E402
from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from twinlink.functions.nulls import is_null_token  # noqa: E402
from twinlink.tables import written  # noqa: E402

PARALLEL_FITS = 3

FEATURES = ["f_equal", "f_contains", "f_one_null", "f_both_null",
            "f_lev_mean", "f_lev_min", "f_lev_max", "f_jac_mean", "f_jac_min", "f_jac_max",
            "f_num_close", "f_n_attrs"]


def _attr_scores(a):
    l, r = F.lower(a["left"]), F.lower(a["right"])
    ln, rn = is_null_token(a["left"]), is_null_token(a["right"])
    present = ~ln & ~rn
    longest = F.greatest(F.length(l), F.length(r), F.lit(1))
    lev = F.when(present, 1.0 - F.levenshtein(l, r).cast("double") / longest.cast("double")).otherwise(0.0)
    tl, tr = F.split(l, "\\s+"), F.split(r, "\\s+")
    union = F.size(F.array_union(tl, tr))
    jac = F.when(present & (union > 0),
                 F.size(F.array_intersect(tl, tr)).cast("double") / union.cast("double")).otherwise(0.0)
    xl, xr = a["left"].try_cast("double"), a["right"].try_cast("double")
    close = F.when(a["numeric"] & xl.isNotNull() & xr.isNotNull(),
                   (F.abs(xl - xr) <= F.lit(1e-6) * F.greatest(F.abs(xl), F.abs(xr), F.lit(1.0))).cast("double"))
    return F.struct(
        F.when(present & (l == r), 1.0).otherwise(0.0).alias("eq"),
        F.when(present & (F.contains(l, r) | F.contains(r, l)), 1.0).otherwise(0.0).alias("ct"),
        F.when(ln != rn, 1.0).otherwise(0.0).alias("on"),
        F.when(ln & rn, 1.0).otherwise(0.0).alias("bn"),
        lev.alias("lev"), jac.alias("jac"), close.alias("nc"))


def _mean(arr, field):
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x[field])
    return F.when(F.size(arr) > 0, total / F.size(arr)).otherwise(0.0)


def pair_features(pairs: DataFrame) -> DataFrame:
    """Per-attribute similarities (equal, contained, nulls, Levenshtein ratio, token
    Jaccard, numeric closeness) folded into mean/min/max over attributes, so pairs of
    datasets with different schemas share one feature space."""
    d = pairs.withColumn("_s", F.transform("attrs", _attr_scores))
    s = F.col("_s")
    lev, jac = F.transform(s, lambda x: x["lev"]), F.transform(s, lambda x: x["jac"])
    nc = F.filter(F.transform(s, lambda x: x["nc"]), lambda v: v.isNotNull())
    feats = {
        "f_equal": _mean(s, "eq"), "f_contains": _mean(s, "ct"),
        "f_one_null": _mean(s, "on"), "f_both_null": _mean(s, "bn"),
        "f_lev_mean": _mean(s, "lev"), "f_lev_min": F.coalesce(F.array_min(lev), F.lit(0.0)),
        "f_lev_max": F.coalesce(F.array_max(lev), F.lit(0.0)),
        "f_jac_mean": _mean(s, "jac"), "f_jac_min": F.coalesce(F.array_min(jac), F.lit(0.0)),
        "f_jac_max": F.coalesce(F.array_max(jac), F.lit(0.0)),
        "f_num_close": F.coalesce(F.array_min(nc), F.lit(-1.0)),
        "f_n_attrs": F.size("attrs").cast("double"),
    }
    return d.select("*", *[v.alias(k) for k, v in feats.items()]).drop("_s")


def feature_table(pairs: DataFrame, *keep: str) -> DataFrame:
    """``pair_id, dataset, split, label, content``, the columns ``keep`` and the features: what fits and scores
    read, stored once for any number of models.  ``content`` tells equal records apart from others."""
    d = pair_features(pairs).withColumn("content", F.md5(F.to_json("attrs")))
    return d.select("pair_id", "dataset", "split", "label", "content", *keep, *FEATURES)


def attribute_examples(attr_pairs: DataFrame) -> DataFrame:
    """Attribute pairs as canonical pairs of one attribute (other columns stay)."""
    own = ("attr_pair_id", "attribute", "left_value", "right_value")
    attr = F.struct(F.col("attribute").alias("name"), F.col("left_value").alias("left"),
                    F.col("right_value").alias("right"), F.lit(False).alias("numeric"))
    return attr_pairs.select(F.col("attr_pair_id").alias("pair_id"), *[c for c in attr_pairs.columns if c not in own],
                             F.array(attr).alias("attrs"))


def fit_features(train: DataFrame, valid: DataFrame | None = None, seed: int = 42, max_iter: int = 40,
                 max_depth: int = 4, features: list[str] = FEATURES):
    """U3 on a feature table: a GBT classifier; ``valid`` drives early stopping.

    The rows are dealt evenly over the cores and written first: the fit scans them several times, which would
    compute the features anew each time, and caches them as they lie, one pass for each level of a tree."""
    cols = ["label", *features]
    data = train.select(*cols, F.lit(False).alias("_is_valid"))
    if valid is not None:
        data = data.unionByName(valid.select(*cols, F.lit(True).alias("_is_valid")))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", seed=seed, maxIter=max_iter, maxDepth=max_depth)
    if valid is not None:
        gbt = gbt.setValidationIndicatorCol("_is_valid")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt])
    data = data.withColumn("label", F.col("label").cast("double"))
    return pipe.fit(written(data.repartition(data.sparkSession.sparkContext.defaultParallelism), "fit-rows"))


def fit_each(spark, fits: list[Callable]) -> list:
    """What each of ``fits`` returns; ``PARALLEL_FITS`` of them run at a time (their jobs are many and short)."""
    with ThreadPool(max(1, min(PARALLEL_FITS, len(fits)))) as pool:
        return pool.map(lambda fit: inheritable_thread_target(spark)(fit)(), fits)


def score_features(model, table: DataFrame, out: str) -> DataFrame:
    """``table`` plus ``out``: a struct of prediction, proba_0, proba_1.  A projection, so the models of many
    folds are applied to a row in one pass."""
    p = vector_to_array("probability")
    scored = model.transform(table).withColumn(out, F.struct(
        F.col("prediction").cast("int").alias("prediction"), p[0].alias("proba_0"), p[1].alias("proba_1")))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def fit_pair_classifier(train: DataFrame, valid: DataFrame | None = None, seed: int = 42,
                        max_iter: int = 40, max_depth: int = 4):
    """GBT classifier on pair features; ``valid`` drives early stopping."""
    return fit_features(pair_features(train), pair_features(valid) if valid is not None else None, seed, max_iter, max_depth)


def predict_pairs(model, pairs: DataFrame) -> DataFrame:
    """U4: ``pair_id, dataset, split, label, prediction, proba_0, proba_1``."""
    out = score_features(model, pair_features(pairs), "_p")
    return out.select("pair_id", "dataset", "split", "label", "_p.*")


def prepare_predictions(pairs: DataFrame, datasets: list[str], seed: int = 42, max_iter: int = 40) -> DataFrame:
    """One model per dataset, fitted on its train split with valid for tuning;
    in-sample train and valid predictions (they feed the hard-positive filter)."""
    def one(ds):
        mine = pairs.where(F.col("dataset") == ds)
        train, valid = mine.where(F.col("split") == "train"), mine.where(F.col("split") == "valid")
        model = fit_pair_classifier(train, valid, seed=seed, max_iter=max_iter)
        return predict_pairs(model, mine.where(F.col("split").isin("train", "valid"))).drop("label")
    return reduce(lambda a, b: a.unionByName(b), fit_each(pairs.sparkSession, [partial(one, ds) for ds in datasets]))


# --- U6: user-supplied batch scorer ---

def score_with(df: DataFrame, make_predict_fn, input_col: str = "text", batch_size: int = 128,
               out_col: str = "logits", n_classes: int = 2) -> DataFrame:
    """Run a user model over Arrow batches (``predict_batch_udf``); the model is
    built once per Python worker by ``make_predict_fn() -> (np.ndarray[str] -> np.ndarray)``
    and returns one row of ``n_classes`` logits per text."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=None)
    return df.withColumn(out_col, udf(F.col(input_col)))
