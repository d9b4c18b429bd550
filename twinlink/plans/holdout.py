"""Leave-one-dataset-out evaluation.

Per fold the classifier is fitted on the other datasets' sets, mixed as ``row``, ``attr+row`` or
``attr-row``, and scored on the test split of every dataset; F1 and accuracy are reported per
dataset with the held-out one marked ``zero_shot``.  ``attr-row`` has two phases: a model of the attribute
pairs, then one of the row pairs that takes the first one's score as a feature; both are evaluated.

Samples are drawn once (a sampler works per dataset, so holding out after sampling is the same) and
features are stored once.  All folds' models are applied to a test row in one projection, with its
label beside it: one scan of the tests, one aggregate, no join, whatever the number of folds.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators.assemble import sample_train
from twinlink.operators.classifier import (FEATURES, attribute_examples, feature_table, fit_each, fit_features,
                                           score_features)
from twinlink.operators.report import metrics_report
from twinlink.operators.sampling import balance_attribute_pairs
from twinlink.plans.experiment import MIXES
from twinlink.tables import written

FIRST = "f_first_phase"


def _with_first(model, table: DataFrame) -> DataFrame:
    return score_features(model, table, "_first").withColumn(FIRST, F.col("_first")["proba_1"]).drop("_first")


def fold_models(rows: DataFrame, attrs: DataFrame | None, fold: str, mix: str = "row", seed: int = 42,
                max_iter: int = 40) -> list[tuple[int, list]]:
    """The fold's models: (phase, models to apply one after the other).  ``rows``: feature table of the sampled
    row pairs; ``attrs``: of the balanced attribute pairs of every ``fold``."""
    mine = rows.where(F.col("dataset") != fold)
    train, valid = mine.where("split = 'train'"), mine.where("split = 'valid'")
    if mix == "row":
        return [(1, [fit_features(train, valid, seed, max_iter)])]
    own = attrs.where(F.col("fold") == fold).drop("fold")
    attr_train, attr_valid = own.where("split = 'train'"), own.where("split = 'valid'")
    if mix == "attr+row":
        both = attr_train.unionByName(train).dropDuplicates(["content", "label"])
        return [(1, [fit_features(both, valid, seed, max_iter)])]
    first = fit_features(attr_train, attr_valid, seed, max_iter)
    second = fit_features(_with_first(first, train), _with_first(first, valid), seed, max_iter, features=[*FEATURES, FIRST])
    return [(1, [first]), (2, [first, second])]


def score_folds(tests: DataFrame, models: dict[str, list[tuple[int, list]]]) -> DataFrame:
    """``fold, phase, pair_id, dataset, label, prediction, proba_0, proba_1`` for every row, fold and phase of
    ``tests`` (a feature table): one projection, exploded."""
    scored, out = tests, []
    for i, (fold, phases) in enumerate(models.items()):
        for phase, chain in phases:
            name = f"_s{i}_{phase}"
            own = scored
            if len(chain) > 1:
                own = _with_first(chain[0], own)
            scored = score_features(chain[-1], own, name).drop(FIRST)
            out.append(F.struct(F.lit(fold).alias("fold"), F.lit(phase).alias("phase"), f"{name}.prediction",
                                f"{name}.proba_0", f"{name}.proba_1"))
    return scored.select("pair_id", "dataset", "label", F.inline(F.array(*out)))


def holdout_predictions(pairs: DataFrame, datasets: list[str], sampler: str = "automl_filter", predictions=None,
                        seed: int = 42, mix: str = "row", attr_pairs: DataFrame | None = None, cap: int | None = 800,
                        max_iter: int = 40) -> DataFrame:
    """The test rows of all datasets, scored by every fold's models (``score_folds``)."""
    if mix not in MIXES:
        raise ValueError(f"unknown mix {mix!r}; known: {MIXES}")
    rows = written(feature_table(sample_train(pairs, sampler, predictions, seed)), "holdout-rows")
    attrs = None
    if mix != "row":
        if attr_pairs is None:
            raise ValueError(f"mix {mix!r} needs attribute pairs")
        balanced = balance_attribute_pairs(attr_pairs.where(F.col("split") != "test"), cap=cap, folds=datasets)
        attrs = written(feature_table(attribute_examples(balanced), "fold"), "holdout-attributes")
    fits = [partial(fold_models, rows, attrs, d, mix, seed, max_iter) for d in datasets]
    models = dict(zip(datasets, fit_each(pairs.sparkSession, fits)))
    return score_folds(rows.where("split = 'test'"), models)


def holdout_evaluation(pairs: DataFrame, datasets: list[str], sampler: str = "automl_filter",
                       predictions=None, seed: int = 42, mix: str = "row", attr_pairs: DataFrame | None = None,
                       cap: int | None = 800, max_iter: int = 40) -> DataFrame:
    """Counts, F1 and accuracy per fold, phase and dataset, ``zero_shot`` for the held-out dataset."""
    scored = holdout_predictions(pairs, datasets, sampler, predictions, seed, mix, attr_pairs, cap, max_iter)
    report = metrics_report(scored, by=("fold", "phase", "dataset"))
    return report.withColumn("zero_shot", F.col("dataset") == F.col("fold"))


def holdout_fold(pairs: DataFrame, held_out: str, sampler: str = "one_pos_two_neg",
                 predictions: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """One fold of ``holdout_evaluation``."""
    return holdout_evaluation(pairs, [held_out], sampler, predictions, seed)
