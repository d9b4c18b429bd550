"""Dataset assembly (D1-D11): samplers by name, serialised multi-dataset
train/valid/test sets, hold-out folds and training mixes.

All datasets live in one frame keyed by ``dataset`` and ``split``; a hold-out
is a filter, and all folds at once are an ``explode`` of the fold names (no join).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators import augment as G
from twinlink.operators import sampling as M
from twinlink.operators.pairs import attach_predictions
from twinlink.operators.serialise import serialise, serialise_attribute_pairs


def _needs(predictions, name):
    if predictions is None:
        raise ValueError(f"sampler {name} needs predictions: a table (pair_id, prediction, ...) "
                         "or a scorer pairs -> pairs + prediction")


def _automl(train, predictions, seed):
    """M4 with predictions from a stored table (J3, a key join) or an inline scorer."""
    _needs(predictions, "automl_filter")
    if callable(predictions):
        scored = predictions(train)
    else:
        scored = attach_predictions(train, predictions).drop("proba_0", "proba_1")
    return M.automl_filter(scored, seed=seed).drop("prediction")


# Samplers by name; '' keeps the training set as it is.
SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "": lambda train, predictions=None, seed=42: train,
    "one_pos_two_neg": lambda train, predictions=None, seed=42: M.one_pos_two_neg(train, seed=seed),
    "automl_filter": _automl,
    "automl_filter_flip": lambda train, predictions=None, seed=42:
        G.flip_augment(_automl(train, predictions, seed)),
    "automl_filter_permute": lambda train, predictions=None, seed=42:
        G.permute_augment(_automl(train, predictions, seed), seed),
    "automl_filter_flip_permute": lambda train, predictions=None, seed=42:
        G.flip_permute_augment(_automl(train, predictions, seed), seed),
}


def sample_train(pairs: DataFrame, sampler: str = "one_pos_two_neg", predictions: DataFrame | None = None,
                 seed: int = 42) -> DataFrame:
    """D1/D2 core: the sampler runs on the train split only, per dataset; valid and test
    pass through.  Returns canonical pairs of all splits."""
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}; known: {sorted(SAMPLERS)}")
    train = pairs.where(F.col("split") == "train")
    rest = pairs.where(F.col("split") != "train")
    return SAMPLERS[sampler](train, predictions, seed).unionByName(rest)


def read_datasets(pairs: DataFrame, mode: str = "mode1", sampler: str = "one_pos_two_neg",
                  predictions: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """D1 + D2: serialised ``pair_id, dataset, split, text, label`` of every dataset."""
    return serialise(sample_train(pairs, sampler, predictions, seed), mode)


def read_attribute_datasets(attr_pairs: DataFrame, mode: str = "mode1", seed: int = 1,
                            cap: int | None = 800, by=(), eval_cap: int | None = None,
                            folds: list[str] | None = None) -> DataFrame:
    """D3: attribute pairs of all datasets, balanced per split and attribute and capped (train by
    ``cap``; valid and test only by an ``eval_cap``), serialised as one-attribute records named 'value'.  ``by``
    balances each of its values separately; ``folds`` (D6) each hold-out fold, and adds ``fold``."""
    return serialise_attribute_pairs(M.balance_attribute_pairs(attr_pairs, seed=seed, cap=cap, by=by,
                                                               eval_cap=eval_cap, folds=folds), mode)


def hold_out(df: DataFrame, held_out: str) -> DataFrame:
    """Everything but the held-out dataset (a partition filter on stored data)."""
    return df.where(F.col("dataset") != F.lit(held_out))


def all_folds(df: DataFrame, folds: list[str]) -> DataFrame:
    """One copy of each row per fold that does not hold its dataset out."""
    names = F.array(*[F.lit(f) for f in folds])
    return df.withColumn("fold", F.explode(F.filter(names, lambda f: f != F.col("dataset"))))


def mix_row(rows: DataFrame) -> DataFrame:
    """Train and valid from the row pairs as they are."""
    return rows.where(F.col("split").isin("train", "valid"))


def mix_attr_plus_row(attr_texts: DataFrame, rows: DataFrame) -> DataFrame:
    """train = attribute train ∪ row train, distinct on (text, label); valid = rows."""
    keep = [c for c in ("fold",) if c in rows.columns]
    train = (attr_texts.where(F.col("split") == "train").unionByName(rows.where(F.col("split") == "train"))
             .groupBy(*keep, "text", "label")
             .agg(F.min("pair_id").alias("pair_id"), F.min_by("dataset", "pair_id").alias("dataset"))
             .withColumn("split", F.lit("train")))
    return train.unionByName(rows.where(F.col("split") == "valid"), allowMissingColumns=False)


def mix_attr_then_row(attr_texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Phase 1 trains/validates on attribute pairs, phase 2 on row pairs."""
    p1 = attr_texts.where(F.col("split").isin("train", "valid")).withColumn("phase", F.lit(1))
    p2 = rows.where(F.col("split").isin("train", "valid")).withColumn("phase", F.lit(2))
    return p1.unionByName(p2)


def example_texts(texts: DataFrame, splits=("test", "valid")) -> DataFrame:
    """One example text per dataset and split (the one with the smallest id)."""
    return (texts.where(F.col("split").isin(*splits)).groupBy("dataset", "split")
            .agg(F.min_by("text", "pair_id").alias("text")))


def split_sizes(texts: DataFrame, by=("split",)) -> DataFrame:
    """Rows per split."""
    return texts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
