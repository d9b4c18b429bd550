"""Inputs of the leave-one-dataset-out experiment, for every fold in one job.

Training and validation sets of each fold (every dataset but the held-out one,
mixed as 'row', 'attr+row' or 'attr-row'), and the test sets of all datasets
(each fold is evaluated on all of them, so they are stored once under
``fold='all'``), turned into model inputs (targets, strip, token limits) and
written as Parquet partitioned by fold and split.  Samplers run once per
dataset, before the fold copies are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators import assemble as D
from twinlink.operators.examples import kept_examples, model_examples

MIXES = ("row", "attr+row", "attr-row")


def hold_out_sets(pairs: DataFrame, datasets: list[str], mix: str = "row", attr_pairs: DataFrame | None = None,
                  sampler: str = "automl_filter", predictions=None, mode: str = "mode1",
                  seed: int = 42, cap: int | None = 800) -> DataFrame:
    """Serialised ``fold, phase, pair_id, dataset, split, text, label`` for all folds; ``cap``: M6, of
    the attribute pairs of the train split."""
    if mix not in MIXES:
        raise ValueError(f"unknown mix {mix!r}; known: {MIXES}")
    rows = D.read_datasets(pairs, mode, sampler, predictions, seed)
    tests = rows.where(F.col("split") == "test").withColumn("fold", F.lit("all")).withColumn("phase", F.lit(1))
    row_folds = D.all_folds(rows.where(F.col("split").isin("train", "valid")), datasets)
    if mix == "row":
        tv = D.mix_row(row_folds).withColumn("phase", F.lit(1))
    else:
        if attr_pairs is None:
            raise ValueError(f"mix {mix!r} needs attribute pairs")
        # Balancing groups attributes across datasets, so each fold balances its own datasets.
        attr_folds = D.read_attribute_datasets(attr_pairs, mode, cap=cap, folds=datasets)
        tv = (D.mix_attr_plus_row(attr_folds, row_folds).withColumn("phase", F.lit(1)) if mix == "attr+row"
              else D.mix_attr_then_row(attr_folds, row_folds))
    cols = ["fold", "phase", "pair_id", "dataset", "split", "text", "label"]
    return tv.select(*cols).unionByName(tests.select(*cols))


def write_hold_out_inputs(sets: DataFrame, path: str, yes_no: bool = True, max_tokens=None) -> DataFrame:
    """Model inputs of ``hold_out_sets`` written under ``fold=…/split=…``; returns the
    dropped-for-length report (one row per fold, phase, dataset and split).  Rows are rebalanced
    by folder, so that no task sorts for the joins and for the folders at once."""
    ex = model_examples(sets, yes_no=yes_no, max_tokens=max_tokens)
    kept_examples(ex).hint("rebalance", "fold", "split").write.mode("overwrite").partitionBy("fold", "split").parquet(path)
    return ex.groupBy("fold", "phase", "dataset", "split").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(~F.col("kept")).alias("n_dropped"))
