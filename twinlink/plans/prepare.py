"""Preparation job.  Row pairs (J2 -> K1), attribute pairs (A8 -> K2) and
classifier predictions (U5 -> K3), written as Parquet partitioned by dataset
and split; later jobs read them back with partition pruning."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from twinlink.operators.attributes import attribute_pairs
from twinlink.operators.classifier import prepare_predictions
from twinlink.sources.files import write_pairs, write_predictions, read_pairs


def prepare_all(spark: SparkSession, pairs: DataFrame, datasets: list[str], out_root: str,
                with_predictions: bool = True) -> dict[str, str]:
    paths = {"pairs": os.path.join(out_root, "pairs"),
             "attr_pairs": os.path.join(out_root, "attr_pairs"),
             "predictions": os.path.join(out_root, "predictions")}
    write_pairs(pairs, paths["pairs"])
    stored = read_pairs(spark, paths["pairs"])
    write_pairs(attribute_pairs(stored), paths["attr_pairs"])
    if with_predictions:
        write_predictions(prepare_predictions(stored, datasets), paths["predictions"])
    return paths
