"""The string-similarity baseline as one job over all datasets.

pairs -> T9 record texts -> U2 -> R4 per dataset -> R5 mean.  Scorers: ``sequence`` (native bounds, then
the matcher on Arrow batches of the undecided rows) and ``edits`` (native throughout).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.operators.report import mean_f1, metrics_report
from twinlink.operators.score import predict_by_edits, predict_by_similarity, similarity_inputs

SCORERS = {"sequence": predict_by_similarity, "edits": predict_by_edits}


def similarity_scores(pairs: DataFrame, split: str = "test", threshold: float = 0.5,
                      scorer: str = "sequence") -> DataFrame:
    texts = similarity_inputs(pairs.where(F.col("split") == split))
    return SCORERS[scorer](texts, "text_a", "text_b", threshold)


def similarity_report(pairs: DataFrame, split: str = "test", threshold: float = 0.5,
                      scorer: str = "sequence") -> DataFrame:
    return metrics_report(similarity_scores(pairs, split, threshold, scorer))


def similarity_mean_f1(pairs: DataFrame, split: str = "test", threshold: float = 0.5,
                       scorer: str = "sequence") -> DataFrame:
    return mean_f1(similarity_report(pairs, split, threshold, scorer))
