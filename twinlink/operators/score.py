"""Scoring pairs: string similarity (U1, U2), logits to class (U7).  The Spark ML
classifier (U3-U5) and the batch scorer hook (U6) are in ``operators.classifier``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.functions.similarity import (block_proves, edit_similarity, overlap_upper_bound, ratio_exceeds,
                                           ratio_upper_bound)
from twinlink.operators.serialise import record_text


def similarity_decision(a: Column, b: Column, threshold: float) -> Column:
    """Native part of U2: 1/0 where the verdict is known without the UDF, else null.

    Equal texts (two empties included) have ratio 1.0; when the length bound is at
    or under the threshold the ratio is too.
    """
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
             .when(a == b, F.lit(int(1.0 > threshold)))
             .when(ratio_upper_bound(a, b) <= F.lit(threshold), F.lit(0)))


def native_decision(a: Column, b: Column, threshold: float) -> Column:
    """``similarity_decision``, and where that is silent the character-overlap bound (-> 0) and the
    common-block bound (-> 1); null where only the matcher itself can tell."""
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("int"))
             .when(a == b, F.lit(int(1.0 > threshold)))
             .when(ratio_upper_bound(a, b) <= F.lit(threshold), F.lit(0))
             .when(block_proves(a, b, threshold), F.lit(1))
             .when(overlap_upper_bound(a, b) <= F.lit(threshold), F.lit(0)))


def predict_by_edits(df: DataFrame, a: str = "text_a", b: str = "text_b",
                     threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """U2 with the native scorer: ``edit_similarity(a, b) > threshold`` -> 1."""
    return df.withColumn(out, (edit_similarity(F.col(a), F.col(b)) > F.lit(threshold)).cast("int"))


def predict_by_similarity(df: DataFrame, a: str = "text_a", b: str = "text_b",
                          threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """``ratio(a, b) > threshold`` -> 1, in one pass.

    The UDF's inputs are masked to null on rows the native bounds decide, so only
    undecided rows are compared in Python.
    """
    ca, cb = F.col(a), F.col(b)
    native = native_decision(ca, cb, threshold)
    undecided = native.isNull()
    above = ratio_exceeds(F.when(undecided, ca), F.when(undecided, cb), F.lit(float(threshold)))
    return df.withColumn(out, F.coalesce(native, above.cast("int")))


def similarity_inputs(pairs: DataFrame) -> DataFrame:
    """T9 texts of both records with 'nan' for nulls, as the similarity baseline reads them."""
    return pairs.select("pair_id", "dataset", "split", "label",
                        record_text("left", ", ").alias("text_a"),
                        record_text("right", ", ").alias("text_b"))


def argmax_class(logits: Column | str) -> Column:
    """Index of the first maximum (0-based)."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")
