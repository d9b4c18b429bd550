"""A pair scorer with hashed token features and linear weights, trained and applied in numpy matrices.

A pair's features are its tokens (lower-cased, cut at white space) hashed into ``BUCKETS`` slots of two
kinds: tokens that both records hold, and tokens that one holds; each kind adds up to one.  Weights are learned by
full-batch gradient descent on the logistic loss: a pass over the training rows per step, one partial gradient
(a vector of fixed length) a task, added up on the driver.  Scoring turns an Arrow batch into one sparse
product; no Python loop over rows computes scores.

Edge cases: null texts have no tokens; pairs without tokens get the bias; without training rows all
weights are zero; repeated rows count as often as they stand; labels other than 1 are negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
WIDTH = 2 * BUCKETS + 1  # shared tokens, single tokens, bias


def _tokens(text: Column) -> Column:
    blank = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\\s+", " ")
    return F.array_distinct(F.array_remove(F.split(blank, " "), ""))


def hashed_tokens(a: Column, b: Column) -> tuple[Column, Column]:
    """Slots of the tokens of both texts, and of those in one of them only."""
    ta, tb = _tokens(a), _tokens(b)

    def slots(tokens):
        return F.transform(tokens, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(BUCKETS)).cast("int"))
    both = F.array_intersect(ta, tb)
    return slots(both), slots(F.array_except(F.array_union(ta, tb), both))


def _matrix(both: pa.ListArray, single: pa.ListArray):
    """Rows, columns and values of the batch's sparse feature matrix (without the bias)."""
    rows, cols, values = [], [], []
    for k, lists in enumerate((both, single)):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lists)), sizes)
        rows.append(row)
        cols.append(lists.flatten().to_numpy().astype(np.int64) + k * BUCKETS)
        values.append(1.0 / sizes[row])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _product(weights: np.ndarray, both, single) -> np.ndarray:
    rows, cols, values = _matrix(both, single)
    return weights[-1] + np.bincount(rows, weights=values * weights[cols], minlength=len(both))


def features(pairs: DataFrame, a: str = "text_a", b: str = "text_b", keep=("pair_id",)) -> DataFrame:
    both, single = hashed_tokens(F.col(a), F.col(b))
    return pairs.select(*keep, both.alias("both"), single.alias("single"))


def fit_linear(train: DataFrame, steps: int = 30, rate: float = 4.0, l2: float = 1e-4, a: str = "text_a",
               b: str = "text_b") -> np.ndarray:
    """``WIDTH`` weights learned on ``train`` (texts and ``label``); stores the features once by ``written``."""
    from twinlink.tables import written
    label = F.coalesce(F.col("label") == 1, F.lit(False)).cast("double").alias("label")
    rows = written(features(train.withColumn("label", label), a, b, keep=("label",)), "linear-features")
    sc = rows.sparkSession.sparkContext
    weights = np.zeros(WIDTH)
    for _ in range(steps):
        packed = sc.broadcast(weights)

        def gradient(batches):
            total, n = np.zeros(WIDTH), 0
            for batch in batches:
                r, cols, values = _matrix(batch.column(1), batch.column(2))
                z = _product(packed.value, batch.column(1), batch.column(2))
                off = 1 / (1 + np.exp(-z)) - batch.column(0).to_numpy()
                total += np.bincount(cols, weights=values * off[r], minlength=WIDTH)
                total[-1] += off.sum()
                n += batch.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["g", "n"])
        # One fixed-length vector a task.
        parts = rows.mapInArrow(gradient, "g binary, n bigint").collect()
        packed.unpersist()
        if not parts:
            return weights
        n = sum(p["n"] for p in parts)
        weights = weights - rate * (sum(np.frombuffer(p["g"]) for p in sorted(parts, key=lambda p: bytes(p["g"]))) / n + l2 * weights)
    return weights


def score_linear(pairs: DataFrame, weights: np.ndarray, a: str = "text_a", b: str = "text_b",
                 keep=("pair_id", "dataset", "label")) -> DataFrame:
    """``keep``, ``prediction``, ``proba_0`` and ``proba_1`` of every pair."""
    packed = pairs.sparkSession.sparkContext.broadcast(weights)
    table = features(pairs, a, b, keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:len(keep)])

    def run(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-_product(packed.value, batch.column(len(keep)), batch.column(len(keep) + 1))))
            own = [pa.array((p > 0.5).astype(np.int32)), pa.array(1 - p), pa.array(p)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *own], [*keep, "prediction", "proba_0", "proba_1"])
    return table.mapInArrow(run, f"{fields}, prediction int, proba_0 double, proba_1 double")
