"""The linear scorer against a plain numpy computation."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from twinlink.operators import linear_scorer as LS

ROWS = [("p1", "d", 1, "Acme Phone 12", "acme phone 12"), ("p2", "d", 0, "Acme Phone 12", "other thing"), ("p3", "d", 1, "a b", "B A c"),
        ("p4", "d", 0, "x\u00e9 y", "z"), ("p5", "d", 0, None, "q"), ("p6", "d", 1, "", None), ("p7", "d", None, "m m m", "m n")] * 6


def _slots(text):
    return dict.fromkeys(t for t in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").lower()) if t)


def _row(a, b):
    x = np.zeros(LS.WIDTH)
    ta, tb = _slots(a), _slots(b)
    both = [t for t in ta if t in tb]
    single = [t for t in {**ta, **tb} if t not in both]
    for k, own in enumerate((both, single)):
        for t in own:
            x[k * LS.BUCKETS + zlib.crc32(t.encode()) % LS.BUCKETS] += 1 / len(own)
    x[-1] = 1
    return x


def _df(spark, rows=ROWS):
    return spark.createDataFrame(rows, "pair_id string, dataset string, label int, text_a string, text_b string").repartition(3)


def test_weights_and_scores_equal_dense_matrices(spark):
    x = np.array([_row(r[3], r[4]) for r in ROWS])
    y = np.array([float(r[2] == 1) for r in ROWS])
    w = np.zeros(LS.WIDTH)
    for _ in range(5):
        w = w - 4.0 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + 1e-4 * w)
    got = LS.fit_linear(_df(spark), steps=5)
    assert np.allclose(got, w, atol=1e-9)
    want = {r[0]: 1 / (1 + np.exp(-_row(r[3], r[4]) @ w)) for r in ROWS}
    out = LS.score_linear(_df(spark), got).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert abs(r.proba_1 - want[r.pair_id]) < 1e-9 and abs(r.proba_0 + r.proba_1 - 1) < 1e-12
        assert r.prediction == int(r.proba_1 > 0.5)


def test_more_steps_lower_the_loss(spark):
    def loss(w):
        return sum(np.log1p(np.exp(-(2 * (r.label == 1) - 1) * np.log(r.proba_1 / r.proba_0))) for r in LS.score_linear(_df(spark), w).collect())
    losses = [loss(LS.fit_linear(_df(spark), steps=k)) for k in (0, 3, 20)]
    assert losses[0] > losses[1] > losses[2]


def test_no_rows_give_zero_weights(spark):
    empty = _df(spark, ROWS).limit(0)
    assert not LS.fit_linear(empty).any() and LS.score_linear(empty, np.zeros(LS.WIDTH)).count() == 0
    assert LS.features(_df(spark)).where(F.size("both") < 0).count() == 0
