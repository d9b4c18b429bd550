"""Model inputs: target texts, strip, inclusive per-split limits, dropped counts."""

import pytest

from twinlink.functions import text as TX
from twinlink.operators import examples as EX
from twinlink.operators import report as R


def test_targets_strip_and_limits(spark):
    rows = [("a", "d", "train", " x y z \n", 1), ("b", "d", "train", "x y z w", 0),
            ("c", "d", "test", "x y z w", 0)]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, text string, label int")
    limits = {"train": 3, "valid": 3, "test": 10}
    gpt = {r.pair_id: r for r in EX.model_examples(df, yes_no=True, max_tokens=limits).collect()}
    assert (gpt["a"].text, gpt["a"].target, gpt["a"].target_id, gpt["a"].kept) == ("x y z", "Yes", 1, True)
    assert (gpt["b"].target, gpt["b"].target_id, gpt["b"].kept) == ("No", 0, False)
    assert gpt["c"].kept is True
    t5 = {r.pair_id: r.target for r in EX.model_examples(df, yes_no=False, max_tokens=limits).collect()}
    assert t5 == {"a": "True", "b": "False", "c": "False"}
    rep = {(r.split): (r.n_texts, r.n_dropped)
           for r in EX.dropped_examples(EX.model_examples(df, max_tokens=limits)).collect()}
    assert rep == {"train": (2, 1), "test": (1, 0)}


def test_kept_and_dropped_are_all_texts(spark):
    rows = [("a", "d", "train", "x y", 1), ("b", "d", "train", None, 0), ("c", "d", "test", "x y z w", 0)]
    df = spark.createDataFrame(rows, "pair_id string, dataset string, split string, text string, label int")
    ex = EX.model_examples(df, max_tokens={"train": 3, "valid": 3, "test": 10})
    rep = {r.split: (r.n_texts, r.n_dropped) for r in EX.dropped_examples(ex).collect()}
    assert rep == {"train": (2, 1), "test": (1, 0)}
    assert {r.pair_id for r in EX.kept_examples(ex).collect()} == {"a", "c"}
    long = R.dropped_for_length(df, TX.count_whitespace_tokens("text"), 3, by=("dataset",)).first()
    kept = R.length_filter(df, TX.count_whitespace_tokens("text"), 3).count()
    assert (long.n_texts, long.n_dropped, kept) == (3, 2, 1)


@pytest.mark.parametrize("split", ["dev", None])
@pytest.mark.parametrize("text", ["x", None])
def test_split_without_limit_fails(spark, split, text):
    df = spark.createDataFrame([("a", "d", split, text, 1)], "pair_id string, dataset string, split string, text string, label int")
    for out in (EX.kept_examples(EX.model_examples(df)), EX.dropped_examples(EX.model_examples(df))):
        with pytest.raises(Exception, match="no token limit for split"):
            out.collect()
