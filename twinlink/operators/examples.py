"""Model inputs from serialised pairs (P11-P14, R8): what a trainer consumes.

The label becomes the target text ('Yes'/'No', or 'True'/'False' for
text-to-text models), description and target are stripped, descriptions longer
than the split's token limit and null texts are dropped and counted, and a split without
a limit fails the job, so kept and dropped texts are all texts.  Token counts come from
the native whitespace counter unless a tokenizer UDF is passed
(``functions.tokens.token_counter_udf``).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.functions.text import count_whitespace_tokens, label_to_text, strip_all, text_to_label

# Description token limits, training and validation sets vs. test sets.
MAX_TOKENS = {"train": 350, "valid": 350, "test": 10000}


def _limit(max_tokens: dict[str, int]) -> Column:
    expr = None
    for split, n in max_tokens.items():
        cond = F.col("split") == F.lit(split)
        expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
    unknown = F.raise_error(F.concat(F.lit("no token limit for split "), F.coalesce(F.col("split"), F.lit("null"))))
    return expr.otherwise(unknown.cast("int"))


def model_examples(texts: DataFrame, yes_no: bool = True, max_tokens: dict[str, int] | None = None,
                   n_tokens: Callable[[Column], Column] = count_whitespace_tokens) -> DataFrame:
    """``pair_id, dataset, split, text, target, target_id, n_tokens, kept`` for every text.

    ``kept`` marks descriptions within the split's limit (inclusive); filter on it for
    the training input, aggregate it for the dropped report."""
    max_tokens = max_tokens or MAX_TOKENS
    text = strip_all("text")
    target = strip_all(label_to_text("label", yes_no))
    keep = [c for c in ("fold", "phase") if c in texts.columns]
    out = texts.select("pair_id", "dataset", "split", *keep, text.alias("text"), target.alias("target"))
    out = out.withColumn("target_id", text_to_label(F.col("target"))) \
             .withColumn("n_tokens", n_tokens(F.col("text")))
    # The limit comes first: a comparison reads its right side only if the left one is not null.
    return out.withColumn("kept", F.coalesce(_limit(max_tokens) >= F.col("n_tokens"), F.lit(False)))


def kept_examples(examples: DataFrame) -> DataFrame:
    return examples.where(F.col("kept")).drop("kept")


def dropped_examples(examples: DataFrame, by=("dataset", "split")) -> DataFrame:
    """R8 for model inputs: texts per group and how many are dropped (too long, or null)."""
    return examples.groupBy(*by).agg(F.count(F.lit(1)).alias("n_texts"),
                                     F.count_if(~F.col("kept")).alias("n_dropped"))
