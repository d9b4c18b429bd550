"""Pluggable token counters (P14).  The default counter is native
(``text.count_whitespace_tokens``); a model tokenizer plugs in as an Arrow UDF."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_counter_udf(count: Callable[[str], int]):
    """Wrap ``count(text) -> int`` (e.g. a tokenizer's encode length) into an Arrow UDF.

    The callable is pickled once per task; load heavy tokenizers lazily inside it.
    """

    @F.pandas_udf(T.IntegerType())
    def _count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else int(count(t))).astype("Int32")

    return _count
