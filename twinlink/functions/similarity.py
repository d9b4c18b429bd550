"""Ratcliff-Obershelp similarity (difflib.SequenceMatcher.ratio) as an Arrow UDF.

Python is unavoidable here (no built-in computes this ratio); the UDF runs on
Arrow batches and callers prune first with ``ratio_upper_bound`` so that only
undecided rows pay for it (see ``operators.score.predict_by_similarity``).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ratio(a, b):
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _exceeds(a, b, t):
    if a is None or b is None:
        return None
    m = SequenceMatcher(None, a, b)
    # quick_ratio (multiset overlap of characters) bounds ratio from above in O(n);
    # the quadratic matcher only runs when the bound cannot decide.
    if m.quick_ratio() <= t:
        return False
    return m.ratio() > t


@F.pandas_udf(T.BooleanType())
def ratio_exceeds(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    """``ratio(a, b) > t``, exactly as difflib decides it, with a cheap bound first."""
    return pd.Series([_exceeds(x, y, z) for x, y, z in zip(a, b, t)], dtype="object")


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """2*min(len)/(len a + len b) >= ratio, since matches cannot exceed the shorter text."""
    la, lb = F.length(a), F.length(b)
    total = la + lb
    return F.when(total == 0, F.lit(1.0)).otherwise(
        (F.least(la, lb) * 2).cast("double") / total.cast("double"))


# Characters counted one by one; all others form one class.
COUNTED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ,.-#"
# From this length of the second text on, difflib leaves frequent characters out of its blocks.
AUTOJUNK = 200


def overlap_upper_bound(a: Column, b: Column) -> Column:
    """A bound of the ratio from above by the multiset of characters: matched characters are common ones,
    and of a class of characters no more than the smaller count of both texts can match."""
    def rest(x):
        return F.length(F.translate(x, COUNTED, ""))

    def count(x, c):
        return F.length(x) - F.length(F.replace(x, c, F.lit("")))
    chars = F.array(*[F.lit(c) for c in COUNTED])
    common = F.aggregate(chars, F.least(rest(a), rest(b)), lambda n, c: n + F.least(count(a, c), count(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((common * 2).cast("double") / total.cast("double"))


def block_proves(a: Column, b: Column, threshold: float) -> Column:
    """True where one common block proves ``ratio > threshold``: the first or last k characters of one text
    stand in the other, k the fewest matches that exceed the threshold.  Not for texts that
    difflib thins out (``AUTOJUNK``)."""
    la, lb = F.length(a), F.length(b)
    total = (la + lb).cast("double")
    k = (F.floor(total * F.lit(threshold) / 2) + 1).cast("int")
    enough = (k.cast("double") * 2 / total > F.lit(threshold)) & (k <= F.least(la, lb)) & (lb < AUTOJUNK)
    blocks = [F.contains(x, F.substring(y, F.lit(1), k)) | F.contains(x, F.substring(y, F.length(y) - k + 1, k))
              for x, y in ((a, b), (b, a))]
    return enough & (blocks[0] | blocks[1])


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer text; 1 for two empty texts.  Native."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b).cast("double") / longest.cast("double"))
