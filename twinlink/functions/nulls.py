"""Null handling.  Each consumer in the matching work has its own idea of a
missing value; they are kept apart on purpose (A1, P9, P10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Null-like strings recognised when labelling attribute pairs.
# Compared exactly (case-specific, untrimmed).
ATTRIBUTE_NULL_TOKENS = (
    "nan", "NaN", "NAN", "null", "NULL", "Null", "None", "none", "NONE",
    "", "-", "--", "---",
)

# The default missing-value strings of pandas.read_csv
# before version 2 (pandas documentation, ``na_values``; the text None stays), applied when record files are read.
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "n/a", "nan", "null",
)


def is_null_token(c: Column | str) -> Column:
    """A1: null, or exactly one of ATTRIBUTE_NULL_TOKENS."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | c.isin(*ATTRIBUTE_NULL_TOKENS)


def normalise_null_tokens(c: Column | str, tokens=CSV_NA_TOKENS) -> Column:
    """Map missing-value strings to null (Spark's CSV reader takes one token)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def fill_null(c: Column | str, filler: str) -> Column:
    """P10: serialisation prints 'N/A', the similarity baseline 'nan'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(filler))
