"""String functions used by serialisation, training-set preparation and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.strip()/str.split() see it: every code point for
# which str.isspace() holds (29 of them: Unicode White_Space plus U+001C..U+001F).
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
# The same set as an RE2 character class (DuckDB oracle).
WHITESPACE_CLASS_RE2 = "".join(
    (f"\\x{{{ord(ch):X}}}" if ord(ch) > 0x7E or ord(ch) < 0x20 else ch) for ch in WHITESPACE_CHARS)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_all(c: Column | str) -> Column:
    """Remove leading/trailing whitespace of every kind (Spark's trim only drops blanks).

    A character-set trim, no regular expression."""
    return F.btrim(_c(c), F.lit(WHITESPACE_CHARS))


def count_whitespace_tokens(c: Column | str) -> Column:
    """Default token counter: whitespace-separated pieces of the text (0 for blank text).

    Every whitespace character is mapped to a blank (``translate``, a character
    map), then split on the single blank and empty pieces dropped -- no regular
    expression and no strip pass.  An approximation of a subword tokenizer; pass a
    ``token_counter`` UDF where the exact model count matters (``functions.tokens``).
    """
    c = _c(c)
    blanks = F.translate(c, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    n = F.size(F.array_remove(F.split(blanks, " "), ""))
    return F.when(c.isNull(), F.lit(None).cast("int")).otherwise(n)


def label_to_text(label: Column | str, yes_no: bool = True) -> Column:
    """0/1 -> 'No'/'Yes' (GPT/BERT style) or 'False'/'True' (T5 style); others null."""
    neg, pos = ("No", "Yes") if yes_no else ("False", "True")
    label = _c(label)
    return F.when(label == 0, F.lit(neg)).when(label == 1, F.lit(pos))


def text_to_label(c: Column | str) -> Column:
    """Exactly 'True' or 'Yes' (after stripping) -> 1, anything else 0."""
    return F.coalesce(strip_all(c).isin("True", "Yes"), F.lit(False)).cast("int")


def text_to_bool(c: Column | str) -> Column:
    """A text prediction is positive when its lower case contains 'yes' or 'true'."""
    low = F.lower(_c(c))
    return F.contains(low, F.lit("yes")) | F.contains(low, F.lit("true"))


def merge_price_currency(price: Column | str, currency: Column | str,
                         lenient: bool = False) -> Column:
    """P6 (strict, default): currency then price, null if either is null.

    P7 (lenient): price then currency, nulls printed as 'nan' -- the order used
    for one validation file; kept only behind this flag.
    """
    price, currency = _c(price).cast("string"), _c(currency).cast("string")
    if lenient:
        return F.concat(F.coalesce(price, F.lit("nan")), F.coalesce(currency, F.lit("nan")))
    return F.when(price.isNotNull() & currency.isNotNull(), F.concat(currency, price))
