"""Attribute pairs (A1-A8): explode row pairs into labelled attribute pairs.

The label cascade is one native ``CASE`` chain, evaluated in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.functions.nulls import is_null_token


def _num(c: Column) -> Column:
    return c.try_cast("double")


def attribute_label(left: Column, right: Column, numeric: Column, row_label: Column) -> Column:
    """A5: one null -> 0, both null -> 1, both numeric -> numeric equality (A4, row label
    ignored), else text identity (A3): equal or contained after lower-casing -> 1,
    otherwise the row label.

    A value counts as numeric when its attribute is declared numeric (A2) and the
    text parses as a number; '10 USD' therefore compares as text.
    """
    ln, rn = is_null_token(left), is_null_token(right)
    both_numeric = numeric & _num(left).isNotNull() & _num(right).isNotNull()
    lo_l, lo_r = F.lower(left), F.lower(right)
    same_text = (lo_l == lo_r) | F.contains(lo_l, lo_r) | F.contains(lo_r, lo_l)
    return (F.when(ln & ~rn, F.lit(0))
             .when(~ln & rn, F.lit(0))
             .when(ln & rn, F.lit(1))
             .when(both_numeric, (_num(left) == _num(right)).cast("int"))
             .when(same_text, F.lit(1))
             .otherwise(row_label.cast("int")))


def explode_attribute_pairs(pairs: DataFrame) -> DataFrame:
    """A6 + A5: one row per attribute of every row pair (no dedup)."""
    flat = pairs.select("pair_id", "dataset", "split", F.col("label").alias("row_label"),
                        F.inline("attrs"))
    return flat.select(
        "pair_id", "dataset", "split", F.col("name").alias("attribute"),
        F.col("left").alias("left_value"), F.col("right").alias("right_value"),
        attribute_label(F.col("left"), F.col("right"), F.col("numeric"), F.col("row_label")).alias("label"))


def _marked(c: Column) -> Column:
    """Length-prefixed text, '-' for null: concatenations of marked values cannot collide."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def attribute_pair_key(dataset: Column, split: Column, attribute: Column, left: Column, right: Column,
                       label: Column) -> Column:
    """Stable id of a distinct attribute pair: the dataset name and an md5 of its content."""
    content = F.concat_ws("\u001f", _marked(dataset), _marked(split), _marked(attribute),
                          label.cast("string"), _marked(left), _marked(right))
    return F.concat(dataset, F.lit("#"), F.md5(content))


def dedup_attribute_pairs(attr_rows: DataFrame) -> DataFrame:
    """Distinct (dataset, split, attribute, left, right, label); nulls compare equal.

    A keys-only hash aggregate (partial aggregation dedups map-side, so a group of
    copies collapses before the shuffle); the surviving row's id is a hash of its
    content, so no string aggregate (which would force a sort-based plan) is needed.
    """
    keys = ["dataset", "split", "attribute", "left_value", "right_value", "label"]
    return (attr_rows.select(*keys).distinct()
            .select(attribute_pair_key(*[F.col(k) for k in keys]).alias("attr_pair_id"), *keys))


def attribute_pairs(pairs: DataFrame) -> DataFrame:
    """Row pairs of all datasets and splits -> deduplicated labelled attribute pairs."""
    return dedup_attribute_pairs(explode_attribute_pairs(pairs))
