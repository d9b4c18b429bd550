"""Dataset specs and the canonical pair schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

ATTR_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("left", T.StringType()),
    T.StructField("right", T.StringType()),
    T.StructField("numeric", T.BooleanType()),
])

PAIR_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("attrs", T.ArrayType(ATTR_TYPE)),
])

# Stored tables; dataset and split are folder names and stay text ('2024', '007').
ATTR_PAIR_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "attr_pair_id", "attribute", "left_value", "right_value")] + [T.StructField("label", T.IntegerType())] + [
    T.StructField(n, T.StringType()) for n in ("dataset", "split")])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("pair_id", T.StringType()), T.StructField("prediction", T.IntegerType()),
    T.StructField("proba_0", T.DoubleType()), T.StructField("proba_1", T.DoubleType()),
    T.StructField("dataset", T.StringType())])

ATTR_PAIR_COLUMNS = ["attr_pair_id", "dataset", "split", "attribute",
                     "left_value", "right_value", "label"]

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class Attr:
    """One attribute of a record table: output name, source column, numeric flag."""
    name: str
    column: str
    numeric: bool = False


@dataclass(frozen=True)
class DatasetSpec:
    """A record table pair (A and B share the schema) and its attributes."""
    name: str
    table: str
    id_col: str
    attrs: tuple[Attr, ...] = field(default_factory=tuple)

    @property
    def attr_names(self) -> list[str]:
        return [a.name for a in self.attrs]

    @property
    def numeric_names(self) -> set[str]:
        return {a.name for a in self.attrs if a.numeric}
