"""Row pairs: materialise from record tables and id pairs (J1, J2), pack the wide
``_l``/``_r`` layout into the canonical ``attrs`` array (P4, P5), attach
predictions by key (J3)."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlink.schema import DatasetSpec


def side_columns(df: DataFrame) -> list[str]:
    """Attribute names of a wide pair frame, by suffix; left and right must line up."""
    left = [c[:-2] for c in df.columns if c.endswith("_l")]
    right = [c[:-2] for c in df.columns if c.endswith("_r")]
    if len(left) != len(right):
        raise ValueError(f"unequal sides: {left} vs {right}")
    return left


def materialise_pairs(a: DataFrame, b: DataFrame, id_pairs: DataFrame, id_col: str = "id",
                      keep: Iterable[str] = ()) -> DataFrame:
    """``id_pairs ⋈ A on ltable_id ⋈ B on rtable_id``, attributes suffixed _l/_r.

    Inner joins: unmatched pairs vanish, duplicate record ids fan out.  Merge joins by
    hint: Spark plans a broadcast by the size of files, and compressed records are many
    times as large once they are collected on the driver.  AQE splits a hot record id.
    """
    attrs = [c for c in a.columns if c != id_col]
    left = a.select(F.col(id_col).alias("ltable_id"), *[F.col(c).alias(f"{c}_l") for c in attrs])
    right = b.select(F.col(id_col).alias("rtable_id"), *[F.col(c).alias(f"{c}_r") for c in attrs])
    joined = id_pairs.join(left.hint("merge"), "ltable_id").join(right.hint("merge"), "rtable_id")
    extra = [c for c in id_pairs.columns if c not in ("ltable_id", "rtable_id", "label")]
    return joined.select("ltable_id", "rtable_id", *extra, *[f"{c}_l" for c in attrs],
                         "label", *[f"{c}_r" for c in attrs], *keep)


def _as_text(c: Column, dtype: T.DataType) -> Column:
    return c if isinstance(dtype, T.StringType) else c.cast("string")


def pack_pairs(wide: DataFrame, dataset: str | Column, numeric: Iterable[str] | None = None,
               split: str | Column | None = None) -> DataFrame:
    """P5: wide ``<attr>_l … label … <attr>_r`` -> canonical pairs.

    ``numeric`` names the numeric attributes; when omitted, an attribute is numeric
    if both sides have a numeric Spark type.  Values become text.
    """
    names = side_columns(wide)
    # The i-th left column pairs with the i-th right column; the name is the left one's.
    rights = [c for c in wide.columns if c.endswith("_r")]
    sides = [(n, f"{n}_l", r) for n, r in zip(names, rights)]
    types = {f.name: f.dataType for f in wide.schema.fields}
    num = set(numeric) if numeric is not None else {
        n for n, lc, rc in sides
        if isinstance(types[lc], T.NumericType) and isinstance(types[rc], T.NumericType)}
    attrs = F.array(*[
        F.struct(F.lit(n).alias("name"),
                 _as_text(F.col(lc), types[lc]).alias("left"),
                 _as_text(F.col(rc), types[rc]).alias("right"),
                 F.lit(n in num).alias("numeric"))
        for n, lc, rc in sides])
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    if "pair_id" in wide.columns:
        pid = F.col("pair_id")
    else:
        pid = F.concat_ws("|", ds, F.col("ltable_id"), F.col("rtable_id"))
    sp = (F.lit(split) if isinstance(split, str) else split) if split is not None else F.col("split")
    return wide.select(pid.alias("pair_id"), ds.alias("dataset"), sp.alias("split"),
                       F.col("label").cast("int").alias("label"), attrs.alias("attrs"))


def unpack_pairs(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Inverse of P5 for one dataset schema: canonical -> wide text columns."""
    cols = [F.col("attrs")[i][side].alias(f"{n}_{side[0]}")
            for side in ("left", "right") for i, n in enumerate(names)]
    return pairs.select("pair_id", "dataset", "split", "label", *cols)


def build_pairs(specs: Iterable[DatasetSpec], records, id_pairs) -> DataFrame:
    """J1 + P5 for many datasets in one plan (``split`` is a column, datasets unioned).

    ``records(spec) -> (A, B)`` and ``id_pairs(spec) -> DataFrame`` supply inputs.
    """
    out = None
    for spec in specs:
        a, b = records(spec)
        wide = materialise_pairs(a, b, id_pairs(spec))
        packed = pack_pairs(wide, spec.name, numeric=spec.numeric_names)
        out = packed if out is None else out.unionByName(packed)
    return out


def attach_predictions(pairs: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Key-aligned join of predictions (``pair_id, prediction, proba_0, proba_1``).

    Every pair must have exactly one prediction.  With ``check`` a missing or a
    repeated prediction fails the job, evaluated with the rows: the predictions are
    first reduced to one row per pair_id with its count (a hash aggregate whose
    output is already partitioned on the join key), so no extra driver round trip.
    """
    rest = [c for c in predictions.columns if c != "pair_id"]
    if not check:
        return pairs.join(predictions.select("pair_id", *rest).hint("merge"), "pair_id", "left")
    one = predictions.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"),
                                             *[F.min(c).alias(c) for c in rest])
    joined = pairs.join(one.hint("merge"), "pair_id", "left")     # predictions grow with the pairs
    pid = F.col("pair_id").cast("string")
    checked = (F.when(F.col("_n").isNull(),
                      F.raise_error(F.concat(F.lit("no prediction for pair "), pid)).cast("int"))
                .when(F.col("_n") > 1,
                      F.raise_error(F.concat(F.lit("more than one prediction for pair "), pid)).cast("int"))
                .otherwise(F.col("prediction").cast("int")))
    return joined.withColumn("prediction", checked).drop("_n")
