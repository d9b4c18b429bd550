"""File sources (S1-S7) and sinks (K1-K4).

Record CSVs are read once (multi-line CSV does not split) and stored as Parquet
partitioned by ``dataset`` and ``split``; later stages read Parquet with
partition pruning and column pruning.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.functions.nulls import CSV_NA_TOKENS, normalise_null_tokens
from twinlink.schema import ATTR_PAIR_SCHEMA, PAIR_SCHEMA, PREDICTION_SCHEMA


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Header CSV, every column as text.  With ``multi_line`` quoted fields may span lines, and a
    file is read by one task; without it files are split."""
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
            .option("inferSchema", False).csv(path))


def align_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename by position; the count must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"Length mismatch: expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop attributes no consumer uses, before any join."""
    return df.drop(*cols)


def read_record_table(spark: SparkSession, path: str, names: list[str], drop: Iterable[str] = (),
                      na_tokens=CSV_NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """S1 + P1 + P2 + P9: a record table with positional names and missing values as null."""
    df = drop_columns(align_columns(read_csv_text(spark, path, multi_line), names), drop)
    return df.select(*[normalise_null_tokens(F.col(c), na_tokens).alias(c) for c in df.columns])


def read_id_pairs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Labelled id pairs of each split file, ``split`` from the file's role.  Ids hold no
    line breaks, so the files are split."""
    out = None
    for split, path in paths.items():
        d = (read_csv_text(spark, path, multi_line=False)
             .select("ltable_id", "rtable_id", F.col("label").cast("int").alias("label"))
             .withColumn("split", F.lit(split)))
        out = d if out is None else out.unionByName(d)
    return out


def read_prejoined(spark: SparkSession, path: str, used: list[str], renamed: list[str],
                   fmt: str = "parquet") -> DataFrame:
    """S3 + P3: a pre-joined pair export, a column subset in a given order, renamed."""
    if len(used) != len(renamed):
        raise ValueError("used and renamed differ in length")
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(u).alias(r) for u, r in zip(used, renamed)])


def _prune(df: DataFrame, dataset=None, split=None) -> DataFrame:
    if dataset is not None:
        df = df.where(F.col("dataset").isin(*([dataset] if isinstance(dataset, str) else dataset)))
    if split is not None:
        df = df.where(F.col("split").isin(*([split] if isinstance(split, str) else split)))
    return df


def read_pairs(spark: SparkSession, root: str, dataset=None, split=None) -> DataFrame:
    """Canonical pairs; dataset and split filters prune partitions."""
    return _prune(spark.read.schema(PAIR_SCHEMA).parquet(root), dataset, split).select(
        "pair_id", "dataset", "split", "label", "attrs")


def read_attribute_pairs(spark: SparkSession, root: str, dataset=None, split=None) -> DataFrame:
    """Stored attribute pairs."""
    return _prune(spark.read.schema(ATTR_PAIR_SCHEMA).parquet(root), dataset, split).select(
        "attr_pair_id", "dataset", "split", "attribute", "left_value", "right_value", "label")


def read_predictions(spark: SparkSession, root: str, dataset=None, with_dataset: bool = False) -> DataFrame:
    """Stored predictions keyed by pair_id (J3 attaches them by that key)."""
    return _prune(spark.read.schema(PREDICTION_SCHEMA).parquet(root), dataset).select(
        "pair_id", *(["dataset"] if with_dataset else []), "prediction", "proba_0", "proba_1")


def _write_partitions(df: DataFrame, root: str, mode: str, by: list[str]) -> None:
    """Parquet under ``by`` folders.  Rows are rebalanced by them, so that a folder gets few files and a
    large one several of even size; ``overwrite`` replaces the folders that ``df`` holds and leaves the others."""
    (df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(root))


def write_pairs(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """K1 / K2: Parquet partitioned by dataset and split; ``overwrite`` replaces these partitions only."""
    _write_partitions(df, root, mode, ["dataset", "split"])


def write_predictions(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """K3: predictions (with their dataset column) partitioned by dataset."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTION_SCHEMA if f.name in df.columns],
                      *[c for c in df.columns if c not in PREDICTION_SCHEMA.names])
    _write_partitions(typed, root, mode, ["dataset"])


def dump_predictions(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4: prediction / ground-truth pairs as JSON lines."""
    scored.select("pair_id", "prediction", "label").write.mode(mode).json(path)
