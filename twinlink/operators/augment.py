"""Training-pair augmentation (G1-G4): flip sides, permute values, dedup.

Higher-order functions over ``attrs``; the permutation is seeded per pair with
md5 keys, so it is reproducible and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flip(pairs: DataFrame) -> DataFrame:
    """G1 (before dedup): left and right swapped, label kept; id suffixed '#f'."""
    attrs = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), a["right"].alias("left"),
                                                    a["left"].alias("right"), a["numeric"].alias("numeric")))
    return pairs.select(F.concat("pair_id", F.lit("#f")).alias("pair_id"), "dataset", "split",
                        "label", attrs.alias("attrs"))


def _shuffled(side: str, seed: int):
    def item(a, i):
        k = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("permute"), F.col("pair_id"), F.lit(side), i))
        return F.struct(k.alias("k"), a[side].alias("v"), a["numeric"].alias("n"))
    return F.array_sort(F.transform("attrs", item))


def permute(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """G2 (before dedup): each side's values permuted independently and the sides
    swapped; values land under other attributes' names.  Id suffixed '#p'."""
    d = pairs.select("*", _shuffled("left", seed).alias("_ls"), _shuffled("right", seed).alias("_rs"))
    attrs = F.transform("attrs", lambda a, i: F.struct(
        a["name"].alias("name"), F.col("_rs")[i]["v"].alias("left"), F.col("_ls")[i]["v"].alias("right"),
        (F.col("_rs")[i]["n"] & F.col("_ls")[i]["n"]).alias("numeric")))
    return d.select(F.concat("pair_id", F.lit("#p")).alias("pair_id"), "dataset", "split", "label",
                    attrs.alias("attrs"))


def _is_copy(pid):
    return pid.endswith("#f") | pid.endswith("#p")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs per dataset and split over label, names and values.  An
    original wins over an augmented copy ('#f' / '#p'); among equals the smallest id."""
    key = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), a["left"].alias("left"),
                                                  a["right"].alias("right")))
    rank = F.struct(_is_copy(F.col("pair_id")).alias("copy"), F.col("pair_id").alias("id"))
    return (pairs.withColumn("_v", key).withColumn("_rank", rank)
            .groupBy("dataset", "split", "label", "_v")
            .agg(F.min("_rank").alias("_rank"), F.min_by("attrs", "_rank").alias("attrs"))
            .select(F.col("_rank.id").alias("pair_id"), "dataset", "split", "label", "attrs"))


def flip_augment(pairs: DataFrame) -> DataFrame:
    """G1: original ∪ flipped, deduplicated."""
    return dedup_pairs(pairs.unionByName(flip(pairs)))


def permute_augment(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Original ∪ permuted, deduplicated."""
    return dedup_pairs(pairs.unionByName(permute(pairs, seed)))


def flip_permute_augment(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """G1 ∪ G2, deduplicated (the filtered input is computed once)."""
    return dedup_pairs(pairs.unionByName(flip(pairs)).unionByName(permute(pairs, seed)))
