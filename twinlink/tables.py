"""Intermediate tables in the shared checkpoint folder, and joins on group keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlink.session import scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: it is
    computed once, survives lost executors, and Spark knows its size when it plans a join."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner",
                broadcast: bool = False) -> DataFrame:
    """Equi-join on group keys where null keys match (groupBy treats null as a group).
    ``broadcast`` only for a right side of proven small size (a driver-built table)."""
    r = right.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in right.columns if c not in by])
    r = F.broadcast(r) if broadcast else r
    cond = [left[c].eqNullSafe(r[f"_g_{c}"]) for c in by]
    out = left.join(r, cond, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*[f"_g_{c}" for c in by])


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``, from 0, the row's place in its ``group`` by ``order``; no task ever holds a group.

    Rows are range-sorted by (group, order) and written; a row's rank is its place in its sorted partition plus
    the rows of its group in the partitions before, which a table of one row per partition and group tells.
    Equal rows may be cut between partitions (a row number breaks ties)."""
    placed = written(df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*group, *order, "_tie").drop("_tie")
                     .withColumn("_pos", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_pos", 33)), name)
    runs = placed.groupBy(*group, "_part").agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_shift")
    out = join_groups(placed, written(runs.select(*group, "_part", shift), name), [*group, "_part"])
    return out.withColumn("rank", F.col("_pos") + F.col("_shift")).drop("_pos", "_part", "_shift")
