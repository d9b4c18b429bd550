"""Samples of a set size per group, for any number of groups (core of M2-M6).

A group's sample is its ``_k`` rows with the smallest (key, id), key = ``md5(seed|op|id)``.
Group sizes, sample sizes and cutoffs are tables with one row per group; nothing per group
reaches the driver.  The input is read twice:

1. one aggregate counts the groups; the caller turns the counts table into ``_k``;
2. keys are uniform, so the k-th smallest of n lies at k / n of the key space, give or
   take a few sqrt(k).  Rows beyond that band are dropped at the scan, before any shuffle;
   rows below it are surely in the sample; the others are written with them to the shared folder.

On the written rows the sure ones are counted and only the band (about ``2 * sd * sqrt(k)``
rows a group, whatever its size) is ranked for the rest: the last row taken is the group's cutoff.
The counts prove the result: a group whose cutoff lies outside its band is drawn again from
a wider one, up to the whole group, so samples are exact in every case.

With ``folds`` the groups are those of hold-out folds: a row has one key in all of them, and a
row's folds are filtered by their bounds before the row is copied into those that keep it.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlink.functions.keys import sample_key
from twinlink.tables import join_groups, written

# Keys are placed by their first 12 hex digits.
DIGITS = 12
SPACE = 16 ** DIGITS
MARGIN = (8.0, 64)


def counted(df: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` and ``_n``, one row per group."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))


def counted_by_fold(df: DataFrame, cols: list[str], folds: list[str], held: str = "dataset") -> DataFrame:
    """Group sizes within each hold-out fold (all rows but those whose ``held`` is the fold): the
    counts are copied into the folds, not the rows."""
    names = F.array(*[F.lit(f) for f in folds])
    own = counted(df, list(dict.fromkeys([held, *cols])))
    own = own.withColumn("fold", F.explode(F.filter(names, lambda f: f != F.col(held))))
    return own.groupBy("fold", *cols).agg(F.sum("_n").alias("_n"))


def planned(counts: DataFrame, parents: list[str], plan: Callable[[dict, list[dict]], list[tuple]]) -> DataFrame:
    """Sample sizes that depend on all groups of a parent and on seeded draws.

    ``plan(parent, groups)`` gives (k, want, have) for every group: the rows to take, and rows wanted
    against rows there are (``checked`` raises where more are wanted)."""
    def apply(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = plan({c: rows[0][c] for c in parents}, rows)
        for i, name in enumerate(("_k", "_want", "_have")):
            table = table.append_column(name, pa.array([s[i] for s in sizes], pa.int64()))
        return table
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    return counts.groupBy(*parents).applyInArrow(apply, f"{schema}, _k bigint, _want bigint, _have bigint")


def checked(sizes: DataFrame, what: str) -> DataFrame:
    """The written sizes; raises when a group is to give more rows than it has."""
    sizes = written(sizes, "sample-sizes")
    short = sizes.where(F.col("_want") > F.col("_have")).limit(1).collect()
    if short:
        r = short[0].asDict()
        group = {c: v for c, v in r.items() if not c.startswith("_")}
        raise ValueError(f"Cannot take a larger sample ({r['_want']}) than the population ({r['_have']}) of {what} {group}")
    return sizes.drop("_want", "_have")


def _position(key: Column) -> Column:
    return F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("long")


def _bounds(sizes: DataFrame, sd: float, rows: float) -> DataFrame:
    """``_lo``: positions below it are surely in the sample; ``_hi``: positions from it on are not."""
    k, n = F.col("_k"), F.col("_n")
    spread = F.lit(sd) * F.sqrt(k) + F.lit(float(rows))

    def at(x):
        return F.greatest(F.lit(0), F.least(F.lit(SPACE), F.ceil(x / n * F.lit(float(SPACE))).cast("long")))
    whole, none = F.lit(SPACE).cast("long"), F.lit(0).cast("long")
    return (sizes.withColumn("_lo", F.when(k >= n, whole).otherwise(at(k - spread)))
                 .withColumn("_hi", F.when(k >= n, whole).when(k <= 0, none).otherwise(at(k + spread))))


def _candidates(df, cols, sizes, seed, op, id_col, margin, held) -> DataFrame:
    """Rows below their group's upper bound, with ``_key`` and ``_sure``; a plan without an exchange of
    the input when the bounds are small enough to be broadcast by Spark."""
    keyed = df.withColumn("_key", sample_key(seed, op, F.col(id_col))).withColumn("_at", _position(F.col("_key")))
    bounds = _bounds(sizes, *margin).select(*cols, "_lo", "_hi").where(F.col("_hi") > 0)
    if held is None:
        out = join_groups(keyed, bounds, cols).where(F.col("_at") < F.col("_hi"))
    else:  # cols[0] is the fold
        per_row = bounds.groupBy(*cols[1:]).agg(F.collect_list(F.struct(cols[0], "_lo", "_hi")).alias("_folds"))
        keeps = F.filter("_folds", lambda f: (f[cols[0]] != F.col(held)) & (F.col("_at") < f["_hi"]))
        out = (join_groups(keyed, per_row, cols[1:]).withColumn("_folds", keeps).where(F.size("_folds") > 0)
               .select(*keyed.columns, F.inline("_folds")))
    return out.withColumn("_sure", F.col("_at") < F.col("_lo")).drop("_lo", "_hi", "_at")


def sample_sizes(df: DataFrame, cols: list[str], sizes: DataFrame, seed: int, op: str, id_col: str = "pair_id",
                 margin: tuple[float, float] = MARGIN, held: str | None = None) -> DataFrame:
    """Per group of ``cols`` the ``_k`` rows of ``df`` with the smallest (key, id).

    ``sizes``: ``cols``, ``_n``, ``_k`` (written); groups that are not in it are dropped.  With ``held`` the
    first of ``cols`` is the fold, which rows get a copy for."""
    parts, todo = [], sizes
    while True:
        cand = written(_candidates(df, cols, todo, seed, op, id_col, margin, held), "sample-candidates")
        tally = cand.groupBy(*cols).agg(F.count_if("_sure").alias("_s"), F.count(F.lit(1)).alias("_c"))
        found = join_groups(todo, tally, cols, "left").fillna(0, ["_s", "_c"])
        found = written(found.withColumn("_need", F.col("_k") - F.col("_s"))
                        .withColumn("_miss", (F.col("_need") < 0) | (F.col("_c") < F.least("_k", "_n"))), "sample-cutoffs")
        missed = bool(found.where("_miss").limit(1).collect())
        if missed:
            cand = join_groups(cand, found.where("not _miss").select(*cols), cols, "left_semi")
        band = join_groups(cand.where(~F.col("_sure")), found.where(~F.col("_miss") & (F.col("_need") > 0)).select(*cols, "_need"), cols)
        nth = F.row_number().over(Window.partitionBy(*cols).orderBy("_key", id_col))
        ranked = band.withColumn("_rn", nth).where(F.col("_rn") <= F.col("_need")).drop("_rn", "_need")
        parts += [cand.where("_sure"), ranked]
        if not missed:
            return reduce(DataFrame.unionByName, parts).drop("_key", "_sure")
        todo = found.where("_miss").drop("_s", "_c", "_need", "_miss")
        margin = (abs(margin[0]) * 4 + 8, abs(margin[1]) * 4 + 64)
