"""Exact, reproducible sampling (M1-M7).

Every sample takes, per group, the k rows with the smallest
``md5(seed|op|id)`` (ties broken by id): a uniform k-subset that Spark and SQL
compute alike.  M2-M6 take sizes from a counts table of any number of groups
(``group_sampling``).  M1 and M7 take a given size:

* group sizes come from one hash aggregate collected to the driver (a handful
  of rows: datasets x labels, or attributes x labels).  The collect is bounded
  (``MAX_DRIVER_GROUPS``); M1 over more groups than that keeps the counts and
  thresholds distributed (a join with the counts table, skew split by AQE);
* k up to ``LARGE_K``: rows whose key lies above a per-group threshold are
  dropped map-side.  The threshold keeps about ``k + 8*sqrt(k) + 64`` rows of a
  group of any size, so the final per-group ranking (``row_number() <= const``;
  Spark adds a partial WindowGroupLimit when the bound is within
  ``spark.sql.optimizer.windowGroupLimitThreshold``) never sees more than that.
  This part is checkpointed to the shared checkpoint folder and its group sizes
  checked; a group short of k (probability < 1e-15) is recomputed without the
  threshold, so results are always exact;
* larger k: a histogram of key prefixes per group finds the bucket that holds
  the k-th row; lower buckets are taken whole and only that bucket is ranked, so
  a hot group is never ranked in one task;
* groups taken whole (k >= size) pass through a broadcast semi join.

Two-stage draws (all positives plus 2x negatives, then a cap; balance then cap)
split the cap between labels with a hypergeometric draw seeded by the group
(of any size), made on the counts table; then they take per-label top-k: same distribution as sampling the
union, never sorting a large class.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlink.functions.keys import sample_key
from twinlink.operators.group_sampling import (MARGIN, checked, counted, counted_by_fold, planned,
                                               sample_sizes)
from twinlink.tables import join_groups, written

MARGIN_SD = 8.0
MARGIN_ROWS = 64
# Above this k a group's top-k is selected through key buckets (no task ranks more
# than about BUCKET_ROWS rows of one group).
LARGE_K = 100_000
BUCKET_ROWS = 2_000_000
# At most this many per-group counts travel to the driver (and back as a
# broadcast parameter table of the same size).
MAX_DRIVER_GROUPS = 100_000


class TooManyGroups(ValueError):
    pass


def group_counts(df: DataFrame, cols: list[str], max_groups: int = MAX_DRIVER_GROUPS) -> dict[tuple, int]:
    """Sizes per group (one row per group: datasets x labels and the like).

    Never collects more than ``max_groups + 1`` rows; raises ``TooManyGroups`` beyond."""
    rows = df.groupBy(*cols).count().limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise TooManyGroups(f"more than {max_groups} groups of {cols}")
    return {tuple(r[c] for c in cols): int(r["count"]) for r in rows}


def _threshold(k: int, n: int, margin_sd: float, margin_rows: int) -> str | None:
    """Hex prefix bound keeping ~k + margin of n uniformly keyed rows; None = keep all."""
    mu = k + margin_sd * math.sqrt(k) + margin_rows
    if mu >= n:
        return None
    return f"{min(math.ceil(mu / n * 2 ** 32), 2 ** 32 - 1):08x}"


def _group_table(df: DataFrame, cols: list[str], rows: dict[tuple, tuple], names: list[str],
                 types: list[str]) -> DataFrame:
    """Per-group parameters built on the driver from collected counts: one row per
    group, at most ``MAX_DRIVER_GROUPS`` rows (the proven size bound of its broadcast)."""
    if len(rows) > MAX_DRIVER_GROUPS:
        raise TooManyGroups(f"{len(rows)} parameter rows")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols]
                       + [f"{n} {t}" for n, t in zip(names, types)])
    return df.sparkSession.createDataFrame([tuple(g) + tuple(v) for g, v in rows.items()], schema)


def _keep_groups(df: DataFrame, group_cols: list[str], groups: set) -> DataFrame:
    """Rows of the listed groups, whole (k >= group size): a broadcast semi join."""
    if not group_cols:
        return df
    table = _group_table(df, group_cols, {g: () for g in groups}, [], [])
    return join_groups(df, table, group_cols, "left_semi", broadcast=True)


def _take_small(df: DataFrame, group_cols: list[str], k: dict[tuple, int], n: dict[tuple, int],
                key: str, id_col: str, margin_sd: float, margin_rows: int,
                no_threshold: set | None = None) -> DataFrame:
    """Top-k for k up to LARGE_K: drop rows above the group's key threshold map-side,
    then rank what is left (about k + margin rows per group)."""
    no_threshold = no_threshold or set()
    params = {g: (kk, None if g in no_threshold else _threshold(kk, n[g], margin_sd, margin_rows))
              for g, kk in k.items()}
    if not group_cols:
        kk, thr = params[()]
        d = df if thr is None else df.where(F.substring(F.col(key), 1, 8) < F.lit(thr))
        return d.orderBy(F.col(key), F.col(id_col)).limit(kk)
    table = _group_table(df, group_cols, params, ["_k", "_thr"], ["int", "string"])
    d = join_groups(df, table, group_cols, "inner", broadcast=True)
    d = d.where(F.col("_thr").isNull() | (F.substring(F.col(key), 1, 8) < F.col("_thr")))
    w = Window.partitionBy(*group_cols).orderBy(F.col(key), F.col(id_col))
    return (d.withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= F.lit(max(k.values())))
             .where(F.col("_rn") <= F.col("_k"))
             .drop("_rn", "_k", "_thr"))


def _bucket_digits(n: int) -> int:
    """Hex digits of the key prefix that cut a group of n rows into buckets of about
    BUCKET_ROWS rows (16**digits buckets)."""
    return max(1, min(8, math.ceil(math.log(max(n, 2) / BUCKET_ROWS, 16))))


def _take_large(df: DataFrame, group_cols: list[str], k: dict[tuple, int], n: dict[tuple, int],
                key: str, id_col: str) -> DataFrame:
    """Exact top-k for large k without ranking a whole group in one task.

    Keys are uniform, so their hex prefix cuts each group into buckets of about
    BUCKET_ROWS rows.  A histogram (hash aggregate, one row per group and bucket)
    and a running sum over it find, per group, the bucket holding the k-th row and
    how many rows of it are needed.  Rows in lower buckets are taken as they are;
    only the boundary bucket is ranked.  Exact by construction."""
    cols = list(group_cols)
    if not cols:
        df, cols = df.withColumn("_grp", F.lit(0)), ["_grp"]
        k, n = {(0,): k[()]}, {(0,): n[()]}
    digits = max(_bucket_digits(n[g]) for g in k)
    table = _group_table(df, cols, {g: (kk,) for g, kk in k.items()}, ["_k"], ["long"])
    x = (join_groups(df, table, cols, "inner", broadcast=True)
         .withColumn("_b", F.conv(F.substring(F.col(key), 1, digits), 16, 10).cast("long")))
    hist = x.groupBy(*cols, "_k", "_b").agg(F.count(F.lit(1)).alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*cols).orderBy("_b")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = (hist.withColumn("_below", below)
                .where((F.col("_below") < F.col("_k")) & (F.col("_below") + F.col("_c") >= F.col("_k")))
                .select(*cols, F.col("_b").alias("_edge"), (F.col("_k") - F.col("_below")).alias("_need")))
    rows = edge.collect()                       # one row per group listed in ``k``
    bounds = _group_table(df, cols, {tuple(r[c] for c in cols): (r["_edge"], r["_need"]) for r in rows},
                          ["_edge", "_need"], ["long", "long"])
    y = join_groups(x, bounds, cols, "inner", broadcast=True)
    w = Window.partitionBy(*cols).orderBy(F.col(key), F.col(id_col))
    ranked = (y.where(F.col("_b") == F.col("_edge")).withColumn("_rn", F.row_number().over(w))
               .where(F.col("_rn") <= F.col("_need")).drop("_rn"))
    out = y.where(F.col("_b") < F.col("_edge")).unionByName(ranked)
    return out.drop("_k", "_b", "_edge", "_need", *(["_grp"] if not group_cols else []))


def _split_groups(k: dict[tuple, int], n: dict[tuple, int], large_k: int):
    """Route groups: taken whole through a semi join when large; whole groups of at most
    ``large_k`` rows join the ranked ones (k = n), so one pass over the input serves
    both; ranked groups by the size of k."""
    whole = {g for g, kk in k.items() if 0 < kk and kk >= n.get(g, 0) > large_k}
    small = {g: min(kk, n.get(g, 0)) for g, kk in k.items()
             if 0 < kk and min(kk, n.get(g, 0)) <= large_k and n.get(g, 0) > 0}
    large = {g: kk for g, kk in k.items() if large_k < kk < n.get(g, 0)}
    return whole, small, large


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else empty.where(F.lit(False))


def take_smallest(df: DataFrame, group_cols: list[str], k: dict[tuple, int], n: dict[tuple, int],
                  key: str = "_key", id_col: str = "pair_id", margin_sd: float = MARGIN_SD,
                  margin_rows: int = MARGIN_ROWS, no_threshold: set | None = None,
                  large_k: int = LARGE_K) -> DataFrame:
    """Per group, the ``k[g]`` rows smallest by (key, id).  Groups absent from ``k`` or
    with k = 0 are dropped; groups with k >= size pass through without ranking; large
    k goes through key buckets.  Group parameters reach the rows through broadcast
    joins with small driver-built tables (not literal CASE chains, which grow the
    generated code with the number of groups)."""
    whole, small, large = _split_groups(k, n, large_k)
    parts = []
    if whole:
        parts.append(_keep_groups(df, group_cols, whole))
    if large:
        parts.append(_take_large(df, group_cols, large, n, key, id_col))
    if small:
        parts.append(_take_small(df, group_cols, small, n, key, id_col, margin_sd, margin_rows, no_threshold))
    return _union(parts, df)


def sample_groups(df: DataFrame, group_cols: list[str], k: dict[tuple, int], n: dict[tuple, int],
                  seed: int, op: str, id_col: str = "pair_id", materialize: bool = True,
                  margin_sd: float = MARGIN_SD, margin_rows: int = MARGIN_ROWS,
                  large_k: int = LARGE_K) -> DataFrame:
    """Exact per-group sample (M1 core).

    Whole groups and large-k groups are exact by construction and stay lazy.  With
    ``materialize`` the threshold-pruned part (at most LARGE_K rows per group) is
    checkpointed and its group sizes verified; a short group is recomputed without
    the threshold."""
    keyed = df.withColumn("_key", sample_key(seed, op, F.col(id_col)))
    whole, small, large = _split_groups(k, n, large_k)
    parts = []
    if whole:
        parts.append(_keep_groups(keyed, group_cols, whole))
    if large:
        parts.append(_take_large(keyed, group_cols, large, n, "_key", id_col))
    if small:
        out = _take_small(keyed, group_cols, small, n, "_key", id_col, margin_sd, margin_rows)
        if materialize:
            out = out.checkpoint(eager=True)
            got = group_counts(out, group_cols) if group_cols else {(): out.count()}
            short = {g: kk for g, kk in small.items() if got.get(g, 0) < kk}
            if short:
                redo = _take_small(keyed, group_cols, short, n, "_key", id_col, margin_sd, margin_rows,
                                   no_threshold=set(short))
                keep = (join_groups(out, _group_table(out, group_cols, {g: () for g in short}, [], []),
                                     group_cols, "left_anti", broadcast=True)
                        if group_cols else out.where(F.lit(False)))
                out = keep.unionByName(redo).checkpoint(eager=True)
        parts.append(out)
    return _union(parts, keyed).drop("_key")


def _check_pool(need: int, have: int, what: str):
    if need > have:
        raise ValueError(f"Cannot take a larger sample ({need}) than the population ({have}) of {what}")


def _rng(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng([seed] + [zlib.crc32(repr(p).encode()) for p in parts])


def sample_exact(df: DataFrame, n: int, seed: int, op: str = "sample", by: list[str] | None = None,
                 id_col: str = "pair_id", materialize: bool = True,
                 max_driver_groups: int = MAX_DRIVER_GROUPS, large_k: int = LARGE_K) -> DataFrame:
    """M1: exactly ``n`` rows per group (uniform, deterministic); raises when a group has fewer."""
    by = list(by or [])
    try:
        counts = group_counts(df, by, max_driver_groups) if by else {(): df.count()}
    except TooManyGroups:
        return _sample_exact_distributed(df, n, seed, op, by, id_col, materialize)
    for g, c in counts.items():
        _check_pool(n, c, f"group {g}")
    return sample_groups(df, by, {g: n for g in counts}, counts, seed, op, id_col, materialize,
                         large_k=large_k)


def _threshold_col(k: int, n: Column, margin_sd: float = MARGIN_SD, margin_rows: int = MARGIN_ROWS) -> Column:
    """``_threshold`` as a column of the group size ``n`` (null = keep the whole group)."""
    mu = k + margin_sd * math.sqrt(k) + margin_rows
    bound = F.least(F.ceil(F.lit(mu) / n * F.lit(float(2 ** 32))), F.lit(2 ** 32 - 1)).cast("long")
    return F.when(n > F.lit(mu), F.lower(F.lpad(F.hex(bound), 8, "0")))


def _sample_exact_distributed(df: DataFrame, n: int, seed: int, op: str, by: list[str], id_col: str,
                              materialize: bool) -> DataFrame:
    """M1 over very many groups: counts and thresholds stay distributed.

    The counts table joins back on the group keys (AQE broadcasts it when small
    and splits a hot group otherwise); rows above their group's threshold drop
    before the bounded ranking."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if counts.where(F.col("_n") < n).limit(1).count():
        raise ValueError(f"Cannot take a larger sample ({n}) than the population of a group of {by}")
    keyed = df.withColumn("_key", sample_key(seed, op, F.col(id_col)))

    def ranked(params: DataFrame, use_threshold: bool) -> DataFrame:
        d = join_groups(keyed, params, by)
        if use_threshold:
            d = d.where(F.col("_thr").isNull() | (F.substring("_key", 1, 8) < F.col("_thr")))
        w = Window.partitionBy(*by).orderBy(F.col("_key"), F.col(id_col))
        return (d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(n))
                 .drop("_rn", "_n", "_thr"))

    out = ranked(counts.withColumn("_thr", _threshold_col(n, F.col("_n"))), True)
    if not materialize:
        return out.drop("_key")
    out = out.checkpoint(eager=True)
    got = out.groupBy(*by).agg(F.count(F.lit(1)).alias("_got"))
    short = join_groups(counts, got, by, "left").where(F.coalesce(F.col("_got"), F.lit(0)) < F.lit(n)) \
        .select(*by, "_n").withColumn("_thr", F.lit(None).cast("string"))
    if short.limit(1).count():
        short = short.checkpoint(eager=True)
        redo = ranked(short, False)
        out = join_groups(out, short.select(*by), by, "left_anti").unionByName(redo).checkpoint(eager=True)
    return out.drop("_key")


# NumPy's hypergeometric draws refuse pools of this many rows.
NUMPY_POOL = 10 ** 9


def _draw(rng: np.random.Generator, sizes: list[int], k: int, many: bool = False) -> list[int]:
    """How many of ``k`` rows drawn without replacement fall into each class of ``sizes`` rows
    (two classes, or any number when ``many``).

    From ``NUMPY_POOL`` rows on, the rows are drawn one after the other in whole numbers: the same
    distribution at any pool size, in k steps."""
    if sum(sizes) < NUMPY_POOL:
        if not many:
            first = int(rng.hypergeometric(*sizes, k))
            return [first, k - first]
        return [int(x) for x in rng.multivariate_hypergeometric(sizes, k)]
    left, total = list(sizes), sum(sizes)
    for step in range(k):
        at = int(rng.integers(total - step))
        for c, n in enumerate(left):
            if at < n:
                left[c] -= 1
                break
            at -= n
    return [n - m for n, m in zip(sizes, left)]


def one_pos_two_neg(train: DataFrame, seed: int = 42, small_set: int = 1200, cap: int = 1200) -> DataFrame:
    """M2 + M3 per dataset: sets under ``small_set`` rows are kept whole; otherwise all
    positives and 2x as many negatives, then a uniform ``min(cap, 3*pos)`` of that union."""
    def plan(parent, groups):
        n = {g["label"]: g["_n"] for g in groups}
        pos, neg = n.get(1, 0), n.get(0, 0)
        k, want = {1: pos, 0: neg}, 0
        if pos + neg >= small_set:
            want = 2 * pos
            k[0] = want
            if want <= neg and 3 * pos > cap:
                k[1], k[0] = _draw(_rng(seed, "one_pos_two_neg", parent["dataset"]), [pos, 2 * pos], cap)
        return [(k.get(g["label"], 0), want, neg) for g in groups]
    cols = ["dataset", "label"]
    sizes = checked(planned(counted(train, cols), ["dataset"], plan), "negatives of")
    return sample_sizes(train, cols, sizes, seed, "one_pos_two_neg")


def automl_filter(train: DataFrame, seed: int = 42, small_set: int = 1200, max_pos: int = 400) -> DataFrame:
    """M4: hard-positive selection.  ``train`` carries ``prediction``.

    Per dataset of at least ``small_set`` rows: n = min(max_pos, #positives);
    misclassified positives first (a uniform n of them if there are more; a null prediction counts
    as wrong), topped up with correctly predicted ones; 2n negatives uniform over all negatives.
    """
    right = F.coalesce(F.col("prediction") == F.col("label"), F.lit(False)).cast("string")
    d = train.withColumn("_sub", F.when(F.col("label") == 1, right).otherwise(F.lit("any")))
    cols = ["dataset", "label", "_sub"]
    own = Window.partitionBy("dataset")

    def rows_of(sub, label):
        return F.coalesce(F.sum(F.when((F.col("_sub") == sub) & (F.col("label") == label), F.col("_n"))).over(own), F.lit(0))
    wrong, good, neg = rows_of("false", 1), rows_of("true", 1), rows_of("any", 0)
    sampled = F.sum("_n").over(own) >= small_set
    most = F.least(F.lit(max_pos), wrong + good)
    k = (F.when(~sampled, F.col("_n")).when(F.col("_sub") == "false", F.least(wrong, most))
         .when(F.col("_sub") == "true", most - F.least(wrong, most)).when(F.col("label") == 0, 2 * most).otherwise(F.lit(0)))
    sizes = counted(d, cols).select(*cols, "_n", k.cast("long").alias("_k"),
                                    F.when(sampled, 2 * most).otherwise(F.lit(0)).cast("long").alias("_want"), neg.alias("_have"))
    return sample_sizes(d, cols, checked(sizes, "negatives of"), seed, "automl_filter").drop("_sub")


def balance_attribute_pairs(attr_pairs: DataFrame, seed: int = 1, cap: int | None = 800, by=(),
                            eval_cap: int | None = None, folds: list[str] | None = None,
                            margin: tuple[float, float] = MARGIN) -> DataFrame:
    """M5 (+ M6 when ``cap``): per split and attribute, across datasets, every label cut to
    the smallest label count present (a one-label group stays whole); then a uniform
    ``cap`` rows of the balanced group if it is larger.  ``cap`` holds for the train split;
    the other splits are evaluation rows and cut only to an ``eval_cap``.  Rows without an attribute leave.
    ``by`` adds grouping columns; ``folds`` balances every hold-out fold over its own datasets and
    adds ``fold`` (rows are copied only into the folds that keep them).  ``margin`` (standard deviations, rows)
    is the width of the sampler's band; it changes no result."""
    known = attr_pairs.where(F.col("attribute").isNotNull())
    own = [*by, "split", "attribute"]
    parents = (["fold"] if folds else []) + own
    counts = counted_by_fold(known, [*own, "label"], folds) if folds else counted(known, [*own, "label"])
    least = F.min("_n").over(Window.partitionBy(*parents))
    if cap is None and eval_cap is None:
        sizes = written(counts.withColumn("_k", least), "sample-sizes")
    else:
        def plan(parent, groups):
            order = sorted(range(len(groups)), key=lambda i: (groups[i]["label"] is None, groups[i]["label"]))
            m = min(g["_n"] for g in groups)
            most = cap if parent["split"] == "train" else eval_cap
            k = [m] * len(groups)
            if most is not None and m * len(groups) > most:
                # The draw's seed names the group by its own columns; folds draw apart.
                rng = _rng(seed, "balance_cap", tuple(parent[c] for c in parents))
                draws = [most] if len(groups) == 1 else _draw(rng, k, most, many=True)
                for i, n in zip(order, draws):
                    k[i] = n
            return [(n, 0, 0) for n in k]
        sizes = written(planned(counts, parents, plan).drop("_want", "_have"), "sample-sizes")
    return sample_sizes(known, [*parents, "label"], sizes, seed, "balance_attr", id_col="attr_pair_id",
                        margin=margin, held="dataset" if folds else None)


def validation_subsample(valid: DataFrame, epoch: int, n: int = 2000, base_seed: int = 42,
                         id_col: str = "pair_id", materialize: bool = True) -> DataFrame:
    """M7: the validation set, or a uniform ``n`` of it when larger, reseeded per epoch."""
    total = valid.count()
    if total <= n:
        return valid
    return sample_groups(valid, [], {(): n}, {(): total}, base_seed + epoch, "valid_subsample",
                         id_col=id_col, materialize=materialize)
