"""Record tables stored once in buckets of their id, joined without being shuffled again.

``store_records`` writes a record table as a bucketed table; ``materialise_stored`` joins any number of id-pair
sets (splits, later label files) to it.  Only the id pairs move to the buckets; the record side is read as it
lies.  A merge join with a bucketed side is never split by the adaptive planner, so ids that fill a task by
themselves are found first and joined apart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlink.session import scratch_dir
from twinlink.tables import written

# An id is hot if it holds at least this part of a mean bucket's id pairs; so there are at most buckets * 4 of them.
HOT_SHARE = 4


def store_records(records: DataFrame, name: str, id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """``records`` written once, one file a bucket of ``id_col``, sorted by it; the stored table.

    The table is external, in the shared checkpoint folder, under a fresh catalog name.  Rows with equal ids share a
    bucket: for record tables in which one id holds much of the rows, ``materialise_pairs`` is the better way.
    Null ids match no pair and are left out; an empty table gives an empty table."""
    spark = records.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"records_{name}_{uuid.uuid4().hex[:12]}"
    (records.where(F.col(id_col).isNotNull()).repartition(n, id_col).write.bucketBy(n, id_col).sortBy(id_col)
     .option("path", scratch_dir(spark, table)).format("parquet").saveAsTable(table))
    return spark.read.table(table)


def hot_ids(id_pairs: DataFrame, key: str, buckets: int) -> DataFrame:
    """The values of ``key`` with at least 1 / (4 * ``buckets``) of all id pairs, so at most 4 * ``buckets`` rows, written."""
    total = id_pairs.agg(F.count(key)).first()[0]
    counts = id_pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return written(counts.where(F.col("n") * (HOT_SHARE * buckets) >= total).select(key), "hot-ids")


def hot_records(a: DataFrame, b: DataFrame, id_pairs: DataFrame, id_col: str = "id",
                buckets: int | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For both id columns the hot ids and their records, written; found once for all splits of ``id_pairs``."""
    n = buckets or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for key, records in (("ltable_id", a), ("rtable_id", b)):
        hot = F.broadcast(hot_ids(id_pairs, key, n))
        out[key] = (hot, written(records.withColumnRenamed(id_col, key).join(hot, key, "left_semi"), "hot-records"))
    return out


def materialise_stored(a: DataFrame, b: DataFrame, id_pairs: DataFrame, id_col: str = "id",
                       hot: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """J1 over stored record tables: the rows and columns of ``materialise_pairs``.

    Pairs of hot ids are joined to the few hot records, which Spark broadcasts if their measured size allows it; all
    others bucket by bucket.  ``hot`` (``hot_records`` of all splits) only decides which way a pair takes; without it
    it is found for these pairs.  Inner joins: id pairs without a record, and null ids, vanish; repeated pairs and
    records fan out."""
    hot = hot or hot_records(a, b, id_pairs, id_col)
    attrs = [c for c in a.columns if c != id_col]
    joined = id_pairs
    for key, records, side in (("ltable_id", a, "l"), ("rtable_id", b, "r")):
        ids, few = hot[key]

        def named(df, own):
            return df.select(F.col(own).alias(key), *[F.col(c).alias(f"{c}_{side}") for c in attrs])
        rest = joined.join(ids, key, "left_anti").join(named(records, id_col), key)
        joined = rest.unionByName(joined.join(named(few, key), key))
    extra = [c for c in id_pairs.columns if c not in ("ltable_id", "rtable_id", "label")]
    return joined.select("ltable_id", "rtable_id", *extra, *[f"{c}_l" for c in attrs],
                         "label", *[f"{c}_r" for c in attrs])
