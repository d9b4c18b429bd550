"""Synthetic pair fixture derived from the TPC-H-style test tables.

Three datasets with different schemas.  The B side of each record table is the
A side with one controlled change per ``id % 5``; labelled id pairs link every
record to itself and to three other records.  Every step is a Spark
expression over the source table, so the fixture grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.schema import Attr, DatasetSpec

FIXTURE_DATASETS = (
    DatasetSpec("prod", "part", "p_partkey", (
        Attr("name", "p_name"), Attr("brand", "p_brand"), Attr("ptype", "p_type"),
        Attr("price", "p_retailprice", numeric=True))),
    DatasetSpec("cust", "customer", "c_custkey", (
        Attr("name", "c_name"), Attr("brand", "c_mktsegment"),
        Attr("price", "c_acctbal", numeric=True))),
    DatasetSpec("supp", "supplier", "s_suppkey", (
        Attr("name", "s_name"), Attr("price", "s_acctbal", numeric=True))),
)

FIXTURE_BY_NAME = {d.name: d for d in FIXTURE_DATASETS}
PARTNERS_PER_RECORD = 4


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_records(spark: SparkSession, sf_dir: str, spec: DatasetSpec) -> tuple[DataFrame, DataFrame]:
    """Record tables A and B: ``id`` plus the spec's attributes (numeric ones keep their type)."""
    src = read_table(spark, sf_dir, spec.table)
    a = src.select(F.col(spec.id_col).alias("id"),
                   *[F.col(at.column).alias(at.name) for at in spec.attrs])
    m = F.col("id") % 5
    cols = [F.col("id")]
    for at in spec.attrs:
        c = F.col(at.name)
        if at.name == "name":
            c = F.when(m == 1, F.upper(c)).when(m == 3, F.concat(c, F.lit(" new"))).otherwise(c)
        elif at.name == "price":
            c = F.when(m == 2, F.lit(None).cast(a.schema[at.name].dataType)).otherwise(c)
        elif at.name == "brand":
            c = F.when(m == 4, F.lit("-")).otherwise(c)
        cols.append(c.alias(at.name))
    return a, a.select(*cols)


def split_of(pair_id) -> F.Column:
    """Deterministic split from the first hex digit of md5(pair_id)."""
    h = F.substring(F.md5(pair_id), 1, 1)
    return F.when(h < "a", "train").when(h < "d", "valid").otherwise("test")


def fixture_id_pairs(spark: SparkSession, sf_dir: str, spec: DatasetSpec) -> DataFrame:
    """Labelled id pairs ``(ltable_id, rtable_id, label, split, pair_id)``.

    The table size enters as a scalar subquery; duplicates of a record's
    partners are removed inside the row (array_distinct), so no shuffle.
    """
    src = read_table(spark, sf_dir, spec.table)
    n = src.select(F.count(F.lit(1))).scalar()
    k = F.col(spec.id_col)
    src = src.select(k.alias("ltable_id"), n.alias("_n"))        # the subquery is referenced once
    k, n = F.col("ltable_id"), F.col("_n")
    partners = [k] + [(k * 7 + j * 13 + 1) % n for j in range(1, PARTNERS_PER_RECORD)]
    ids = src.select("ltable_id", F.explode(F.array_distinct(F.array(*partners))).alias("rtable_id"))
    pair_id = F.concat_ws("|", F.lit(spec.name), F.col("ltable_id"), F.col("rtable_id"))
    return (ids.withColumn("label", (F.col("ltable_id") == F.col("rtable_id")).cast("int"))
               .withColumn("pair_id", pair_id)
               .withColumn("split", split_of(F.col("pair_id"))))
