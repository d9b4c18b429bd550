"""E1 ingest: raw files -> canonical pairs.

* record CSVs (S1, P1 positional names, P2 drops, P9 null tokens) and the labelled
  id-pair CSVs of the three splits (S2) -> J1 -> P5;
* pre-joined pair exports (S3) with per-split column rules (P3 renames, P6/P7 price
  and currency, P8 price dropped on test) -> P5.

Both end in ``pairs`` that K1 writes once, partitioned by dataset and split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from twinlink.operators.pairs import materialise_pairs, pack_pairs
from twinlink.plans.exports import ExportSpec, export_pairs
from twinlink.schema import DatasetSpec
from twinlink.sources.files import read_id_pairs, read_record_table


def csv_pairs(spark: SparkSession, spec: DatasetSpec, table_a: str, table_b: str,
              id_pairs: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """One dataset from its raw files: ``table_a``/``table_b`` CSVs (renamed by position
    to ``id`` + the spec's attributes) and ``{split: csv}`` of labelled id pairs."""
    names = ["id"] + spec.attr_names
    a = read_record_table(spark, table_a, names, drop=drop)
    b = read_record_table(spark, table_b, names, drop=drop)
    ids = read_id_pairs(spark, id_pairs)
    wide = materialise_pairs(a, b, ids)
    return pack_pairs(wide, spec.name, numeric=spec.numeric_names - set(drop))


def prejoined_pairs(spark: SparkSession, dataset: str, paths: dict[str, str],
                    titles: tuple[str, str] = ("title", "name"), id_col: str | None = None,
                    fmt: str = "parquet") -> DataFrame:
    """Product-offer exports with columns ``<a>_left``, ``label``, ``<a>_right`` for
    ``a`` in (title, price, priceCurrency), one path per split.

    train: price and currency merged strictly (currency first, null if either is);
    valid: merged leniently (price first, missing parts print 'nan'); test: title only.
    ``titles`` renames the title attribute.  Without ``id_col`` a pair's id is its content
    hash and its number among equal rows (``plans.exports``, which takes any other schema too).
    """
    out = []
    for split, path in paths.items():
        title = (titles[1], titles[0])
        spec = (ExportSpec((title,), id_col=id_col) if split == "test" else
                ExportSpec((title, ("price", "price")), "price", "priceCurrency", split == "valid", id_col=id_col))
        out.append(export_pairs(spark, dataset, split, path, spec, fmt))
    return reduce(lambda x, y: x.unionByName(y), out)
