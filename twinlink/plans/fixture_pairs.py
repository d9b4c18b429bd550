"""Canonical pairs of the test fixture (J2 over the three fixture datasets)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.operators.pairs import build_pairs, pack_pairs
from twinlink.operators.stored_records import hot_records, materialise_stored, store_records
from twinlink.schema import SPLITS
from twinlink.sources.fixtures import FIXTURE_DATASETS, fixture_id_pairs, fixture_records


def fixture_pairs(spark: SparkSession, sf_dir: str, specs=FIXTURE_DATASETS) -> DataFrame:
    return build_pairs(specs,
                       records=lambda s: fixture_records(spark, sf_dir, s),
                       id_pairs=lambda s: fixture_id_pairs(spark, sf_dir, s))


def stored_pairs(spark: SparkSession, sf_dir: str, specs=FIXTURE_DATASETS) -> DataFrame:
    """The same pairs, split by split from record tables stored once in buckets of their id."""
    out = []
    for spec in specs:
        a, b = (store_records(df, f"{spec.name}_{side}") for side, df in zip("ab", fixture_records(spark, sf_dir, spec)))
        ids = fixture_id_pairs(spark, sf_dir, spec)
        hot = hot_records(a, b, ids)
        for split in SPLITS:
            wide = materialise_stored(a, b, ids.where(F.col("split") == split), hot=hot)
            out.append(pack_pairs(wide, spec.name, numeric=spec.numeric_names))
    return reduce(lambda x, y: x.unionByName(y), out)
