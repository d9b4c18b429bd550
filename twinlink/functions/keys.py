"""Hash keys for exact, reproducible sampling and permutation.

A row's key is md5 over (seed, operation, row id).  Ordering by (key, id) is
a uniform random order that Spark and SQL engines compute identically, so a
sample's members can be checked, and a sample never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_key(seed: int, op: str, *id_cols: Column | str) -> Column:
    parts = [F.lit(str(seed)), F.lit(op)]
    parts += [F.col(c) if isinstance(c, str) else c for c in id_cols]
    return F.md5(F.concat_ws("|", *parts))
