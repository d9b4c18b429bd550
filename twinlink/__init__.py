"""twinlink: entity-matching data work as Spark DataFrame operators.

Record pairs are carried in one canonical shape for every dataset::

    pair_id STRING, dataset STRING, split STRING, label INT,
    attrs ARRAY<STRUCT<name STRING, left STRING, right STRING, numeric BOOLEAN>>

so that many datasets with different schemas run through one plan.
"""

from twinlink.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
