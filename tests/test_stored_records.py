"""Bucketed record tables: same rows as the plain join, no exchange of the record side, hot ids apart."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.pairs import materialise_pairs
from twinlink.operators.stored_records import hot_ids, hot_records, materialise_stored, store_records
from twinlink.sources.fixtures import FIXTURE_BY_NAME, fixture_id_pairs, fixture_records


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_splits_reuse_one_layout_without_shuffling_records(spark, no_broadcast):
    spec = FIXTURE_BY_NAME["prod"]
    a, b = fixture_records(spark, SF001, spec)
    ids = fixture_id_pairs(spark, SF001, spec)
    sa, sb = store_records(a, "a", buckets=8), store_records(b, "b", buckets=8)
    hot = hot_records(sa, sb, ids, buckets=8)
    for split in ("train", "valid", "test"):
        own = ids.where(F.col("split") == split)
        out = materialise_stored(sa, sb, own, hot=hot)
        assert out.columns == materialise_pairs(a, b, own).columns
        assert _rows(out) == _rows(materialise_pairs(a, b, own))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") >= 2
        # Between a bucketed scan and its merge join lie filters, projections and sorts, never an exchange.
        lines = plan.split("\n")
        for k, line in enumerate(lines):
            if "Bucketed: true" in line:
                above = [x for x in lines[max(k - 4, 0):k] if re.search(r"Exchange hashpartitioning", x)]
                assert not above


def test_hot_ids_nulls_repeats_and_unmatched(spark, no_broadcast):
    records = spark.createDataFrame([(i, f"n{i}", None if i % 3 else i) for i in range(40)] + [(None, "x", 1), (7, "again", 2)],
                                    "id long, name string, price long")
    ids = spark.createDataFrame([(5, i % 40, 1) for i in range(300)] + [(i, 9, 0) for i in range(60)]
                                + [(None, 3, 0), (3, None, 1), (3, 3, 1), (3, 3, 1)], "ltable_id long, rtable_id long, label int")
    assert {r[0] for r in hot_ids(ids, "ltable_id", 8).collect()} == {5}
    assert 9 in {r[0] for r in hot_ids(ids, "rtable_id", 8).collect()}
    a, b = store_records(records, "a", buckets=8), store_records(records, "b", buckets=8)
    assert _rows(materialise_stored(a, b, ids, hot=hot_records(a, b, ids, buckets=8))) == _rows(materialise_pairs(records, records, ids))


def test_empty_tables(spark):
    records = spark.createDataFrame([], "id long, name string")
    ids = spark.createDataFrame([(1, 2, 0)], "ltable_id long, rtable_id long, label int")
    stored = store_records(records, "none", buckets=4)
    assert materialise_stored(stored, stored, ids).count() == 0
    full = store_records(spark.createDataFrame([(1, "x")], "id long, name string"), "one", buckets=4)
    assert materialise_stored(full, full, ids.limit(0)).count() == 0
