"""A1-A5: the attribute label cascade on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from twinlink.operators.attributes import attribute_label, explode_attribute_pairs

CASES = [
    # left, right, numeric, row label, expected
    (None, "--", False, 0, 1),          # both null
    (None, "x", False, 1, 0),           # one null
    ("Nan", "x", False, 0, 0),          # null tokens are case-specific
    ("iPhone 12", "IPHONE 12 black", False, 0, 1),  # contained after lower-casing
    ("abc", "xyz", False, 1, 1),        # different text, positive row
    ("abc", "xyz", False, 0, 0),        # different text, negative row
    ("10", "11", True, 1, 0),           # numeric: row label ignored
    ("10", "10.0", True, 0, 1),         # numeric equal
    ("10", "10 USD", True, 0, 1),       # only one side numeric -> text, contained
    ("a%b", "axxb", False, 0, 0),       # wildcard characters are literal
    ("", "NULL", False, 1, 1),          # empty and NULL are both null tokens
    ("-", "abc", False, 1, 0),
    (" nan", "abc", False, 0, 0),       # untrimmed: not a null token
]


def test_label_cascade(spark):
    df = spark.createDataFrame(CASES, "l string, r string, num boolean, row_label int, expected int")
    got = df.select(attribute_label(F.col("l"), F.col("r"), F.col("num"), F.col("row_label")).alias("g"),
                    "expected").collect()
    assert [r.g for r in got] == [r.expected for r in got]


def test_explode_keeps_names_and_row_label(spark):
    from twinlink.schema import PAIR_SCHEMA
    rows = [("d|1|2", "d", "train", 1, [("name", "a", "A b", False), ("price", "1", None, True)])]
    out = explode_attribute_pairs(spark.createDataFrame(rows, PAIR_SCHEMA)).orderBy("attribute").collect()
    assert [(r.attribute, r.label) for r in out] == [("name", 1), ("price", 0)]


def test_plan_has_no_python(spark):
    from twinlink.plans.fixture_pairs import fixture_pairs
    from twinlink.operators.attributes import attribute_pairs
    from conftest import SF001
    plan = attribute_pairs(fixture_pairs(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
