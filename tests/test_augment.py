"""G1-G4 properties."""

from collections import Counter

from twinlink.operators import augment as G
from twinlink.schema import PAIR_SCHEMA

ROWS = [("d|1|2", "d", "train", 1, [("a", "x", "y", False), ("b", "1", "2", True), ("c", None, "z", False)]),
        ("d|2|1", "d", "train", 1, [("a", "y", "x", False), ("b", "2", "1", True), ("c", "z", None, False)])]


def test_flip_twice_is_identity(spark):
    df = spark.createDataFrame(ROWS, PAIR_SCHEMA)
    back = G.flip(G.flip(df)).collect()
    assert [r.attrs for r in back] == [r.attrs for r in df.collect()]


def test_flip_dedup_keeps_originals(spark):
    df = spark.createDataFrame(ROWS, PAIR_SCHEMA)
    out = G.flip_augment(df).collect()
    assert sorted(r.pair_id for r in out) == ["d|1|2", "d|2|1"]   # each flip equals the other original


def test_permute_keeps_each_side_multiset(spark):
    df = spark.createDataFrame(ROWS[:1], PAIR_SCHEMA)
    p = G.permute(df).first()
    o = df.first()
    assert Counter(a.left for a in p.attrs) == Counter(a.right for a in o.attrs)
    assert Counter(a.right for a in p.attrs) == Counter(a.left for a in o.attrs)
    assert [a.name for a in p.attrs] == [a.name for a in o.attrs]
    assert G.permute(df).first().attrs == p.attrs   # seeded
