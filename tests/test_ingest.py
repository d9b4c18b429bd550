"""Ingest from raw files: positional names, null tokens, per-split price rules."""

from pyspark.sql import functions as F

from twinlink.plans import ingest as IN
from twinlink.schema import Attr, DatasetSpec
from twinlink.session import scratch_dir


def _csv(spark, rows, cols, path):
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).write.option("header", True).csv(path)


def test_csv_pairs_positional_names_and_null_tokens(spark):
    root = scratch_dir(spark, "raw")
    spec = DatasetSpec("t", "x", "id", (Attr("name", "n"), Attr("price", "p", numeric=True)))
    _csv(spark, [("1", "Foo", "N/A"), ("2", "Bar", "3.5")], ["ID", "Title", "Cost"], f"{root}/a")
    _csv(spark, [("1", "foo", "nan"), ("2", "BAR", "3.50")], ["ID", "Title", "Cost"], f"{root}/b")
    _csv(spark, [("1", "1", "1"), ("2", "1", "0")], ["ltable_id", "rtable_id", "label"], f"{root}/train")
    _csv(spark, [("2", "2", "1")], ["ltable_id", "rtable_id", "label"], f"{root}/test")
    p = IN.csv_pairs(spark, spec, f"{root}/a", f"{root}/b", {"train": f"{root}/train", "test": f"{root}/test"})
    got = {r.pair_id: (r.split, r.label, [tuple(a) for a in r.attrs]) for r in p.collect()}
    assert got["t|1|1"] == ("train", 1, [("name", "Foo", "foo", False), ("price", None, None, True)])
    assert got["t|2|1"] == ("train", 0, [("name", "Bar", "foo", False), ("price", "3.5", None, True)])
    assert got["t|2|2"][0] == "test"


def test_prejoined_price_rules_per_split(spark):
    root = scratch_dir(spark, "pre")
    cols = "title_left string, price_left string, priceCurrency_left string, label int, " \
           "title_right string, price_right string, priceCurrency_right string"
    row = [("a", "10", "USD", 1, "b", None, "EUR")]
    for split in ("train", "valid", "test"):
        spark.createDataFrame(row, cols).write.parquet(f"{root}/{split}")
    p = IN.prejoined_pairs(spark, "w", {s: f"{root}/{s}" for s in ("train", "valid", "test")})
    got = {r.split: [tuple(a)[:3] for a in r.attrs] for r in p.collect()}
    assert got["train"] == [("name", "a", "b"), ("price", "USD10", None)]
    assert got["valid"] == [("name", "a", "b"), ("price", "10USD", "nanEUR")]
    assert got["test"] == [("name", "a", "b")]
    assert p.select("pair_id").distinct().count() == 3
