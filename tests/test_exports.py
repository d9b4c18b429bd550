"""Exports of any schema, stable ids, stored partitions: S3, P3, K1-K3, S4-S7."""

import pytest
from pyspark.sql import functions as F

from twinlink.plans import exports as XT
from twinlink.session import scratch_dir
from twinlink.sources import files as FS

COLS = "title_left string, price_left string, label int, title_right string, price_right string"
SPEC = XT.ExportSpec((("name", "title"), ("price", "price")))


def _rows():
    rows = [(f"t{i % 40}", None if i % 3 else str(i % 5), i % 2, f"u{i % 40}", "") for i in range(200)]
    return rows + [("same", "1", 0, "same", None)] * 25 + [(None, None, None, None, None)] * 3


def test_ids_do_not_depend_on_files_and_equal_rows_are_numbered(spark):
    df = spark.createDataFrame(_rows(), COLS)
    ids = []
    for n in (1, 8):
        path = scratch_dir(spark, "x")
        df.orderBy(F.rand(n)).repartition(n).write.parquet(path)
        out = XT.export_pairs(spark, "d", "train", path, SPEC)
        ids.append(sorted((r.pair_id, r.label, [tuple(a) for a in r.attrs]) for r in out.collect()))
    assert ids[0] == ids[1] and len({i for i, *_ in ids[0]}) == len(_rows())
    same = [i for i, _, attrs in ids[0] if attrs[0][1] == "same"]
    assert sorted(int(i.split("|")[-1]) for i in same) == list(range(1, 26)) and len({i.rsplit("|", 1)[0] for i in same}) == 1


def test_counts_above_a_chunk_are_dealt_out(spark):
    df = spark.createDataFrame(_rows(), COLS)
    a = XT.number_repeats(df, chunk=4).collect()
    b = XT.number_repeats(df).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(_rows())


def test_the_hash_tells_nulls_and_borders_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "c"), ("", "c"), ("-", "c"), ("1:a", "c")]
    df = spark.createDataFrame(rows, "x string, y string").select(XT.content_hash(["y", "x"]).alias("h"))
    assert df.distinct().count() == len(rows)


def test_a_spec_that_fits_no_export_raises(spark):
    path = scratch_dir(spark, "x")
    spark.createDataFrame(_rows(), COLS).write.parquet(path)
    with pytest.raises(Exception, match="maker_left"):
        XT.export_pairs(spark, "d", "train", path, XT.ExportSpec((("m", "maker"),))).count()
    with pytest.raises(ValueError):
        XT.ExportSpec((("a", "x"), ("a", "y")))
    with pytest.raises(ValueError):
        XT.ExportSpec((("a", "x"),), price="price", currency="c")


def test_published_specs_name_each_attribute_once():
    for name, spec in XT.SHARED_TESTS.items():
        kept = [c for c in XT.RECORD_COLUMNS.get(name, ["id", "title"])[1:] if c not in XT.DROPPED_COLUMNS.get(name, [])]
        assert [a for a, _ in spec.attrs] == kept
    assert XT.PRODUCT_OFFERS["valid"].lenient and not XT.PRODUCT_OFFERS["train"].lenient


def _pairs(spark, names):
    rows = [(f"{d}|{s}|{i}", d, s, i % 2, [("n", "a", "b", False)]) for d in names for s in ("train", "test") for i in range(4)]
    return spark.createDataFrame(rows, "pair_id string, dataset string, split string, label int, "
                                       "attrs array<struct<name:string,left:string,right:string,numeric:boolean>>")


def test_a_partition_is_replaced_and_names_stay_text(spark):
    path = scratch_dir(spark, "p")
    names = ["007", "2024", "1e3", "x y=z", "true"]
    FS.write_pairs(_pairs(spark, names), path)
    before = sorted(map(tuple, FS.read_pairs(spark, path).select("pair_id", "dataset", "split").collect()))
    assert {d for _, d, _ in before} == set(names)
    FS.write_pairs(_pairs(spark, ["007"]).where("split = 'test'").limit(1), path)
    after = sorted(map(tuple, FS.read_pairs(spark, path).select("pair_id", "dataset", "split").collect()))
    assert [r for r in after if r[1:] != ("007", "test")] == [r for r in before if r[1:] != ("007", "test")]
    assert sum(r[1:] == ("007", "test") for r in after) == 1
    assert FS.read_pairs(spark, path, dataset="007", split="train").count() == 4


def test_predictions_and_attribute_pairs_keep_their_schema(spark):
    path = scratch_dir(spark, "q")
    rows = [("a", 1, 0.25, 0.75, "007"), ("b", 0, 0.5, 0.5, "2024")]
    FS.write_predictions(spark.createDataFrame(rows, "pair_id string, prediction long, proba_0 float, proba_1 float, dataset string"), path)
    assert sorted(map(tuple, FS.read_predictions(spark, path, with_dataset=True).select(
        "pair_id", "prediction", "proba_0", "proba_1", "dataset").collect())) == rows
    path = scratch_dir(spark, "a")
    ap = spark.createDataFrame([("a#1", "007", "train", "n", None, "v", 1)],
                               "attr_pair_id string, dataset string, split string, attribute string, left_value string, right_value string, label int")
    FS.write_pairs(ap, path)
    assert [tuple(r) for r in FS.read_attribute_pairs(spark, path).collect()] == [tuple(r) for r in ap.collect()]


def test_a_stored_folder_gets_few_files(spark):
    path = scratch_dir(spark, "f")
    FS.write_pairs(_pairs(spark, ["a", "b"]).repartition(8, "pair_id"), path)
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4


def test_id_files_are_split_and_record_files_are_not(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("ltable_id,rtable_id,label\n" + "".join(f"{i},{i},1\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert FS.read_id_pairs(spark, {"train": str(tmp_path / "ids.csv")}).rdd.getNumPartitions() > 1
        assert FS.read_csv_text(spark, str(tmp_path / "ids.csv")).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
