"""Exact strings."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators import serialise as S
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.schema import PAIR_SCHEMA

ROW = [("d|1|2", "d", "test", 1, [("name", "iPhone", "iphone 12", False), ("price", None, "9.5", True)])]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(ROW, PAIR_SCHEMA)


def test_mode1(pairs):
    t = S.serialise(pairs, "mode1").first().text
    assert t == ("Record A is <p>COL iPhone, COL N/A</p>. Record B is <p>COL iphone 12, COL 9.5</p>. "
                 "Given the attributes of the two records, are they the same?")


def test_mode2_mode3_mode4(pairs):
    assert S.serialise(pairs, "mode2").first().text == (
        "Given the attributes of two records, are they the same? Record A is <p>COL iPhone, COL N/A</p>. "
        "Record B is <p>COL iphone 12, COL 9.5</p>.")
    assert S.serialise(pairs, "mode3").first().text == (
        "Given the attributes of two records, are they the same? Record A is COL iPhone, COL N/A. "
        "Record B is COL iphone 12, COL 9.5.")
    assert S.serialise(pairs, "mode4").first().text == (
        "Given the attributes of two records, are they the same? Record A is name: iPhone, price: N/A. "
        "Record B is name: iphone 12, price: 9.5.")


def test_invalid_mode(pairs):
    with pytest.raises(ValueError, match="Invalid mode"):
        S.serialise(pairs, "mode9")


def test_attribute_pair_prints_value(spark):
    ap = spark.createDataFrame([("x#name", "d", "train", "name", "a", None, 0)],
                               "attr_pair_id string, dataset string, split string, attribute string, "
                               "left_value string, right_value string, label int")
    t = S.serialise_attribute_pairs(ap, "mode4").first().text
    assert "Record A is value: a. Record B is value: N/A." in t


def test_record_texts_print_nan(pairs):
    r = pairs.select(S.record_text("left", ", ").alias("a"), S.record_text("left", "\t").alias("b")).first()
    assert r.a == "iPhone, nan" and r.b == "iPhone\tnan"


def test_prompts(pairs):
    p = S.render_prompt(pairs, "mixtral").first().prompt
    assert p.startswith("[INST]Do the two entity descriptions") and "Entity 1: iPhone\tnan\nEntity 2: iphone 12\t9.5[/INST]" in p
    assert S.render_prompt(pairs, "gpt2").first().prompt.startswith("Record A is <p>")
    with pytest.raises(ValueError):
        S.render_prompt(pairs, "nope")
    # a '%' in a value survives (no format strings)
    odd = pairs.withColumn("attrs", F.transform("attrs", lambda a: a.withField("left", F.lit("50%"))))
    assert "50%\t50%" in S.render_prompt(odd, "solar").first().prompt


def test_pack_pairs_pairs_sides_by_position(spark):
    from twinlink.operators.pairs import pack_pairs
    wide = spark.createDataFrame([("1", "2", "a", 1, "b")], "ltable_id string, rtable_id string, title_l string, "
                                                            "label int, name_r string")
    got = pack_pairs(wide, "d", split="test").first()
    assert got.pair_id == "d|1|2" and [tuple(a) for a in got.attrs] == [("title", "a", "b", False)]


def test_prompts_of_all_templates_in_one_pass(spark):
    pairs = fixture_pairs(spark, SF001)
    names = ("jellyfish", "mixtral", "solar", "beluga", "gpt2")
    out = S.render_prompts(pairs, names)
    for n in names:
        own = out.where(F.col("template") == n).drop("template")
        alone = S.render_prompt(pairs, n)
        assert own.columns == alone.columns and own.count() == alone.count() and own.exceptAll(alone).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == pairs._jdf.queryExecution().executedPlan().toString().count("Scan parquet")
    assert S.render_prompts(pairs, ()).count() == 0
    with pytest.raises(ValueError):
        S.render_prompts(pairs, ["solar", "nope"])
