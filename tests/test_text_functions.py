"""P6, P7, P11-P13, R1, token counting."""

from pyspark.sql import functions as F

from twinlink.functions import text as TX


def test_strip_all_whitespace(spark):
    df = spark.createDataFrame([("\t\n a b \r ",), (" x\x1c",), ("",)], "s string")
    got = [r.t for r in df.select(TX.strip_all("s").alias("t")).collect()]
    assert got == ["\t\n a b \r ".strip(), " x\x1c".strip(), ""]


def test_token_count(spark):
    df = spark.createDataFrame([(" a  b\tc\n",), ("",), ("   ",), (None,)], "s string")
    got = [r.n for r in df.select(TX.count_whitespace_tokens("s").alias("n")).collect()]
    assert got == [3, 0, 0, None]


def test_label_text_round_trip(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "l int")
    r = df.select(TX.label_to_text("l").alias("y"), TX.label_to_text("l", yes_no=False).alias("t")).collect()
    assert [(x.y, x.t) for x in r] == [("No", "False"), ("Yes", "True"), (None, None)]
    s = spark.createDataFrame([(" Yes\n",), ("True",), ("yes",), (None,)], "s string")
    assert [x.v for x in s.select(TX.text_to_label("s").alias("v")).collect()] == [1, 1, 0, 0]


def test_text_to_bool(spark):
    s = spark.createDataFrame([("The answer is YES",), ("untrue",), ("no",)], "s string")
    assert [x.v for x in s.select(TX.text_to_bool("s").alias("v")).collect()] == [True, True, False]


def test_price_currency(spark):
    df = spark.createDataFrame([("10.5", "EUR"), (None, "EUR"), ("3", None)], "p string, c string")
    r = df.select(TX.merge_price_currency("p", "c").alias("s"),
                  TX.merge_price_currency("p", "c", lenient=True).alias("l")).collect()
    assert [(x.s, x.l) for x in r] == [("EUR10.5", "10.5EUR"), (None, "nanEUR"), (None, "3nan")]
