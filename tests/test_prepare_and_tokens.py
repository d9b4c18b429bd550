"""E1 prepare job (written Parquet read back with pruning) and the pluggable token counter."""

from pyspark.sql import functions as F

from conftest import SF001
from twinlink.functions.text import count_whitespace_tokens
from twinlink.functions.tokens import token_counter_udf
from twinlink.operators.attributes import attribute_pairs
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.plans.prepare import prepare_all
from twinlink.session import scratch_dir
from twinlink.sources.files import read_attribute_pairs, read_pairs
from twinlink.sources.fixtures import read_table


def _ids(df, col):
    return sorted(r[0] for r in df.select(col).collect())


def test_prepare_writes_pairs_and_attribute_pairs(spark):
    pairs = fixture_pairs(spark, SF001)
    paths = prepare_all(spark, pairs, ["prod", "cust", "supp"], scratch_dir(spark, "prep"),
                        with_predictions=False)
    assert _ids(read_pairs(spark, paths["pairs"]), "pair_id") == _ids(pairs, "pair_id")
    back = read_attribute_pairs(spark, paths["attr_pairs"], dataset="cust", split="test")
    ref = attribute_pairs(pairs).where("dataset = 'cust' AND split = 'test'")
    assert _ids(back, "attr_pair_id") == _ids(ref, "attr_pair_id")


def test_token_counter_udf_matches_native_counter(spark):
    docs = read_table(spark, SF001, "documents")
    udf = token_counter_udf(lambda t: len(t.split()))
    bad = docs.where(udf("text") != count_whitespace_tokens("text"))
    assert bad.count() == 0
    assert docs.select(F.sum(udf("text"))).first()[0] > 0
