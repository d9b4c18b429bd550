"""Streaming report equals the batch report and really spans several micro-batches."""

from pyspark.sql import functions as F

from conftest import SF001
from twinlink.operators.report import metrics_report
from twinlink.plans.baseline import similarity_scores
from twinlink.plans.catalog import _rule_scorer
from twinlink.plans.fixture_pairs import fixture_pairs
from twinlink.session import scratch_dir
from twinlink.sources.files import write_pairs
from twinlink.streaming import scoring as ST


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_streaming_report_matches_batch(spark):
    pairs = fixture_pairs(spark, SF001)
    src = scratch_dir(spark, "src")
    write_pairs(pairs.repartition(6), src)
    stream = ST.read_pair_stream(spark, src, max_files_per_trigger=2)
    report, ckpt = scratch_dir(spark, "rep"), scratch_dir(spark, "ck")
    q = ST.start_report(ST.score_stream(stream, _rule_scorer), report, ckpt)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) > 1
    batch = metrics_report(_rule_scorer(pairs))
    cols = batch.columns
    assert _rows(spark.read.parquet(report).select(*cols)) == _rows(batch)


def test_streaming_similarity_equals_batch(spark):
    pairs = fixture_pairs(spark, SF001).where(F.col("split") == "test")
    src = scratch_dir(spark, "src")
    write_pairs(pairs, src)
    out, ckpt = scratch_dir(spark, "out"), scratch_dir(spark, "ck")
    from twinlink.operators.score import predict_by_similarity, similarity_inputs
    q = ST.start_scored_sink(
        ST.score_stream(ST.read_pair_stream(spark, src), lambda p: predict_by_similarity(similarity_inputs(p))),
        out, ckpt)
    q.awaitTermination()
    got = spark.read.parquet(out).select("pair_id", "prediction")
    ref = similarity_scores(fixture_pairs(spark, SF001)).select("pair_id", "prediction")
    assert _rows(got) == _rows(ref)


def test_restarted_stream_resumes_from_its_checkpoint(spark):
    pairs = fixture_pairs(spark, SF001)
    src, report, ckpt = scratch_dir(spark, "src"), scratch_dir(spark, "rep"), scratch_dir(spark, "ck")
    first, second = pairs.where(F.col("dataset") == "prod"), pairs.where(F.col("dataset") != "prod")
    write_pairs(first, src)
    q1 = ST.start_report(ST.score_stream(ST.read_pair_stream(spark, src), _rule_scorer), report, ckpt)
    q1.awaitTermination()
    assert {r.dataset for r in spark.read.parquet(report).collect()} == {"prod"}
    write_pairs(second, src, mode="append")
    q2 = ST.start_report(ST.score_stream(ST.read_pair_stream(spark, src), _rule_scorer), report, ckpt)
    q2.awaitTermination()
    seen = sum(p["numInputRows"] for p in q2.recentProgress)
    assert seen == second.count()                     # only the new files are read
    cols = ["dataset", "n_pairs", "tp", "fp", "fn", "tn"]
    assert _rows(spark.read.parquet(report).select(*cols)) == _rows(metrics_report(_rule_scorer(pairs)).select(*cols))
