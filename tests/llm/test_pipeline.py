"""The pipeline: its stages in order, each on all its predecessor kept, and the entry without the subpackage."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline


def test_stages_and_result(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, own = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = own
        out = stage(spark, own, sf)
        out.write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert own.columns == columns
            assert own.join(before, "doc_id", "left_anti").count() == 0
    got = {r.doc_id: r for r in own.collect()}
    kept = {r.doc_id: r.text for r in before.collect()}
    assert set(got) == set(kept) and len(got) > 100
    for k, text in kept.items():
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_one_of_a_large_group_of_copies_keeps_its_text(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.agg({"doc_id": "max"}).first()[0] + 1
    text = "\n".join(" ".join(f"plain{chr(97 + i)}{chr(97 + j)} is the word that people say" for j in range(12)) for i in range(4))
    like = docs.where("lang = 'en'").limit(1)
    copies = spark.range(first, first + 25).select(F.col("id").alias("new_id")).crossJoin(like)
    own = docs.unionByName(copies.withColumn("doc_id", F.col("new_id")).withColumn("text", F.lit(text)).select(docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        last = own
        stage(spark, own, sf).write.parquet(str(tmp_path / name))
        own = spark.read.parquet(str(tmp_path / name))
    assert [(r.doc_id, r.text) for r in last.where(F.col("doc_id") >= first).collect()] == [(first, text)]
    out = own.where(F.col("doc_id") >= first).collect()
    assert [r.doc_id for r in out] == [first] and out[0].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_language_stage_rejects_by_score(spark, monkeypatch):
    from twinlink.llm import language_id
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = language_id.identified(docs).count()
    assert kept >= 0.99 * docs.where(F.col("text").rlike("\\p{L}")).count()
    net = language_id.train_fold(docs)
    net.out[:] = 0
    net.out_bias[:] = 0  # every language scores as chance does
    monkeypatch.setattr(language_id, "train_fold", lambda *a, **k: net)
    assert language_id.identified(docs).count() == 0


def test_stages_on_an_empty_table_and_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "the same words of a text", None, None, 5),
                                 (1, "the same words of a text", None, None, 5)], docs.schema)
    for own in (docs.limit(0), docs.limit(40).unionByName(odd)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, sf)
            if name != "encode":
                assert out.columns == docs.columns and out.count() <= own.count()
            else:
                assert out.count() == own.count()
