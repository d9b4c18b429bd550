"""U1/U2 against difflib directly, on long and short texts."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from twinlink.operators.score import predict_by_similarity, similarity_decision
from twinlink.functions.similarity import sequence_ratio


def test_order_sensitive_and_empty(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", "")], "a string, b string")
    got = [r.r for r in df.select(sequence_ratio("a", "b").alias("r")).collect()]
    assert got == [0.25, 0.5, 1.0]


def test_prune_never_changes_prediction(spark):
    from conftest import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b"))
    pairs = docs.withColumnRenamed("text", "text_a").join(nxt, "doc_id")
    # add exact copies and short pairs
    short = spark.createDataFrame([(-1, "abc", "abc"), (-2, "abcd", "abce"), (-3, "a", "abcdefgh")],
                                  "doc_id long, text_a string, text_b string")
    pairs = pairs.unionByName(short)
    got = {r.doc_id: r.prediction for r in predict_by_similarity(pairs, "text_a", "text_b").collect()}
    rows = pairs.collect()
    for r in rows:
        want = int(SequenceMatcher(None, r.text_a, r.text_b).ratio() > 0.5)
        assert got[r.doc_id] == want, r.doc_id
    decided = pairs.select(similarity_decision(F.col("text_a"), F.col("text_b"), 0.5).alias("d")).collect()
    assert any(d.d is not None for d in decided)


def test_exceeds_equals_ratio_comparison():
    import random
    from twinlink.functions.similarity import _exceeds
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 30)))
        t = rng.choice([0.3, 0.5, 0.7])
        assert _exceeds(a, b, t) == (SequenceMatcher(None, a, b).ratio() > t)
    assert _exceeds(None, "x", 0.5) is None


def test_similarity_report_equals_brute_force_on_fixture(spark):
    from conftest import SF001
    from twinlink.operators.score import similarity_inputs
    from twinlink.plans.baseline import similarity_report
    from twinlink.plans.fixture_pairs import fixture_pairs
    pairs = fixture_pairs(spark, SF001)
    rows = similarity_inputs(pairs.where(F.col("split") == "test")).collect()
    want = {}
    for r in rows:
        p = int(SequenceMatcher(None, r.text_a, r.text_b).ratio() > 0.5)
        c = want.setdefault(r.dataset, [0, 0, 0, 0])
        c[(p == 1) * 2 + (r.label == 1)] += 1          # tn, fn, fp, tp
    got = {r.dataset: r for r in similarity_report(pairs).collect()}
    assert set(got) == set(want)
    for ds, (tn, fn, fp, tp) in want.items():
        assert (got[ds].tp, got[ds].fp, got[ds].fn, got[ds].tn) == (tp, fp, fn, tn)
        assert got[ds].f1 == (0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))


def test_native_bounds_never_contradict_the_matcher(spark):
    """Every decision of the bounds equals difflib's, over texts of all kinds (long ones too)."""
    import random
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F
    from twinlink.operators.score import native_decision, predict_by_similarity
    rnd = random.Random(11)
    pieces = ["abc", "Acme 12", " - ", "née", "日本", "x", "price", "#9", "\n", "new"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 12))) for _ in range(60)]
    texts += ["".join(rnd.choices("ab ", k=rnd.randint(150, 400))) for _ in range(12)] + ["", "a" * 199, "a" * 200, "a" * 260 + "b"]
    rows = [(a, b) for a in texts for b in rnd.sample(texts, 25)]
    rows += [(a, a[len(a) // 3:] + "zz") for a in texts] + [(a, "q" + a[: 2 * len(a) // 3]) for a in texts] + [(None, "a")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(4)
    for t in (0.5, 0.3, 0.8):
        out = predict_by_similarity(df, "a", "b", t).withColumn("native", native_decision(F.col("a"), F.col("b"), t))
        kinds = {None: 0, 0: 0, 1: 0}
        for r in out.collect():
            if r.a is None:
                assert r.native is None
                continue
            want = int(SequenceMatcher(None, r.a, r.b).ratio() > t)
            assert r.prediction == want and r.native in (None, want)
            kinds[r.native] += 1
        assert kinds[0] and kinds[1]
