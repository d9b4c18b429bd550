"""Padded batches in order, distributed ranks."""

import random

from pyspark.sql import functions as F

from twinlink.operators.report import padded_token_report
from twinlink.tables import ranked


def _rows():
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(400) if k % 50 else None, rnd.choice([None, 0, 3, 90, 500])) for k in range(3000)]
    return rows + [("hot", 7, 5)] * 2000 + [("one", 1, 9)]


def test_ranks_are_a_sorted_numbering_of_each_group(spark):
    df = spark.createDataFrame(_rows(), "g string, o int, n int").repartition(9)
    out = ranked(df, ["g"], ["o"]).collect()
    assert len(out) == len(_rows())
    for g in ("a", "b", None, "hot", "one"):
        own = sorted((r.rank, r.o) for r in out if r.g == g)
        assert [k for k, _ in own] == list(range(len(own)))
        assert [o for _, o in own] == sorted((o for h, o, _ in _rows() if h == g), key=lambda o: (o is not None, o or 0))


def test_padded_cut_and_uncut_totals(spark):
    rows = [(d, f"{d}{i:04d}", random.Random(i).randrange(600)) for d in ("x", "y") for i in range(230)] + [("z", "z", None)]
    df = spark.createDataFrame(rows, "dataset string, pair_id string, n int").repartition(5)
    got = {r.dataset: r for r in padded_token_report(df, F.col("n"), 50, max_len=350, rates={"m": (10, 1)}).collect()}
    for d in ("x", "y", "z"):
        own = [min(n or 0, 350) for e, _, n in sorted(rows, key=lambda r: r[1]) if e == d]
        parts = [own[k:k + 50] for k in range(0, len(own), 50)]
        r = got[d]
        assert (r.n_records, r.n_batches, r.n_tokens) == (len(own), len(parts), sum(own))
        assert r.n_tokens_padded == sum(max(p) * len(p) for p in parts) >= r.n_tokens
        assert r.n_tokens_uncut == sum(n or 0 for e, _, n in rows if e == d)


def test_no_task_holds_a_group(spark):
    df = spark.range(100).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("pair_id"), F.lit(3).alias("n"))
    plan = padded_token_report(df, F.col("n"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_an_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], "dataset string, pair_id string, n int")
    assert padded_token_report(df, F.col("n")).count() == 0
