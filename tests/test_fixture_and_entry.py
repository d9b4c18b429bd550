"""Fixture sizes (FIXTURES.md 2.2), the driver entry and the query catalogue."""

from conftest import SF001, SF01


def test_fixture_split_sizes(spark):
    from twinlink.plans.fixture_pairs import fixture_pairs
    c = {(r.dataset, r.split, r.label): r["count"]
         for r in fixture_pairs(spark, SF01).groupBy("dataset", "split", "label").count().collect()}
    assert c[("prod", "train", 1)] == 1236 and c[("prod", "train", 0)] == 3778
    assert c[("cust", "test", 1)] == 281 and c[("supp", "valid", 0)] == 61


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert {r.dataset for r in rows} == {"prod", "cust", "supp"}
    assert set(df.columns) >= {"f1", "accuracy"}


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_udf_queries_run_from_any_working_directory(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    monkeypatch.chdir(tmp_path)
    assert E.queries()["e3_similarity_report"](spark, SF001).count() == 3
