"""Null and repeated ids, clashing columns, second paths and small blocks of the operators."""

from pyspark.sql import functions as F

from twinlink.llm import decontaminate, line_dedup, near_dedup, quality, secret_scan, substring_dedup

LONG = " ".join(f"w{k}" for k in range(80))
ROWS = [(None, LONG, 1), (None, "", 2), (1, LONG, 3), (1, LONG, 4), (2, None, 5), (3, "same line\nown three", 6), (4, LONG + " tail", 7)]


def _odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, keys long").repartition(3)


def _same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_line_dedup_join_path_equals_the_broadcast_path(spark):
    own = _odd(spark).unionByName(spark.range(20, 32).select(F.col("id").alias("doc_id"), F.concat(F.lit(" Same LINE\nno "), "id").alias("text"),
                                                             F.lit(0).cast("long").alias("keys")))
    for keep in ("none", "first"):
        paths = [line_dedup.line_dedup(own, min_docs=10, keep=keep, broadcast_bytes=n) for n in (1 << 20, -1)]
        assert _same(*paths) and paths[0].count() == own.count()
        rows = {r.doc.doc_id: r for r in paths[1].where("doc.doc_id >= 3").collect()}
        first = 3 if keep == "first" else None
        assert all(r.n_dropped == (0 if i in (4, first) else 1) for i, r in rows.items())
        assert rows[20].doc.text == "no 20" and rows[3].doc.text == ("same line\nown three" if first else "own three")


def test_near_dedup_null_and_repeated_ids(spark):
    own = _odd(spark)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.report(own, percent=75).collect())
    assert got == sorted([("None", 76, None, True), ("None", 0, None, True), ("1", 76, 1, True), ("1", 76, 1, True), ("2", 0, 2, True),
                          ("3", 1, 3, True), ("4", 77, 1, False)])
    kept = near_dedup.keep_one(own)
    assert kept.columns == own.columns and sorted(r["keys"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6]


def test_near_dedup_links_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:59 - k % 3] + [f"end{k}"])) for k in range(24)] + [(99, "nothing like the others at all here")]
    got = near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), percent=75).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0) for k in range(24)} | {(99, 99)}


def test_decontaminate_blocks_empty_tables_and_spans(spark):
    own = _odd(spark)
    items = [("a", " ".join(f"w{k}" for k in range(5, 17))), ("b", "own three"), ("c", None), ("a", "W5 w6")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontaminate.scan(own, bench)
    assert _same(whole, decontaminate.scan(own, bench, block_windows=1)) and whole.count() == len(ROWS)
    none = decontaminate.report(own, bench.limit(0))
    assert none.count() == len(ROWS) and none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert decontaminate.report(own.limit(0), bench).count() == 0
    cut = {r["keys"]: r["text"] for r in decontaminate.decontaminate(own, bench, remove="spans").collect()}
    assert cut[6].split() == ["same", "line"] and cut[5] is None and cut[2] == ""
    assert cut[3].split() == [f"w{k}" for k in range(80) if not 5 <= k < 17]
    assert sorted(r["keys"] for r in decontaminate.decontaminate(own, bench).collect()) == [2, 5]


def test_substring_dedup_null_and_repeated_ids(spark):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.report(_odd(spark), window=50).collect())
    # Rows without an id are no document with a smaller id, and equal ids are not smaller than each other.
    assert got == sorted([("None", 80, 0), ("None", 0, 0), ("1", 80, 0), ("1", 80, 0), ("2", 0, 0), ("3", 4, 0), ("4", 81, 80)])


def test_quality_null_and_unlisted_languages(spark):
    texts = [(k, f"the word of {k} and the other one in the house is that it was for you " * 4, lang)
             for k, lang in enumerate(["en", None, "ru", "en"])]
    odd = [(None, None, None), (7, "", "ru"), (7, "", "ru")]
    out = quality.rate(spark.createDataFrame(texts + odd, "doc_id long, text string, lang string")).collect()
    assert len(out) == 7 and sum(r.n_words == 0 and r.base_failed and not r.kept for r in out) == 3
    assert all(r.base_failed and not r.kept for r in out)  # repeated windows fail the base rule whatever the language
    alone = quality.rate(spark.createDataFrame([(1, LONG, "ru"), (2, LONG, None)], "doc_id long, text string, lang string")).collect()
    assert all(r.kept and not r.base_failed for r in alone)  # no reference, no verdict by distance


def test_secret_scan_keeps_odd_rows(spark):
    own = _odd(spark)
    out = secret_scan.scan_secrets(own)
    assert out.count() == len(ROWS) and _same(out.select("doc.*"), own) and out.where(F.size("spans") > 0).count() == 0
