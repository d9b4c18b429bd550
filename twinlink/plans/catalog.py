"""Registered queries: one per operator family, each over the whole test tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the result is
SQL-expressible, ``ORACLES[name]`` holds the DuckDB statement computing the same
rows with the same column names.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlink.operators.classifier import rule_predictions, with_rule_prediction
from twinlink.operators.pairs import attach_predictions
from twinlink.operators.report import mean_f1, metrics_report
from twinlink.functions.similarity import AUTOJUNK, COUNTED
from twinlink.operators.score import native_decision, similarity_decision, similarity_inputs
from twinlink.operators.serialise import (PROMPT_TEMPLATES, record_text, render_prompts,
                                          serialise)
from twinlink.plans import oracle as O
from twinlink.plans.baseline import similarity_mean_f1, similarity_report
from twinlink.plans.fixture_pairs import fixture_pairs, stored_pairs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- E3: similarity baseline (U1, U2, R4, R5); no SQL engine computes the ratio ---

@register("e3_similarity_report")
def q_similarity_report(spark, sf):
    return similarity_report(fixture_pairs(spark, sf))


@register("e3_similarity_mean_f1")
def q_similarity_mean(spark, sf):
    return similarity_mean_f1(fixture_pairs(spark, sf))


@register("u2_native_decisions", O.with_fixture(
    "t AS (SELECT pair_id, dataset, label, " + O.record_text_sql("left", ", ") + " AS a, "
    + O.record_text_sql("right", ", ") + " AS b FROM pairs WHERE split = 'test')",
    select="""SELECT pair_id, dataset, label,
  CASE WHEN a = b THEN 1
       WHEN length(a) + length(b) > 0
            AND CAST(2 * least(length(a), length(b)) AS DOUBLE) / (length(a) + length(b)) <= 0.5 THEN 0
  END AS decision FROM t"""))
def q_native_decisions(spark, sf):
    t = similarity_inputs(fixture_pairs(spark, sf).where(F.col("split") == "test"))
    return t.select("pair_id", "dataset", "label",
                    similarity_decision(F.col("text_a"), F.col("text_b"), 0.5).alias("decision"))


_ALL_TEXTS = ("t AS (SELECT pair_id, dataset, label, " + O.record_text_sql("left", ", ") + " AS a, "
              + O.record_text_sql("right", ", ") + " AS b FROM pairs)")


def _overlap_bound_sql():
    chars = "[" + ", ".join(_q(c) for c in COUNTED) + "]"
    common = (f"list_sum(list_transform({chars}, lambda c: least(length(a) - length(replace(a, c, '')), "
              "length(b) - length(replace(b, c, '')))))"
              f" + least(length(translate(a, {_q(COUNTED)}, '')), length(translate(b, {_q(COUNTED)}, '')))")
    return f"CAST(2 * ({common}) AS DOUBLE) / (length(a) + length(b))"


def _block_sql():
    k = "CAST(floor((length(a) + length(b)) * 0.5 / 2) + 1 AS INTEGER)"
    tests = " OR ".join(f"contains({x}, substr({y}, 1, {k})) OR contains({x}, substr({y}, length({y}) - {k} + 1, {k}))"
                        for x, y in (("a", "b"), ("b", "a")))
    return f"({k} <= least(length(a), length(b)) AND length(b) < {AUTOJUNK} AND ({tests}))"


@register("u2_native_bounds", O.with_fixture(_ALL_TEXTS, select=f"""SELECT pair_id, dataset, label,
  CASE WHEN a = b THEN 1
       WHEN CAST(2 * least(length(a), length(b)) AS DOUBLE) / (length(a) + length(b)) <= 0.5 THEN 0
       WHEN {_block_sql()} THEN 1
       WHEN {_overlap_bound_sql()} <= 0.5 THEN 0 END AS decision FROM t"""))
def q_native_bounds(spark, sf):
    """What length, common-block and character-overlap bounds decide of U2, over all splits."""
    t = similarity_inputs(fixture_pairs(spark, sf))
    return t.select("pair_id", "dataset", "label", native_decision(F.col("text_a"), F.col("text_b"), 0.5).alias("decision"))


_EDITS_SQL = (_ALL_TEXTS.replace("FROM pairs)", "FROM pairs WHERE split = 'test')"),
              "scored AS (SELECT dataset, label, CAST(CASE WHEN greatest(length(a), length(b)) = 0 THEN true ELSE "
              "1.0::DOUBLE - CAST(levenshtein(a, b) AS DOUBLE) / CAST(greatest(length(a), length(b)) AS DOUBLE) > 0.5 END "
              "AS INTEGER) AS prediction FROM t)")


@register("e3_edit_report", O.with_fixture(*_EDITS_SQL, select=O.metrics_select_sql("scored")))
def q_edit_report(spark, sf):
    return similarity_report(fixture_pairs(spark, sf), scorer="edits")


@register("e3_edit_mean_f1", O.with_fixture(
    *_EDITS_SQL, "rep AS (" + O.metrics_select_sql("scored") + ")",
    select="SELECT CAST(count(*) AS BIGINT) AS n_datasets, round(avg(f1), 12) AS mean_f1 FROM rep"))
def q_edit_mean(spark, sf):
    return similarity_mean_f1(fixture_pairs(spark, sf), scorer="edits")


# --- J1/J2/P5 + T9: materialised row pairs ---

@register("j2_row_pairs", O.with_fixture(select=(
    "SELECT pair_id, dataset, split, label, " + O.record_text_sql("left", ", ") + " AS record_l, "
    + O.record_text_sql("right", ", ") + " AS record_r FROM pairs")))
def q_row_pairs(spark, sf):
    return fixture_pairs(spark, sf).select(
        "pair_id", "dataset", "split", "label",
        record_text("left", ", ").alias("record_l"), record_text("right", ", ").alias("record_r"))


@register("j1_stored_records_per_split", O.with_fixture(select=(
    "SELECT pair_id, dataset, split, label, " + O.record_text_sql("left", ", ") + " AS record_l, "
    + O.record_text_sql("right", ", ") + " AS record_r FROM pairs")))
def q_stored_records(spark, sf):
    """J1 split by split over record tables that are stored once, in buckets of their id."""
    return stored_pairs(spark, sf).select(
        "pair_id", "dataset", "split", "label",
        record_text("left", ", ").alias("record_l"), record_text("right", ", ").alias("record_r"))


# --- T1-T4: serialisation modes ---

def _mode_query(mode):
    def q(spark, sf):
        return serialise(fixture_pairs(spark, sf), mode)
    return q


for _m in ("mode1", "mode2", "mode3", "mode4"):
    register(f"t_serialise_{_m}", O.with_fixture(select=(
        f"SELECT pair_id, dataset, split, {O.serialise_sql(_m)} AS text, label FROM pairs")))(_mode_query(_m))


# --- T7 + T8: tab-joined records inside named prompts ---

def _prompt_sql(name: str) -> str:
    if name == "gpt2":
        return O.serialise_sql("mode1")
    head, mid, tail = PROMPT_TEMPLATES[name].split("{}")
    return (f"{_q(head)} || {O.record_text_sql('left', chr(9))} || {_q(mid)} || "
            f"{O.record_text_sql('right', chr(9))} || {_q(tail)}")


_PROMPTS = ("jellyfish", "mixtral", "solar", "beluga", "gpt2")


@register("t8_prompts", O.with_fixture(select=" UNION ALL ".join(
    f"SELECT '{n}' AS template, pair_id, dataset, split, {_prompt_sql(n)} AS prompt, label FROM pairs"
    for n in _PROMPTS)))
def q_prompts(spark, sf):
    return render_prompts(fixture_pairs(spark, sf), _PROMPTS)


# --- R2-R5 with the rule predictor (J3 attaches it by key) ---

_RULE_SQL = ("scored AS (SELECT dataset, label, CAST(coalesce(lower(list_filter(attrs, lambda a: a.name = 'name')[1].left) "
             "= lower(list_filter(attrs, lambda a: a.name = 'name')[1].right), false) AS INTEGER) AS prediction "
             "FROM pairs WHERE split = 'test')")


def _rule_scored(spark, sf):
    pairs = fixture_pairs(spark, sf).where(F.col("split") == "test")
    return attach_predictions(pairs, rule_predictions(pairs))


@register("r4_rule_report", O.with_fixture(_RULE_SQL, select=O.metrics_select_sql("scored")))
def q_rule_report(spark, sf):
    return metrics_report(_rule_scored(spark, sf))


@register("r5_rule_mean_f1", O.with_fixture(
    _RULE_SQL, "rep AS (" + O.metrics_select_sql("scored") + ")",
    select="SELECT CAST(count(*) AS BIGINT) AS n_datasets, round(avg(f1), 12) AS mean_f1 FROM rep"))
def q_rule_mean(spark, sf):
    return mean_f1(metrics_report(_rule_scored(spark, sf)))


# --- A1-A8: attribute pairs ---

from twinlink.operators.attributes import attribute_pairs  # noqa: E402
from twinlink.operators import sampling as M  # noqa: E402

_AP = ("attr_pair_id", "dataset", "split", "attribute", "left_value", "right_value", "label")


@register("a8_attribute_pairs", O.with_fixture(*O.ATTR_PAIRS_CTES, select="SELECT * FROM ap"))
def q_attribute_pairs(spark, sf):
    return attribute_pairs(fixture_pairs(spark, sf))


@register("a5_attribute_label_counts", O.with_fixture(*O.ATTR_PAIRS_CTES, select=(
    "SELECT dataset, split, attribute, label, CAST(count(*) AS BIGINT) AS n FROM ap "
    "GROUP BY dataset, split, attribute, label")))
def q_attribute_label_counts(spark, sf):
    return (attribute_pairs(fixture_pairs(spark, sf))
            .groupBy("dataset", "split", "attribute", "label").agg(F.count(F.lit(1)).alias("n")))


# --- M1-M7: exact sampling ---

_MEMBERS = "SELECT pair_id, dataset, split, label FROM "


@register("m1_sample_exact", O.with_fixture(
    f"r AS (SELECT *, row_number() OVER (PARTITION BY dataset, split ORDER BY {O.key_sql(7, 'm1')}, pair_id) AS rn "
    "FROM pairs)", select=_MEMBERS + "r WHERE rn <= 50"))
def q_sample_exact(spark, sf):
    s = M.sample_exact(fixture_pairs(spark, sf), 50, seed=7, op="m1", by=["dataset", "split"])
    return s.select("pair_id", "dataset", "split", "label")


@register("m1_sample_exact_bucketed", ORACLES["m1_sample_exact"])
def q_sample_exact_bucketed(spark, sf):
    """M1 through the large-k path (key-prefix histogram, boundary bucket ranked), forced
    with ``large_k=0`` so the branch that serves k above 100,000 is checked here."""
    s = M.sample_exact(fixture_pairs(spark, sf), 50, seed=7, op="m1", by=["dataset", "split"], large_k=0)
    return s.select("pair_id", "dataset", "split", "label")


def _train(spark, sf):
    return fixture_pairs(spark, sf).where(F.col("split") == "train")


@register("m3_one_pos_two_neg_uncapped", O.with_fixture(
    "tr AS (SELECT * FROM pairs WHERE split = 'train')",
    "c AS (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE label = 1) AS pos FROM tr GROUP BY dataset)",
    f"r AS (SELECT tr.*, row_number() OVER (PARTITION BY dataset, label ORDER BY "
    f"{O.key_sql(42, 'one_pos_two_neg')}, pair_id) AS rn FROM tr)",
    select=_MEMBERS + "r JOIN c USING (dataset) WHERE c.total < 200 OR r.label = 1 OR r.rn <= 2 * c.pos"))
def q_one_pos_two_neg_uncapped(spark, sf):
    s = M.one_pos_two_neg(_train(spark, sf), seed=42, small_set=200, cap=10 ** 9)
    return s.select("pair_id", "dataset", "split", "label")


@register("m3_one_pos_two_neg_sizes", O.with_fixture(
    "tr AS (SELECT * FROM pairs WHERE split = 'train')",
    select=("SELECT dataset, CAST(CASE WHEN count(*) < 1200 THEN count(*) "
            "ELSE least(1200, 3 * count(*) FILTER (WHERE label = 1)) END AS BIGINT) AS n_rows "
            "FROM tr GROUP BY dataset")))
def q_one_pos_two_neg_sizes(spark, sf):
    s = M.one_pos_two_neg(_train(spark, sf))
    return s.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"))


def _rule_train(spark, sf):
    return with_rule_prediction(_train(spark, sf))


@register("m4_automl_filter", O.with_fixture(
    f"tr AS (SELECT *, {O.RULE_PRED_SQL} AS prediction FROM pairs WHERE split = 'train')",
    *O.automl_filter_cte("m4", "tr"), select=_MEMBERS + "m4"))
def q_automl_filter(spark, sf):
    return M.automl_filter(_rule_train(spark, sf)).select("pair_id", "dataset", "split", "label")


@register("m5_balance_attribute_pairs", O.with_fixture(
    *O.ATTR_PAIRS_CTES,
    "c AS (SELECT split, attribute, label, count(*) AS n FROM ap GROUP BY ALL)",
    "m AS (SELECT split, attribute, min(n) AS m FROM c GROUP BY ALL)",
    f"r AS (SELECT ap.*, row_number() OVER (PARTITION BY split, attribute, label ORDER BY "
    f"{O.key_sql(1, 'balance_attr', 'attr_pair_id')}, attr_pair_id) AS rn FROM ap)",
    select=("SELECT attr_pair_id, dataset, r.split, r.attribute, left_value, right_value, label "
            "FROM r JOIN m USING (split, attribute) WHERE r.rn <= m.m")))
def q_balance(spark, sf):
    return M.balance_attribute_pairs(attribute_pairs(fixture_pairs(spark, sf)), seed=1, cap=None) \
        .select(*_AP)


@register("m5_balance_bucketed", ORACLES["m5_balance_attribute_pairs"])
def q_balance_bucketed(spark, sf):
    """M5 with a band that misses every cutoff, so that all groups are drawn again from wider ones."""
    return M.balance_attribute_pairs(attribute_pairs(fixture_pairs(spark, sf)), seed=1, cap=None, margin=(-4.0, -16)) \
        .select(*_AP)


@register("m6_cap_attribute_pairs_sizes", O.with_fixture(
    *O.ATTR_PAIRS_CTES,
    "c AS (SELECT split, attribute, label, count(*) AS n FROM ap GROUP BY ALL)",
    select=("SELECT split, attribute, CAST(least(800, min(n) * count(*)) AS BIGINT) AS n_rows "
            "FROM c GROUP BY split, attribute")))
def q_cap_sizes(spark, sf):
    s = M.balance_attribute_pairs(attribute_pairs(fixture_pairs(spark, sf)), seed=1, cap=800, eval_cap=800)
    return s.groupBy("split", "attribute").agg(F.count(F.lit(1)).alias("n_rows"))


@register("m7_validation_subsample", O.with_fixture(
    select=_MEMBERS + f"pairs WHERE split = 'valid' ORDER BY {O.key_sql(42, 'valid_subsample')}, pair_id LIMIT 2000"))
def q_valid_subsample(spark, sf):
    v = fixture_pairs(spark, sf).where(F.col("split") == "valid")
    return M.validation_subsample(v, epoch=0).select("pair_id", "dataset", "split", "label")


# --- G1-G4: augmentation after the hard-positive filter ---

from twinlink.operators import augment as G  # noqa: E402
from twinlink.operators import assemble as D  # noqa: E402
from twinlink.operators.serialise import serialise_text  # noqa: E402

_M4_CTES = (f"tr AS (SELECT *, {O.RULE_PRED_SQL} AS prediction FROM pairs WHERE split = 'train')",
            *O.automl_filter_cte("m4", "tr"))
_AUG_OUT = "SELECT pair_id, dataset, split, label, " + O.serialise_sql("mode4", "vkey") + " AS text FROM g"


def _aug_out(df):
    return df.select("pair_id", "dataset", "split", "label", serialise_text("mode4").alias("text"))


def _filtered(spark, sf):
    return M.automl_filter(_rule_train(spark, sf)).drop("prediction", "proba_0", "proba_1")


@register("g1_flip", O.with_fixture(
    *_M4_CTES, f"u AS (SELECT * FROM m4 UNION ALL {O.flip_sql('m4')})", f"g AS ({O.dedup_sql('u')})",
    select=_AUG_OUT))
def q_flip(spark, sf):
    return _aug_out(G.flip_augment(_filtered(spark, sf)))


@register("g2_permute", O.with_fixture(
    *_M4_CTES, *O.permute_ctes("m4", "pm"), "u AS (SELECT * FROM m4 UNION ALL SELECT * FROM pm)",
    f"g AS ({O.dedup_sql('u')})", select=_AUG_OUT))
def q_permute(spark, sf):
    return _aug_out(G.permute_augment(_filtered(spark, sf)))


@register("g3_flip_permute", O.with_fixture(
    *_M4_CTES, *O.permute_ctes("m4", "pm"),
    f"u AS (SELECT * FROM m4 UNION ALL {O.flip_sql('m4')} UNION ALL SELECT * FROM pm)",
    f"g AS ({O.dedup_sql('u')})", select=_AUG_OUT))
def q_flip_permute(spark, sf):
    return _aug_out(G.flip_permute_augment(_filtered(spark, sf)))


# --- D1-D11: assembled, serialised sets ---

def _rule_preds(spark, sf):
    return with_rule_prediction


def _rows(spark, sf, mode="mode1", sampler="automl_filter"):
    preds = _rule_preds(spark, sf) if sampler.startswith("automl") else None
    return D.read_datasets(fixture_pairs(spark, sf), mode, sampler, preds)


_D2_CTES = (*_M4_CTES,
            "rows_p AS (SELECT pair_id, dataset, split, label, attrs FROM m4 UNION ALL "
            "SELECT pair_id, dataset, split, label, attrs FROM pairs WHERE split <> 'train')")


def _rows_sql(mode):
    return f"rows AS (SELECT pair_id, dataset, split, {O.serialise_sql(mode)} AS text, label FROM rows_p)"


@register("d1_read_datasets", O.with_fixture(*_D2_CTES, _rows_sql("mode1"), select="SELECT * FROM rows"))
def q_read_datasets(spark, sf):
    return _rows(spark, sf, "mode1", "automl_filter")


@register("d2_read_datasets_flip_permute", O.with_fixture(
    *_M4_CTES, *O.permute_ctes("m4", "pm"),
    f"u AS (SELECT * FROM m4 UNION ALL {O.flip_sql('m4')} UNION ALL SELECT * FROM pm)",
    f"g AS ({O.dedup_sql('u')})",
    select=(f"SELECT pair_id, dataset, split, {O.serialise_sql('mode2', 'vkey')} AS text, label FROM g "
            f"UNION ALL SELECT pair_id, dataset, split, {O.serialise_sql('mode2')} AS text, label "
            f"FROM pairs WHERE split <> 'train'")))
def q_read_datasets_fp(spark, sf):
    return _rows(spark, sf, "mode2", "automl_filter_flip_permute")


@register("d5_hold_out", O.with_fixture(*_D2_CTES, _rows_sql("mode3"),
                                        select="SELECT * FROM rows WHERE dataset <> 'cust'"))
def q_hold_out(spark, sf):
    return D.hold_out(_rows(spark, sf, "mode3", "automl_filter"), "cust")


_FOLDS = ["prod", "cust", "supp"]


@register("d6_all_folds_sizes", O.with_fixture(
    *_D2_CTES, _rows_sql("mode1"),
    select=("SELECT fold, split, CAST(count(*) AS BIGINT) AS n_rows FROM rows, "
            "(VALUES ('prod'), ('cust'), ('supp')) f(fold) WHERE dataset <> fold GROUP BY fold, split")))
def q_all_folds(spark, sf):
    return D.split_sizes(D.all_folds(_rows(spark, sf), _FOLDS), by=("fold", "split"))


def _attr_texts(spark, sf, cap=800, mode="mode1"):
    return D.read_attribute_datasets(attribute_pairs(fixture_pairs(spark, sf)), mode, cap=cap, eval_cap=cap)


_BAL_CTES = (*O.ATTR_PAIRS_CTES,
             "c AS (SELECT split, attribute, label, count(*) AS n FROM ap GROUP BY ALL)",
             "m AS (SELECT split, attribute, min(n) AS m FROM c GROUP BY ALL)",
             f"r AS (SELECT ap.*, row_number() OVER (PARTITION BY split, attribute, label ORDER BY "
             f"{O.key_sql(1, 'balance_attr', 'attr_pair_id')}, attr_pair_id) AS rn FROM ap)",
             "bal AS (SELECT r.* FROM r JOIN m USING (split, attribute) WHERE r.rn <= m.m)",
             f"attr_t AS (SELECT attr_pair_id AS pair_id, dataset, split, "
             f"{O.serialise_sql('mode1', O.ATTR_AS_PAIR)} AS text, label FROM bal)")


@register("d3_attribute_datasets_sizes", O.with_fixture(
    *O.ATTR_PAIRS_CTES,
    "c AS (SELECT split, attribute, label, count(*) AS n FROM ap GROUP BY ALL)",
    "s AS (SELECT split, attribute, least(800, min(n) * count(*)) AS n_rows FROM c GROUP BY ALL)",
    select="SELECT split, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM s GROUP BY split"))
def q_attr_datasets_sizes(spark, sf):
    return D.split_sizes(_attr_texts(spark, sf))


@register("d3_attribute_datasets_balanced", O.with_fixture(*_BAL_CTES, select="SELECT * FROM attr_t"))
def q_attr_datasets_balanced(spark, sf):
    return _attr_texts(spark, sf, cap=None)


@register("d8_attr_plus_row_balanced", O.with_fixture(
    *_BAL_CTES, *_D2_CTES, _rows_sql("mode1"),
    select=("SELECT min(pair_id) AS pair_id, arg_min(dataset, pair_id) AS dataset, 'train' AS split, text, label "
            "FROM (SELECT * FROM attr_t WHERE split = 'train' UNION ALL SELECT * FROM rows WHERE split = 'train') "
            "GROUP BY text, label UNION ALL SELECT * FROM rows WHERE split = 'valid'")))
def q_attr_plus_row(spark, sf):
    return D.mix_attr_plus_row(_attr_texts(spark, sf, cap=None), _rows(spark, sf)) \
        .select("pair_id", "dataset", "split", "text", "label")


@register("d9_attr_then_row_sizes", O.with_fixture(
    *O.ATTR_PAIRS_CTES,
    "c AS (SELECT split, attribute, label, count(*) AS n FROM ap GROUP BY ALL)",
    "s AS (SELECT split, attribute, least(800, min(n) * count(*)) AS n_rows FROM c GROUP BY ALL)",
    *_D2_CTES,
    select=("SELECT 1 AS phase, split, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM s "
            "WHERE split IN ('train', 'valid') GROUP BY split UNION ALL "
            "SELECT 2 AS phase, split, CAST(count(*) AS BIGINT) AS n_rows FROM rows_p "
            "WHERE split IN ('train', 'valid') GROUP BY split")))
def q_attr_then_row(spark, sf):
    return D.split_sizes(D.mix_attr_then_row(_attr_texts(spark, sf), _rows(spark, sf)), by=("phase", "split"))


@register("d10_example_texts", O.with_fixture(
    *_D2_CTES, _rows_sql("mode1"),
    select="SELECT dataset, split, arg_min(text, pair_id) AS text FROM rows WHERE split IN ('test', 'valid') "
           "GROUP BY dataset, split"))
def q_examples(spark, sf):
    return D.example_texts(_rows(spark, sf))


@register("d11_split_sizes", O.with_fixture(
    "c AS (SELECT dataset, split, count(*) AS total, count(*) FILTER (WHERE label = 1) AS pos "
    "FROM pairs GROUP BY dataset, split)",
    select=("SELECT split, CAST(sum(CASE WHEN split <> 'train' OR total < 1200 THEN total "
            "ELSE least(1200, 3 * pos) END) AS BIGINT) AS n_rows FROM c GROUP BY split")))
def q_split_sizes(spark, sf):
    return D.split_sizes(_rows(spark, sf, "mode1", "one_pos_two_neg"))


# --- P6-P14, R1-R3, R7, R8, U7 on the text tables ---

from twinlink.functions import text as TX  # noqa: E402
from twinlink.operators.classifier import attr_value  # noqa: E402
from twinlink.operators.report import (SERVING_RATES, dropped_for_length, length_filter,  # noqa: E402
                                       padded_token_report, token_cost_report, usd_per_1k_tokens)
from twinlink.operators.score import argmax_class  # noqa: E402
from twinlink.sources.fixtures import read_table  # noqa: E402


@register("p13_strip_documents", "SELECT doc_id, " + O.strip_sql("text") + " AS text FROM documents")
def q_strip(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", TX.strip_all("text").alias("text"))


@register("p14_length_filter_documents",
          f"SELECT doc_id, lang, n_tokens FROM (SELECT doc_id, lang, {O.count_tokens_sql('text')} AS n_tokens "
          f"FROM documents) WHERE n_tokens <= 350")
def q_length_filter(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", "lang", TX.count_whitespace_tokens("text").alias("n_tokens"))
    return length_filter(d, F.col("n_tokens"), 350)


@register("r8_dropped_for_length",
          f"SELECT lang, source, CAST(count(*) AS BIGINT) AS n_texts, "
          f"CAST(count(*) FILTER (WHERE {O.count_tokens_sql('text')} > 350) AS BIGINT) AS n_dropped "
          f"FROM documents GROUP BY lang, source")
def q_dropped(spark, sf):
    d = read_table(spark, sf, "documents")
    return dropped_for_length(d, TX.count_whitespace_tokens("text"), 350, by=("lang", "source"))


def _cost_values_sql():
    rows = ", ".join(f"('{m}', CAST('{usd_per_1k_tokens(r, k)!r}' AS DOUBLE))"
                     for m, (r, k) in sorted(SERVING_RATES.items()))
    return f"(VALUES {rows}) rates(model, usd_per_1k_tokens)"


@register("r7_token_cost_report", O.with_fixture(
    f"t AS (SELECT dataset, {O.serialise_sql('mode1')} AS text FROM pairs WHERE split = 'test')",
    f"a AS (SELECT dataset, CAST(count(*) AS BIGINT) AS n_records, "
    f"CAST(sum(least({O.count_tokens_sql('text')}, 350)) AS BIGINT) AS n_tokens FROM t GROUP BY dataset)",
    select=(f"SELECT dataset, n_records, n_tokens, model, usd_per_1k_tokens, "
            f"n_tokens / CAST(1000 AS DOUBLE) * usd_per_1k_tokens AS cost_usd FROM a, {_cost_values_sql()}")))
def q_cost(spark, sf):
    t = serialise(fixture_pairs(spark, sf).where(F.col("split") == "test"), "mode1")
    return token_cost_report(t, TX.count_whitespace_tokens("text"))


def _padded_sql(source, size, limit, by, order):
    return (f"WITH t AS ({source}), r AS (SELECT *, (row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1) // {size} AS batch FROM t), "
            f"b AS (SELECT {by}, batch, count(*) AS n, sum(n_tokens) AS uncut, sum(least(n_tokens, {limit})) AS cut, "
            f"max(least(n_tokens, {limit})) AS most FROM r GROUP BY {by}, batch), "
            f"a AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n_records, count(*) AS n_batches, CAST(sum(uncut) AS BIGINT) AS n_tokens_uncut, "
            f"CAST(sum(cut) AS BIGINT) AS n_tokens, CAST(sum(n * most) AS BIGINT) AS n_tokens_padded FROM b GROUP BY {by}) "
            f"SELECT {by}, n_records, n_batches, n_tokens_uncut, n_tokens, n_tokens_padded, model, usd_per_1k_tokens, "
            f"n_tokens_padded / CAST(1000 AS DOUBLE) * usd_per_1k_tokens AS cost_usd FROM a, {_cost_values_sql()}")


@register("r7_padded_token_report_documents", _padded_sql(
    f"SELECT lang, doc_id, coalesce({O.count_tokens_sql('text')}, 0) AS n_tokens FROM documents", 64, 350, "lang", "doc_id"))
def q_padded_documents(spark, sf):
    """R7 with padding over all documents in id order, batches of 64: texts beyond 350 tokens are cut, uncut totals beside."""
    d = read_table(spark, sf, "documents").select("lang", "doc_id", TX.count_whitespace_tokens("text").alias("n"))
    return padded_token_report(d, F.col("n"), 64, by=("lang",), order=("doc_id",))


_SERIALISED = O.with_fixture(select=(f"SELECT dataset, pair_id, {O.count_tokens_sql('text')} AS n_tokens FROM "
                                     f"(SELECT dataset, pair_id, {O.serialise_sql('mode4')} AS text FROM pairs)"))


@register("r7_padded_token_report", _padded_sql(_SERIALISED, 128, 30, "dataset", "pair_id"))
def q_padded_pairs(spark, sf):
    """R7 with padding over all serialised pairs (mode 4), batches of 128, cut at 30 tokens so that cutting occurs."""
    t = serialise(fixture_pairs(spark, sf), "mode4")
    return padded_token_report(t, TX.count_whitespace_tokens("text"), 128, max_len=30)


@register("r1_text_to_bool_conversations",
          "SELECT conv_id, turn, role, (contains(lower(text), 'yes') OR contains(lower(text), 'true')) AS positive "
          "FROM conversations")
def q_text_to_bool(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", TX.text_to_bool("text").alias("positive"))


@register("r2_r3_labels_by_lang", O.metrics_select_sql(
    "(SELECT d.lang, l.quality AS prediction, l.toxic AS label FROM labels l JOIN documents d USING (doc_id))",
    by="lang"))
def q_labels_metrics(spark, sf):
    lab = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    scored = lab.join(docs, "doc_id").select("lang", F.col("quality").alias("prediction"),
                                             F.col("toxic").alias("label"))
    return metrics_report(scored, by=("lang",))


@register("u7_argmax_embeddings",
          "SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted "
          "FROM embeddings")
def q_argmax(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", argmax_class("embedding").alias("predicted"))


@register("p11_p12_label_text",
          "SELECT doc_id, CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS quality_text, "
          "CASE toxic WHEN 0 THEN 'False' WHEN 1 THEN 'True' END AS toxic_text, "
          "CAST(coalesce(CASE quality WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END IN ('True', 'Yes'), false) AS INTEGER) "
          "AS quality_back, "
          "CAST(coalesce(CASE toxic WHEN 0 THEN 'False' WHEN 1 THEN 'True' END IN ('True', 'Yes'), false) AS INTEGER) "
          "AS toxic_back FROM labels")
def q_label_text(spark, sf):
    lab = read_table(spark, sf, "labels")
    q = TX.label_to_text("quality", yes_no=True)
    t = TX.label_to_text("toxic", yes_no=False)
    return lab.select("doc_id", q.alias("quality_text"), t.alias("toxic_text"),
                      TX.text_to_label(q).alias("quality_back"), TX.text_to_label(t).alias("toxic_back"))


def _attr_sql(name, side):
    return f"list_filter(attrs, lambda a: a.name = '{name}')[1].{side}"


@register("p6_p7_merge_price_currency", O.with_fixture(select=(
    f"SELECT pair_id, CASE WHEN {_attr_sql('price', 'right')} IS NOT NULL AND {_attr_sql('brand', 'right')} "
    f"IS NOT NULL THEN {_attr_sql('brand', 'right')} || {_attr_sql('price', 'right')} END AS strict_price, "
    f"coalesce({_attr_sql('price', 'right')}, 'nan') || coalesce({_attr_sql('brand', 'right')}, 'nan') "
    f"AS lenient_price FROM pairs")))
def q_price_currency(spark, sf):
    p = fixture_pairs(spark, sf)
    price, cur = attr_value(F.col("attrs"), "price", "right"), attr_value(F.col("attrs"), "brand", "right")
    return p.select("pair_id", TX.merge_price_currency(price, cur).alias("strict_price"),
                    TX.merge_price_currency(price, cur, lenient=True).alias("lenient_price"))


# --- S1-S7 / K1-K4: files written by Spark from the fixture and read back ---

from twinlink.session import scratch_dir  # noqa: E402
from twinlink.sources import files as FS  # noqa: E402
from twinlink.sources.fixtures import FIXTURE_BY_NAME, fixture_records  # noqa: E402


@register("s1_record_csv_roundtrip", O.with_fixture(select=(
    "SELECT CAST(id AS VARCHAR) AS id, name, brand, CAST(price AS VARCHAR) AS price FROM prod_b")))
def q_record_csv(spark, sf):
    spec = FIXTURE_BY_NAME["prod"]
    _, b = fixture_records(spark, sf, spec)
    path = scratch_dir(spark, "records-csv")
    b.toDF(spec.id_col, *[a.column for a in spec.attrs]).write.option("header", True).csv(path)
    return FS.read_record_table(spark, path, ["id"] + spec.attr_names, drop=["ptype"])


@register("k1_s4_pairs_roundtrip", O.with_fixture(select=(
    "SELECT pair_id, dataset, split, label, " + O.record_text_sql("left", ", ") + " AS record_l, "
    + O.record_text_sql("right", ", ") + " AS record_r FROM pairs")))
def q_pairs_roundtrip(spark, sf):
    path = scratch_dir(spark, "pairs")
    FS.write_pairs(fixture_pairs(spark, sf), path)
    return FS.read_pairs(spark, path).select(
        "pair_id", "dataset", "split", "label",
        record_text("left", ", ").alias("record_l"), record_text("right", ", ").alias("record_r"))


@register("k2_s5_attribute_pairs_roundtrip", O.with_fixture(*O.ATTR_PAIRS_CTES, select="SELECT * FROM ap"))
def q_attr_roundtrip(spark, sf):
    path = scratch_dir(spark, "attr-pairs")
    FS.write_pairs(attribute_pairs(fixture_pairs(spark, sf)), path)
    return FS.read_attribute_pairs(spark, path).select(*_AP)


@register("k3_s6_predictions_roundtrip", O.with_fixture(select=(
    f"SELECT pair_id, dataset, {O.RULE_PRED_SQL} AS prediction, CAST(1 - {O.RULE_PRED_SQL} AS DOUBLE) AS proba_0, "
    f"CAST({O.RULE_PRED_SQL} AS DOUBLE) AS proba_1 FROM pairs")))
def q_pred_roundtrip(spark, sf):
    pairs = fixture_pairs(spark, sf)
    preds = rule_predictions(pairs).join(pairs.select("pair_id", "dataset"), "pair_id")
    path = scratch_dir(spark, "predictions")
    FS.write_predictions(preds, path)
    return FS.read_predictions(spark, path, with_dataset=True)


@register("k4_dump_predictions", O.with_fixture(select=(
    f"SELECT pair_id, CAST({O.RULE_PRED_SQL} AS BIGINT) AS prediction, CAST(label AS BIGINT) AS label "
    f"FROM pairs WHERE split = 'test'")))
def q_dump(spark, sf):
    scored = _rule_scored(spark, sf)
    path = scratch_dir(spark, "dump")
    FS.dump_predictions(scored, path)
    return spark.read.schema("pair_id STRING, prediction BIGINT, label BIGINT").json(path)


# --- U3-U6, R6: classifier, batch scorer and hold-out evaluation (no SQL oracle) ---

from twinlink.operators.classifier import predict_pairs, fit_pair_classifier, score_with  # noqa: E402
from twinlink.plans.holdout import holdout_evaluation, holdout_predictions  # noqa: E402
from twinlink.sources.fixtures import FIXTURE_DATASETS as _FD  # noqa: E402


@register("u3_u4_classifier_report")
def q_classifier(spark, sf):
    pairs = fixture_pairs(spark, sf)
    model = fit_pair_classifier(pairs.where(F.col("split") == "train"), pairs.where(F.col("split") == "valid"))
    test = pairs.where(F.col("split") == "test")
    return metrics_report(predict_pairs(model, test))


@register("r6_holdout_evaluation")
def q_holdout(spark, sf):
    return holdout_evaluation(fixture_pairs(spark, sf), [d.name for d in _FD], predictions=with_rule_prediction)


def _holdout_sizes_sql(phases):
    return O.with_fixture(select=(
        "SELECT fold, CAST(phase AS INTEGER) AS phase, dataset, CAST(count(*) AS BIGINT) AS n_pairs, "
        "CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_positive, dataset = fold AS zero_shot, "
        "CAST(0 AS BIGINT) AS n_off FROM pairs, (VALUES ('prod'), ('cust'), ('supp')) f(fold), "
        f"(VALUES {', '.join(f'({p})' for p in phases)}) p(phase) WHERE split = 'test' GROUP BY fold, phase, dataset"))


def _holdout_sizes(spark, sf, mix):
    """Every test row is scored once by each fold and phase, with its label; n_off: rows whose
    probabilities do not add up to 1 or contradict the prediction."""
    pairs = fixture_pairs(spark, sf)
    scored = holdout_predictions(pairs, [d.name for d in _FD], predictions=with_rule_prediction, mix=mix,
                                 attr_pairs=attribute_pairs(pairs), max_iter=10)
    off = ((F.abs(F.col("proba_0") + F.col("proba_1") - 1) > 1e-9)
           | (F.col("prediction") != (F.col("proba_1") > F.col("proba_0")).cast("int")))
    return scored.groupBy("fold", "phase", "dataset").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(off).alias("n_off")
    ).withColumn("zero_shot", F.col("dataset") == F.col("fold"))


@register("r6_holdout_sizes_attr_plus_row", _holdout_sizes_sql([1]))
def q_holdout_attr_plus_row(spark, sf):
    return _holdout_sizes(spark, sf, "attr+row")


@register("r6_holdout_sizes_attr_then_row", _holdout_sizes_sql([1, 2]))
def q_holdout_attr_then_row(spark, sf):
    return _holdout_sizes(spark, sf, "attr-row")


def _overlap_scorer():
    """Example user model for U6: logits from token overlap of the two records."""
    import re

    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 2), dtype=np.float32)
        for i, t in enumerate(texts):
            m = re.search(r"Record A is <p>(.*)</p>\. Record B is <p>(.*)</p>\.", str(t), re.S)
            a, b = (m.group(1), m.group(2)) if m else ("", "")
            ta, tb = set(a.lower().split()), set(b.lower().split())
            j = len(ta & tb) / max(1, len(ta | tb))
            out[i] = (0.5, j)
        return out
    return predict


def _overlap_sql():
    from twinlink.functions.text import WHITESPACE_CLASS_RE2 as ws

    def toks(x):
        return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[{ws}]+'), lambda s: s <> ''))"
    pat = r"Record A is <p>(.*)</p>\. Record B is <p>(.*)</p>\."
    return O.with_fixture(
        f"t AS (SELECT dataset, label, {O.serialise_sql('mode1')} AS text FROM pairs WHERE split = 'test')",
        f"x AS (SELECT dataset, label, {toks(f'regexp_extract(text, {_q(pat)}, 1)')} AS ta, "
        f"{toks(f'regexp_extract(text, {_q(pat)}, 2)')} AS tb FROM t)",
        "scored AS (SELECT dataset, label, CASE WHEN 2 * len(list_intersect(ta, tb)) > "
        "greatest(1, len(ta) + len(tb) - len(list_intersect(ta, tb))) THEN 1 ELSE 0 END AS prediction FROM x)",
        select=O.metrics_select_sql("scored"))


@register("u6_batch_scorer_report", _overlap_sql())
def q_batch_scorer(spark, sf):
    texts = serialise(fixture_pairs(spark, sf).where(F.col("split") == "test"), "mode1")
    scored = score_with(texts, _overlap_scorer, "text").withColumn("prediction", argmax_class("logits"))
    return metrics_report(scored)


from twinlink.operators import linear_scorer as LS  # noqa: E402


@register("u6_linear_scorer_report")
def q_linear_scorer(spark, sf):
    """U6 with a trained model: hashed token features, weights learned on the train split, all test pairs scored."""
    texts = similarity_inputs(fixture_pairs(spark, sf))
    weights = LS.fit_linear(texts.where("split = 'train'"))
    return metrics_report(LS.score_linear(texts.where("split = 'test'"), weights))


# --- E1 ingest from raw files: S1 + S2 + P1/P9 + J1 + P5, S3 + P3/P6/P7/P8, S7 ---

from twinlink.plans import ingest as IN  # noqa: E402
from twinlink.operators.pairs import unpack_pairs  # noqa: E402
from twinlink.sources.fixtures import fixture_id_pairs  # noqa: E402

_J2_SELECT = ("SELECT pair_id, dataset, split, label, " + O.record_text_sql("left", ", ") + " AS record_l, "
              + O.record_text_sql("right", ", ") + " AS record_r FROM pairs")


def _record_texts(pairs):
    return pairs.select("pair_id", "dataset", "split", "label",
                        record_text("left", ", ").alias("record_l"), record_text("right", ", ").alias("record_r"))


def _write_raw_files(spark, sf, spec, root):
    """The fixture as raw matching inputs: two record CSVs with source column
    names and one labelled id-pair CSV per split."""
    a, b = fixture_records(spark, sf, spec)
    src_names = [spec.id_col] + [at.column for at in spec.attrs]
    paths = {"a": f"{root}/{spec.name}/tableA", "b": f"{root}/{spec.name}/tableB"}
    a.toDF(*src_names).write.option("header", True).csv(paths["a"])
    b.toDF(*src_names).write.option("header", True).csv(paths["b"])
    ids = fixture_id_pairs(spark, sf, spec)
    splits = {}
    for split in ("train", "valid", "test"):
        splits[split] = f"{root}/{spec.name}/{split}"
        ids.where(F.col("split") == split).select("ltable_id", "rtable_id", "label") \
           .write.option("header", True).csv(splits[split])
    return paths, splits


@register("e1_csv_files_to_row_pairs", O.with_fixture(select=_J2_SELECT))
def q_csv_to_pairs(spark, sf):
    root = scratch_dir(spark, "raw")
    out = None
    for spec in _FD:
        paths, splits = _write_raw_files(spark, sf, spec, root)
        p = IN.csv_pairs(spark, spec, paths["a"], paths["b"], splits)
        out = p if out is None else out.unionByName(p)
    return _record_texts(out)


def _prejoined_sql():
    name_l, name_r = _attr_sql("name", "left"), _attr_sql("name", "right")
    price_l, price_r = _attr_sql("price", "left"), _attr_sql("price", "right")
    cur_l, cur_r = _attr_sql("brand", "left"), _attr_sql("brand", "right")

    def rec(name, price, cur):
        strict = f"CASE WHEN {price} IS NOT NULL AND {cur} IS NOT NULL THEN {cur} || {price} END"
        lenient = f"coalesce({price}, 'nan') || coalesce({cur}, 'nan')"
        return (f"CASE split WHEN 'test' THEN coalesce({name}, 'nan') "
                f"WHEN 'train' THEN coalesce({name}, 'nan') || ', ' || coalesce({strict}, 'nan') "
                f"ELSE coalesce({name}, 'nan') || ', ' || {lenient} END")
    def value(x):
        return f"coalesce(length({x}) || ':' || {x}, '-')"

    def price(p, c):
        return (f"CASE split WHEN 'train' THEN CASE WHEN {p} IS NOT NULL AND {c} IS NOT NULL THEN {c} || {p} END "
                f"ELSE coalesce({p}, 'nan') || coalesce({c}, 'nan') END")
    return O.with_fixture(
        "e AS (SELECT * FROM pairs WHERE dataset = 'prod' UNION ALL SELECT * FROM pairs WHERE dataset = 'prod' AND label = 1)",
        f"x AS (SELECT dataset, split, label, {rec(name_l, price_l, cur_l)} AS record_l, {rec(name_r, price_r, cur_r)} AS record_r, "
        f"md5('1:' || label || {value(name_l)} || {value(name_r)} || CASE WHEN split = 'test' THEN '' ELSE "
        f"{value(price(price_l, cur_l))} || {value(price(price_r, cur_r))} END) AS h FROM e)",
        select=("SELECT dataset || '|' || split || '|' || h || '|' || row_number() OVER (PARTITION BY split, h) AS pair_id, "
                "dataset, split, label, record_l, record_r FROM x"))


@register("s3_prejoined_exports", _prejoined_sql())
def q_prejoined(spark, sf):
    """Pre-joined labelled-pair exports (one per split, no ids, matches listed twice) ingested with the
    per-split price rules; prod's brand plays the currency.  Ids are content hashes and occurrence numbers."""
    root = scratch_dir(spark, "prejoined")
    wide = unpack_pairs(fixture_pairs(spark, sf, [FIXTURE_BY_NAME["prod"]]), ["name", "brand", "ptype", "price"])
    wide = wide.unionByName(wide.where("label = 1"))
    paths = {}
    for split in ("train", "valid", "test"):
        paths[split] = f"{root}/{split}"
        wide.where(F.col("split") == split).select(
            F.col("name_l").alias("title_left"), F.col("price_l").alias("price_left"),
            F.col("brand_l").alias("priceCurrency_left"), "label",
            F.col("name_r").alias("title_right"), F.col("price_r").alias("price_right"),
            F.col("brand_r").alias("priceCurrency_right")).write.parquet(paths[split])
    return _record_texts(IN.prejoined_pairs(spark, "prod", paths))


@register("s7_test_split_pruned", O.with_fixture(select=_J2_SELECT + " WHERE split = 'test'"))
def q_test_pruned(spark, sf):
    path = scratch_dir(spark, "pairs")
    FS.write_pairs(fixture_pairs(spark, sf), path)
    return _record_texts(FS.read_pairs(spark, path, split="test"))


@register("d7_mix_row", O.with_fixture(*_D2_CTES, _rows_sql("mode1"),
                                       select="SELECT * FROM rows WHERE split IN ('train', 'valid')"))
def q_mix_row(spark, sf):
    return D.mix_row(_rows(spark, sf, "mode1", "automl_filter"))


from twinlink.operators.classifier import prepare_predictions  # noqa: E402


@register("u5_per_dataset_predictions")
def q_prepare_predictions(spark, sf):
    pairs = fixture_pairs(spark, sf)
    return prepare_predictions(pairs, [d.name for d in _FD]).select(
        "pair_id", "dataset", "split", "prediction", "proba_0", "proba_1")


# --- Streaming: the rule matcher's report and the similarity scores, built incrementally ---

from twinlink.streaming import scoring as ST  # noqa: E402


def _rule_scorer(pairs):
    a = F.col("attrs")
    same = F.coalesce(F.lower(attr_value(a, "name", "left")) == F.lower(attr_value(a, "name", "right")),
                      F.lit(False))
    return pairs.withColumn("prediction", same.cast("int"))


def _stored_pairs(spark, sf):
    path = scratch_dir(spark, "pairs-stream-src")
    FS.write_pairs(fixture_pairs(spark, sf), path)
    return path


@register("st_streaming_rule_report", O.with_fixture(_RULE_SQL, select=O.metrics_select_sql("scored")))
def q_stream_report(spark, sf):
    src = _stored_pairs(spark, sf)
    stream = ST.read_pair_stream(spark, src, max_files_per_trigger=4).where(F.col("split") == "test")
    report, ckpt = scratch_dir(spark, "stream-report"), scratch_dir(spark, "stream-ckpt")
    q = ST.start_report(ST.score_stream(stream, _rule_scorer), report, ckpt)
    q.awaitTermination()
    return spark.read.parquet(report)


@register("st_streaming_similarity_scores")
def q_stream_similarity(spark, sf):
    from twinlink.operators.score import predict_by_similarity, similarity_inputs

    def scorer(pairs):
        return predict_by_similarity(similarity_inputs(pairs))
    src = _stored_pairs(spark, sf)
    stream = ST.read_pair_stream(spark, src, max_files_per_trigger=4).where(F.col("split") == "test")
    out, ckpt = scratch_dir(spark, "stream-scores"), scratch_dir(spark, "stream-ckpt")
    scored = ST.score_stream(stream, scorer, tasks=spark.sparkContext.defaultParallelism)
    ST.start_scored_sink(scored, out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("pair_id", "dataset", "split", "label", "prediction")


# --- Model inputs: targets, strip, per-split token limits (P11-P14) and the dropped report (R8) ---

from twinlink.operators import examples as EX  # noqa: E402


# Short records: a train/valid limit inside the fixture's range of description lengths
# (prod descriptions have 34 or 35 whitespace tokens in mode 4), so both outcomes occur.
_SHORT_LIMITS = {"train": 34, "valid": 34, "test": 10000}


def _examples_sql(source: str, yes_no: bool, limits: dict[str, int] = EX.MAX_TOKENS) -> str:
    yes, no = ("Yes", "No") if yes_no else ("True", "False")
    limit = "CASE split " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in limits.items()) + " END"
    return (f"ex AS (SELECT pair_id, dataset, split, {O.strip_sql('text')} AS text, "
            f"CASE label WHEN 0 THEN '{no}' WHEN 1 THEN '{yes}' END AS target, "
            f"{O.count_tokens_sql('text')} AS n_tokens, split AS sp FROM {source}), "
            f"ex2 AS (SELECT *, CAST(coalesce(target IN ('True', 'Yes'), false) AS INTEGER) AS target_id, "
            f"n_tokens <= {limit} AS kept FROM ex)")


@register("p14_model_examples", O.with_fixture(
    *_D2_CTES, _rows_sql("mode1"), _examples_sql("rows", True),
    select="SELECT pair_id, dataset, split, text, target, target_id, n_tokens FROM ex2 WHERE kept"))
def q_model_examples(spark, sf):
    return EX.kept_examples(EX.model_examples(_rows(spark, sf, "mode1", "automl_filter")))


@register("r8_dropped_model_examples", O.with_fixture(
    *_D2_CTES, _rows_sql("mode4"), _examples_sql("rows", False, _SHORT_LIMITS),
    select=("SELECT dataset, split, CAST(count(*) AS BIGINT) AS n_texts, "
            "CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_dropped FROM ex2 GROUP BY dataset, split")))
def q_dropped_examples(spark, sf):
    ex = EX.model_examples(_rows(spark, sf, "mode4", "automl_filter"), yes_no=False,
                           max_tokens=_SHORT_LIMITS)
    return EX.dropped_examples(ex)


# --- E2: hold-out experiment inputs for all folds, written and read back ---

from twinlink.plans import experiment as XP  # noqa: E402


@register("e2_hold_out_inputs_sizes", O.with_fixture(
    *_D2_CTES, _rows_sql("mode1"),
    select=("SELECT fold, split, CAST(count(*) AS BIGINT) AS n_rows FROM rows, "
            "(VALUES ('prod'), ('cust'), ('supp')) f(fold) WHERE dataset <> fold AND split <> 'test' "
            "GROUP BY fold, split UNION ALL "
            "SELECT 'all' AS fold, 'test' AS split, CAST(count(*) AS BIGINT) AS n_rows FROM rows WHERE split = 'test'")))
def q_hold_out_inputs(spark, sf):
    sets = XP.hold_out_sets(fixture_pairs(spark, sf), _FOLDS, "row", predictions=with_rule_prediction)
    path = scratch_dir(spark, "hold-out-inputs")
    XP.write_hold_out_inputs(sets, path)
    return spark.read.parquet(path).groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("m4_with_classifier_predictions")
def q_m4_classifier(spark, sf):
    """M4 on a stored prediction table from the per-dataset classifiers (U5 -> K3 -> S6 -> J3)."""
    pairs = fixture_pairs(spark, sf)
    path = scratch_dir(spark, "u5-predictions")
    preds = prepare_predictions(pairs, [d.name for d in _FD], max_iter=40)
    FS.write_predictions(preds, path)
    train = pairs.where(F.col("split") == "train")
    scored = attach_predictions(train, FS.read_predictions(spark, path))
    return M.automl_filter(scored).select("pair_id", "dataset", "split", "label", "prediction")


@register("d3_attribute_sets_per_fold_sizes", O.with_fixture(
    *O.ATTR_PAIRS_CTES,
    "fa AS (SELECT f.fold, ap.* FROM ap, (VALUES ('prod'), ('cust'), ('supp')) f(fold) WHERE ap.dataset <> f.fold)",
    "c AS (SELECT fold, split, attribute, label, count(*) AS n FROM fa GROUP BY ALL)",
    "s AS (SELECT fold, split, attribute, least(800, min(n) * count(*)) AS n_rows FROM c GROUP BY ALL)",
    select="SELECT fold, split, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM s GROUP BY fold, split"))
def q_attr_sets_per_fold(spark, sf):
    """D3 inside hold-out folds: each fold balances and caps attributes over its own datasets."""
    ap = attribute_pairs(fixture_pairs(spark, sf))
    sets = D.read_attribute_datasets(ap, "mode1", folds=_FOLDS, eval_cap=800)
    return D.split_sizes(sets, by=("fold", "split"))


_FOLD_VALUES = "(VALUES ('prod'), ('cust'), ('supp')) f(fold)"
_FOLD_BAL_CTES = (
    *O.ATTR_PAIRS_CTES,
    f"fa AS (SELECT f.fold, ap.* FROM ap, {_FOLD_VALUES} WHERE ap.dataset <> f.fold)",
    "fc AS (SELECT fold, split, attribute, label, count(*) AS n FROM fa GROUP BY ALL)",
    "fm AS (SELECT fold, split, attribute, min(n) AS m FROM fc GROUP BY ALL)",
    f"fr AS (SELECT fa.*, row_number() OVER (PARTITION BY fold, split, attribute, label ORDER BY "
    f"{O.key_sql(1, 'balance_attr', 'attr_pair_id')}, attr_pair_id) AS rn FROM fa)",
    "fbal AS (SELECT fr.* FROM fr JOIN fm USING (fold, split, attribute) WHERE fr.rn <= fm.m)",
    f"fattr AS (SELECT fold, attr_pair_id AS pair_id, dataset, split, "
    f"{O.serialise_sql('mode1', O.ATTR_AS_PAIR)} AS text, label FROM fbal)")
_FOLD_ROWS = (*_D2_CTES, _rows_sql("mode1"),
              f"frows AS (SELECT fold, rows.* FROM rows, {_FOLD_VALUES} WHERE dataset <> fold AND split <> 'test')")
_FOLD_TESTS = "SELECT 'all' AS fold, 1 AS phase, pair_id, dataset, split, text, label FROM rows WHERE split = 'test'"


@register("d3_attribute_sets_per_fold", O.with_fixture(*_FOLD_BAL_CTES, select="SELECT * FROM fattr"))
def q_attr_sets_per_fold_members(spark, sf):
    """D3 + D6: the balanced attribute pairs of every fold, rows copied only into the folds that keep them."""
    ap = attribute_pairs(fixture_pairs(spark, sf))
    return D.read_attribute_datasets(ap, "mode1", cap=None, folds=_FOLDS) \
        .select("fold", "pair_id", "dataset", "split", "text", "label")


@register("e2_hold_out_attr_plus_row", O.with_fixture(
    *_FOLD_BAL_CTES, *_FOLD_ROWS,
    select=("SELECT fold, 1 AS phase, min(pair_id) AS pair_id, arg_min(dataset, pair_id) AS dataset, 'train' AS split, text, label "
            "FROM (SELECT * FROM fattr WHERE split = 'train' UNION ALL SELECT * FROM frows WHERE split = 'train') "
            "GROUP BY fold, text, label UNION ALL SELECT fold, 1 AS phase, pair_id, dataset, split, text, label FROM frows "
            f"WHERE split = 'valid' UNION ALL {_FOLD_TESTS}")))
def q_hold_out_attr_plus_row(spark, sf):
    """E2, mix attr+row: all folds' sets, attribute pairs balanced per fold (no cap)."""
    pairs = fixture_pairs(spark, sf)
    return XP.hold_out_sets(pairs, _FOLDS, "attr+row", attribute_pairs(pairs), predictions=with_rule_prediction, cap=None)


@register("e2_hold_out_attr_then_row", O.with_fixture(
    *_FOLD_BAL_CTES, *_FOLD_ROWS,
    select=("SELECT fold, 1 AS phase, pair_id, dataset, split, text, label FROM fattr WHERE split IN ('train', 'valid') "
            "UNION ALL SELECT fold, 2 AS phase, pair_id, dataset, split, text, label FROM frows "
            f"UNION ALL {_FOLD_TESTS}")))
def q_hold_out_attr_then_row(spark, sf):
    """E2, mix attr-row: phase 1 on attribute pairs, phase 2 on rows (no cap)."""
    pairs = fixture_pairs(spark, sf)
    return XP.hold_out_sets(pairs, _FOLDS, "attr-row", attribute_pairs(pairs), predictions=with_rule_prediction, cap=None)


# --- K1, S4, S7: partitions replaced one by one; dataset names stay text ---

_NUMBERED = "CASE dataset WHEN 'prod' THEN '2024' WHEN 'cust' THEN '007' ELSE dataset END"


@register("k1_partitions_replaced", O.with_fixture(select=(
    f"SELECT CASE WHEN dataset = 'cust' AND split = 'valid' THEN 'again|' || pair_id ELSE pair_id END AS pair_id, "
    f"{_NUMBERED} AS dataset, split, label, {O.record_text_sql('left', ', ')} AS record_l, "
    f"{O.record_text_sql('right', ', ')} AS record_r FROM pairs")))
def q_partitions_replaced(spark, sf):
    """Datasets named '2024' and '007' stored and read back; one partition is written again, the others stay."""
    name = F.expr(_NUMBERED)
    pairs = fixture_pairs(spark, sf).withColumn("dataset", name)
    path = scratch_dir(spark, "pairs-replaced")
    FS.write_pairs(pairs, path)
    again = FS.read_pairs(spark, path, dataset="007", split="valid")
    FS.write_pairs(again.withColumn("pair_id", F.concat(F.lit("again|"), F.col("pair_id"))), path)
    return _record_texts(FS.read_pairs(spark, path))


# --- P3, S3, S7: exports of any schema, shared test splits ---

from twinlink.plans import exports as XT  # noqa: E402

_SHARED = {"prod": XT.ExportSpec((("title", "name"), ("maker", "brand"))),
           "cust": XT.ExportSpec((("name", "name"), ("price", "price")), price="price", currency="brand"),
           "supp": XT.ExportSpec((("name", "name"),), id_col="key")}


def _shared_sql():
    def v(side, name):
        return f"list_filter(attrs, lambda a: a.name = '{name}')[1].{side}"

    def text(x):
        return f"coalesce({x}, 'nan')"

    def price(side):
        p, c = v(side, "price"), v(side, "brand")
        return f"CASE WHEN {p} IS NOT NULL AND {c} IS NOT NULL THEN {c} || {p} END"

    def enc(x):
        return f"coalesce(length({x}) || ':' || {x}, '-')"

    def rec(side):
        return (f"CASE dataset WHEN 'prod' THEN {text(v(side, 'name'))} || ', ' || {text(v(side, 'brand'))} "
                f"WHEN 'cust' THEN {text(v(side, 'name'))} || ', ' || {text(price(side))} ELSE {text(v(side, 'name'))} END")
    content = ("CASE dataset WHEN 'prod' THEN '1:' || label || " + " || ".join(
        enc(v(s, n)) for n in ("brand", "name") for s in ("left", "right"))
        + " ELSE '1:' || label || " + " || ".join(enc(v(s, "name")) for s in ("left", "right"))
        + " || " + " || ".join(enc(price(s)) for s in ("left", "right")) + " END")
    return O.with_fixture(
        f"t AS (SELECT *, md5({content}) AS h, {rec('left')} AS record_l, {rec('right')} AS record_r FROM pairs WHERE split = 'test')",
        select=("SELECT dataset || '|test|' || CASE dataset WHEN 'supp' THEN pair_id ELSE h || '|' || "
                "row_number() OVER (PARTITION BY dataset, h) END AS pair_id, dataset, split, label, record_l, record_r FROM t "
                "UNION ALL SELECT pair_id, dataset, split, label, " + O.record_text_sql("left", ", ") + " AS record_l, "
                + O.record_text_sql("right", ", ") + " AS record_r FROM pairs WHERE split <> 'test'"))


@register("p3_shared_test_splits", _shared_sql())
def q_shared_tests(spark, sf):
    """Stored pairs whose test splits are replaced by exports with columns of their own."""
    path, root = scratch_dir(spark, "pairs-shared"), scratch_dir(spark, "exports")
    FS.write_pairs(fixture_pairs(spark, sf), path)
    exports = {}
    for d in _FD:
        wide = unpack_pairs(fixture_pairs(spark, sf, [d]).where("split = 'test'"), d.attr_names)
        spec, exports[d.name] = _SHARED[d.name], (f"{root}/{d.name}", _SHARED[d.name])
        stems = [s for _, s in spec.attrs] + ([spec.currency] if spec.currency else [])
        wide.select(*[F.col(f"{s}_{short}").alias(f"{s}_{side}") for s in stems for side, short in XT.SIDES],
                    "label", F.col("pair_id").alias("key"), F.lit("unused").alias("url_left")).write.parquet(f"{root}/{d.name}")
    XT.replace_splits(spark, path, exports)
    return _record_texts(FS.read_pairs(spark, path))
