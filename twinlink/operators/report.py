"""Metrics and reports (R2-R8).  One hash aggregate per report; divisions in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlink.tables import ranked


def confusion_aggs(prediction: str = "prediction", truth: str = "label") -> list[Column]:
    """Counts of the four cells; a row without a prediction or a label would be in none, so it fails the job."""
    p, t = (F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row without {c}")).cast("boolean")).otherwise(F.col(c) == 1)
            for c in (prediction, truth))
    return [F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
            F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")]


def f1_expr() -> Column:
    """R2: positive-class F1 = 2TP / (2TP + FP + FN), 0 when undefined."""
    den = F.col("tp") * 2 + F.col("fp") + F.col("fn")
    return F.when(den == 0, F.lit(0.0)).otherwise((F.col("tp") * 2).cast("double") / den.cast("double"))


def accuracy_expr() -> Column:
    """(TP + TN) / N."""
    return F.when(F.col("n_pairs") == 0, F.lit(0.0)).otherwise(
        (F.col("tp") + F.col("tn")).cast("double") / F.col("n_pairs").cast("double"))


def metrics_report(scored: DataFrame, by=("dataset",), prediction: str = "prediction",
                   truth: str = "label", held_out: str | None = None) -> DataFrame:
    """Per-group counts, F1 and accuracy; ``zero_shot`` marks the held-out dataset."""
    by = list(by)
    rep = scored.groupBy(*by).agg(*confusion_aggs(prediction, truth))
    rep = rep.select(*by, "n_pairs", "tp", "fp", "fn", "tn",
                     f1_expr().alias("f1"), accuracy_expr().alias("accuracy"))
    if held_out is not None and "dataset" in by:
        rep = rep.withColumn("zero_shot", F.col("dataset") == F.lit(held_out))
    return rep


def mean_f1(report: DataFrame, by=()) -> DataFrame:
    """Unweighted mean of per-dataset F1 (rounded to 12 places for stable comparison)."""
    return report.groupBy(*by).agg(F.count(F.lit(1)).alias("n_datasets"),
                                   F.round(F.avg("f1"), 12).alias("mean_f1"))


# Serving rates (tokens per second, replicas) and hourly price in
# the published cost comparison; cost per 1K tokens = price / (rate*replicas*3600) * 1000.
SERVING_RATES = {
    "jellyfish": (26721, 8),
    "mixtral": (2108, 4),
    "solar": (1476, 2),
    "beluga2": (1079, 2),
}
PRICE_PER_HOUR = 19.22


def usd_per_1k_tokens(tokens_per_s: float, replicas: int, price_per_hour: float = PRICE_PER_HOUR) -> float:
    return price_per_hour / (tokens_per_s * replicas * 3600) * 1000


def token_cost_report(texts: DataFrame, n_tokens: Column, rates: dict | None = None,
                      max_len: int = 350, by=("dataset",),
                      price_per_hour: float = PRICE_PER_HOUR) -> DataFrame:
    """Records and tokens (each text counted up to ``max_len``) per group and the
    cost of serving them at each rate.  The rate list is exploded from literals, no join."""
    rates = rates or SERVING_RATES
    by = list(by)
    agg = (texts.select(*by, F.least(n_tokens, F.lit(max_len)).alias("_t"))
           .groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"),
                             F.sum("_t").cast("bigint").alias("n_tokens")))
    models = F.array(*[F.struct(F.lit(m).alias("model"),
                                F.lit(usd_per_1k_tokens(r, k, price_per_hour)).alias("usd_per_1k_tokens"))
                       for m, (r, k) in sorted(rates.items())])
    return (agg.select(*by, "n_records", "n_tokens", F.inline(models))
               .withColumn("cost_usd", F.col("n_tokens") / F.lit(1000.0) * F.col("usd_per_1k_tokens")))


def padded_token_report(texts: DataFrame, n_tokens: Column, batch_size: int = 16384, max_len: int = 350,
                        by=("dataset",), order=("pair_id",), rates: dict | None = None,
                        price_per_hour: float = PRICE_PER_HOUR) -> DataFrame:
    """R7 as a padded batch run serves the texts: rows go to batches of ``batch_size`` in ``order``, are cut to
    ``max_len`` tokens, and padded to the longest of their batch.

    Per group: records, batches, tokens uncut, cut and padded, and the cost of the padded ones at each rate.
    Ranks come from a range sort (``tables.ranked``), a batch's maximum from a hash aggregate."""
    by = list(by)
    rows = texts.select(*by, *order, F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("_t"))
    rows = ranked(rows, by, list(order), "padded").withColumn("_batch", F.floor(F.col("rank") / batch_size))
    cut = F.least("_t", F.lit(max_len).cast("bigint"))
    batches = rows.groupBy(*by, "_batch").agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_uncut"),
                                              F.sum(cut).alias("_cut"), F.max(cut).alias("_most"))
    agg = batches.groupBy(*by).agg(
        F.sum("_n").alias("n_records"), F.count(F.lit(1)).alias("n_batches"), F.sum("_uncut").alias("n_tokens_uncut"),
        F.sum("_cut").alias("n_tokens"), F.sum(F.col("_n") * F.col("_most")).alias("n_tokens_padded"))
    models = F.array(*[F.struct(F.lit(m).alias("model"),
                                F.lit(usd_per_1k_tokens(r, k, price_per_hour)).alias("usd_per_1k_tokens"))
                       for m, (r, k) in sorted((rates or SERVING_RATES).items())])
    return (agg.select("*", F.inline(models))
               .withColumn("cost_usd", F.col("n_tokens_padded") / F.lit(1000.0) * F.col("usd_per_1k_tokens")))


def length_filter(texts: DataFrame, n_tokens: Column, max_len: int) -> DataFrame:
    """Keep texts with ``n_tokens <= max_len`` (inclusive)."""
    return texts.where(n_tokens <= F.lit(max_len))


def dropped_for_length(texts: DataFrame, n_tokens: Column, max_len: int, by=("dataset", "split")) -> DataFrame:
    """How many texts P14 drops per group (too long, or null), next to the group size."""
    return (texts.groupBy(*by)
                 .agg(F.count(F.lit(1)).alias("n_texts"),
                      F.count_if(F.coalesce(n_tokens > F.lit(max_len), F.lit(True))).alias("n_dropped")))
