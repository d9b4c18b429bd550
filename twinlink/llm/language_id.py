"""Language ID by a byte convolutional network trained in numpy.

Bytes are embedded, convolved with filters of several widths, rectified, max-pooled over a window of
``WINDOW`` bytes and classified by softmax.  Training takes, of every language, the ``per_lang``
labelled rows with the smallest hash of their id (a bounded sample, the bound is a parameter) and
from each a few windows spread over the whole text; it runs on the driver on those windows only.  The
trained weights (a few hundred kilobytes, independent of the data) are broadcast.  A text is cut into
consecutive windows, all of them are scored in batches, and the mean log-probability, weighted by bytes,
decides.

Edge cases: a null text or one without a letter is ``und`` with score 0; very long texts are scored window by window
in bounded batches; ties go to the first language in sorted order; null labels and languages are not learned; without
any labelled row every text is ``und``; repeated rows, null ids and other columns pass through; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .frames import as_struct, batch_of, bounded, field_of, with_fields

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 24, 8
_BATCH = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray


def windows(raw: bytes) -> np.ndarray:
    """Consecutive windows of the bytes, the last one padded with spaces."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, 32, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def _convolved(net: Net, x: np.ndarray):
    """Patches and rectified, pooled responses for windows ``x`` (n, WINDOW)."""
    e = net.embed[x].reshape(len(x), WINDOW * EMBED)
    pooled, where, patches = [], [], []
    for w, f, b in zip(WIDTHS, net.filters, net.bias):
        view = np.lib.stride_tricks.sliding_window_view(e, w * EMBED, axis=1)[:, ::EMBED]
        r = np.ascontiguousarray(view).reshape(-1, w * EMBED) @ f
        r = r.reshape(len(x), WINDOW - w + 1, FILTERS)
        at = r.argmax(axis=1)
        pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0] + b)
        where.append(at)
        patches.append(view)
    return np.concatenate(pooled, axis=1), where, patches


def log_probabilities(net: Net, x: np.ndarray) -> np.ndarray:
    parts = []
    for a in range(0, len(x), _BATCH):
        hidden = np.maximum(_convolved(net, x[a:a + _BATCH])[0], 0)
        z = hidden @ net.out + net.out_bias
        z -= z.max(axis=1, keepdims=True)
        parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    return np.concatenate(parts) if parts else np.zeros((0, len(net.langs)), np.float32)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, rate: float = 0.003, seed: int = 7) -> Net:
    """Adam on the cross-entropy of windows ``x`` with labels ``y``."""
    rng = np.random.default_rng(seed)

    def init(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Net(langs, init(256, EMBED, scale=0.5), [init(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS],
              [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
              init(FILTERS * len(WIDTHS), len(langs), scale=0.1), np.zeros(len(langs), np.float32))
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            own, label = x[order[a:a + 64]], y[order[a:a + 64]]
            pooled, where, patches = _convolved(net, own)
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), label] -= 1
            p /= len(own)
            back = (p @ net.out.T) * (pooled > 0)
            d_embed, d_filters, d_bias = np.zeros_like(net.embed), [], []
            for k, w in enumerate(WIDTHS):
                g, at = back[:, k * FILTERS:(k + 1) * FILTERS], where[k]
                rows = np.repeat(np.arange(len(own)), FILTERS)
                patch = patches[k][rows, at.reshape(-1)].reshape(len(own), FILTERS, w * EMBED)
                d_filters.append(np.einsum("nf,nfe->ef", g, patch).astype(np.float32))
                d_bias.append(g.sum(axis=0))
                d_patch = (g[:, :, None] * net.filters[k].T[None]).reshape(-1, w, EMBED)
                letters = own[rows[:, None], at.reshape(-1)[:, None] + np.arange(w)]
                np.add.at(d_embed, letters, d_patch)
            step += 1
            grads = [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(axis=0)]
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _spread(raw: bytes, most: int) -> list[bytes]:
    """At most ``most`` windows spread evenly over the whole text."""
    own = windows(raw)
    return [own[k].tobytes() for k in np.unique(np.linspace(0, len(own) - 1, most).astype(int))] if len(own) else []


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = 300, per_text: int = 6,
          max_langs: int = 500) -> Net | None:
    """Net trained on at most ``per_lang * per_text`` windows of each language; None without labelled rows.

    A language's rows are those of the smallest id hashes.  One pass counts the languages; a second keeps
    rows under a hash bound that leaves a few times ``per_lang`` of each, cuts their windows, and ranks
    those (not the texts).  Where the bound left too few, as when rows repeat an id, all are ranked."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                           F.xxhash64(F.col(id_col).cast("string")).alias("o"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(max_langs + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(sizes)
    most = 4 * per_lang + 64

    def cut(batches):
        for batch in batches:
            found = [_spread(t.encode(), per_text) for t in batch.column(0).to_pylist()]
            yield batch_of([*batch.columns[1:], pa.array(found, pa.list_(pa.binary()))], ["lang", "o", "h", "windows"])

    def first_rows(bounds: dict[str, int]) -> list:
        table = rows.sparkSession.createDataFrame(list(bounds.items()), "l string, bound bigint")  # a row per language
        own = rows.join(F.broadcast(table), (F.col("lang") == F.col("l")) & (F.col("o") <= F.col("bound")))
        own = own.select("text", "lang", "o", F.xxhash64("text").alias("h")).mapInArrow(
            bounded(cut, lambda batch: batch.column(0)), "lang string, o bigint, h bigint, windows array<binary>")
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
        own = own.withColumn("n", nth).where(F.col("n") <= per_lang)
        return own.orderBy("lang", "n").select("lang", "windows").collect()
    top = (1 << 63) - 1
    found = first_rows({k: top if n <= most else int(most / n * 2.0 ** 64) - (1 << 63) for k, n in sizes.items()})
    got = Counter(r["lang"] for r in found)
    short = {k: top for k, n in sizes.items() if got[k] < min(n, per_lang)}
    if short:
        found = sorted([r for r in found if r["lang"] not in short] + first_rows(short), key=lambda r: r["lang"])
    at = {lang: k for k, lang in enumerate(langs)}
    x = [np.frombuffer(w, dtype=np.uint8) for r in found for w in r["windows"]]
    return fit(np.array(x), np.array([at[r["lang"]] for r in found for _ in r["windows"]]), langs)


def predict(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with ``lang_pred`` and ``score``."""
    packed = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def label(batches):
        model = packed.value
        for batch in batches:
            texts = field_of(batch.column(0), at).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [k for k, t in enumerate(texts) if model is not None and t and _LETTER.search(t)]
            if known:  # the windows of all texts of the piece go through the network together
                raws = [texts[k].encode() for k in known]
                own = [windows(raw) for raw in raws]
                first = np.cumsum([0] + [len(w) for w in own])
                weight = np.full(first[-1], float(WINDOW))
                weight[first[1:] - 1] = [len(raw) - WINDOW * (len(w) - 1) for raw, w in zip(raws, own)]
                sums = np.add.reduceat(log_probabilities(model, np.concatenate(own)) * weight[:, None], first[:-1])
                mean = sums / np.add.reduceat(weight, first[:-1])[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for k, row in zip(known, p):
                    langs[k], scores[k] = model.langs[int(row.argmax())], float(row.max())
            yield batch_of([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                           ["doc", "lang_pred", "score"])
    return as_struct(docs).mapInArrow(bounded(label, lambda batch: field_of(batch.column(0), at)),
                                      with_fields(docs, "lang_pred string, score double"))


def fold(id_col: str, parts: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def train_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Net learned from the rows outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    return train(docs.where(fold(id_col, 3) != 1), id_col, text_col, lang_col)


def identified(docs: DataFrame, above_chance: float = 0.05) -> DataFrame:
    """``docs`` without the rows rejected: no language (``und``), or a score that is not ``above_chance`` of the way
    from chance (one in the number of languages) to certainty."""
    net = train_fold(docs)
    least = 1 / len(net.langs) + above_chance * (1 - 1 / len(net.langs)) if net else 0.0
    return predict(docs, net).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("doc.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``held_out, lang_pred, score``."""
    out = predict(docs.select(id_col, text_col), train_fold(docs, id_col, text_col, lang_col), text_col)
    return out.select(F.col("doc")[id_col].alias(id_col),
                      (F.crc32(F.col("doc")[id_col].cast("string").cast("binary")) % 3 == 1).alias("held_out"),
                      "lang_pred", "score")
