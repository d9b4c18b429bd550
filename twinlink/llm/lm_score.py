"""Language-model scores by a hashed maximum-entropy model of words with a class-factored softmax.

A text is its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) and one end token.  A token's
probability is P(class | words before) * P(part | class, words before) * P(token | class, part).  The ``SINGLES`` most
frequent tokens are classes of their own, the next ones (up to ``max_frequent``) share a class by octave of rank, all
others, unseen ones included, are the rare class.  A class of several tokens has ``PARTS`` parts, told by five bits of
the token's hash.  P(token | class, part) is the smoothed share of its training count; each part of the rare class
holds a place for what was not seen.  The other two factors are maximum-entropy models of the *words* before the token
(64-bit hashes): a bias, the last word, the last two, and skip features (the second last; the last with the third
last), hashed to rows of weights, of which there are a quarter of the distinct training tokens, as a power of two
between ``MIN_ROWS`` and ``max_rows`` (the model is broadcast; at the default bound its size is 12 MB).

Training: (1) exact counts of all training tokens, pre-aggregated in the tasks; they grow with the input; (2)
``rounds`` distributed gradient updates.  A round reads one of ``rounds`` shares of the training rows (by a digest of the
text), all rounds together read every row once.  Its tasks start from the broadcast weights, take scaled (Adagrad) steps
over their own tokens and emit by block of rows what they changed, weighted by how often a row fired; a shuffle adds these up,
and only the mean by row, the size of the model, reaches the driver.  Weights depend a little on how the
table is split into tasks, counts and ``base_score`` do not.

Scoring: frequent tokens by broadcast table; the rare tokens of a document become (document, hash,
count) rows joined to the counts.  A hot token is always frequent, so that join has no hot key.

Edge cases: a null or empty text is the end token alone; a table without training rows scores with N = V = 0 and
the rare class only; repeated rows and ids are told apart by a digest of the text and equal rows share
their result; null ids match null-safely; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .frames import batch_of, bounded, written

SINGLES, PARTS, FEATURES = 40, 32, 5
MIN_ROWS = 4096
_FLUSH = 500_000
_START, _END = np.uint64(0), np.uint64(1)
_BLOCK, _STEP, _HOT = 64, 4096, 16


def _streams(column):
    """``(first row, tokens, bounds)`` of chunks of rows: tokens of row r at ``bounds[r]:bounds[r + 1]``, the end token last."""
    for first, _, buf, bounds in T.text_chunks(column):
        buf = T.LOWER[buf]
        starts, ends, _, per_row = T.word_spans(buf, bounds, T.NON_SPACE)
        per_row = np.asarray(per_row)
        yield first, np.insert(T.span_hashes(buf, starts, ends), per_row[1:], _END), per_row + np.arange(len(per_row))


def _merged(keys: list, counts: list):
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    return own, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def _summed(texts: DataFrame) -> DataFrame:
    """``key, n``: how often each token (its 64-bit hash) occurs over a one-column frame."""
    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, own, _ in _streams(batch.column(0)):
                found, n = np.unique(own, return_counts=True)
                keys.append(found)
                counts.append(n)
                held += len(found)
            if held > _FLUSH:
                found, n = _merged(keys, counts)
                keys, counts, held = [found], [n], len(found)
                if held > _FLUSH // 2:
                    yield batch_of([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])
                    keys, counts, held = [], [], 0
        if keys:
            found, n = _merged(keys, counts)
            yield batch_of([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])
    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _part(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(59)).astype(np.int64)


class Classes:
    """Frequent tokens (sorted hashes), their counts and classes; ``share``: smoothed counts by class and part."""

    def __init__(self, hashes, counts, total, distinct):
        """``total`` and ``distinct``: training tokens of each part, the frequent ones (``hashes``) included."""
        order = np.lexsort((hashes, -counts))
        rank = np.empty(len(hashes), dtype=np.int64)
        rank[order] = np.arange(len(hashes))
        octave = SINGLES + np.floor(np.log2(np.maximum(rank, SINGLES) / SINGLES)).astype(np.int64)
        label = np.where(rank < SINGLES, rank, octave)
        self.n = int(label.max()) + 2 if len(label) else 1
        self.rare = self.n - 1
        self.singles = min(SINGLES, self.rare)  # classes below have one token
        by_hash = np.argsort(hashes)
        self.hashes, self.counts, self.label = hashes[by_hash], counts[by_hash].astype(np.float64), label[by_hash]
        cell = self.label * PARTS + _part(self.hashes)
        size = np.bincount(cell, minlength=self.n * PARTS).reshape(self.n, PARTS).astype(np.float64)
        mass = np.bincount(cell, weights=self.counts, minlength=self.n * PARTS).reshape(self.n, PARTS)
        size[self.rare], mass[self.rare] = distinct - size.sum(axis=0) + 1, total - mass.sum(axis=0)
        self.share = mass + 0.1 * size
        self.share[:self.singles] = self.share[:self.singles].sum(axis=1, keepdims=True)
        self.total, self.distinct = int(total.sum()), int(distinct.sum())

    def of(self, tokens: np.ndarray):
        """Class and place in the table (-1 if rare) of every token."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64), np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        known = self.hashes[at] == tokens
        return np.where(known, self.label[at], self.rare), np.where(known, at, -1)

    def start(self, rows: int) -> list[np.ndarray]:
        """Weights of both factors before training: the shares as biases, ``rows`` hashed rows of zeros after them."""
        mass = np.where(np.arange(self.n) < self.singles, self.share[:, 0], self.share.sum(axis=1))
        out = [np.zeros((1 + rows, self.n), np.float32), np.zeros((self.n + rows, PARTS), np.float32)]
        out[0][0] = np.log(mass)
        out[1][:self.n] = np.log(np.maximum(self.share, 1e-9))  # an empty part has no token
        return out


def histories(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed features (tokens, FEATURES - 1) of the words before each token of a row: the last, the last two, the second
    last, the last with the third last."""
    before = [tokens]
    for _ in range(3):
        shifted = np.empty_like(tokens)
        shifted[1:] = before[-1][:-1]
        shifted[bounds[:-1]] = _START
        before.append(shifted)
    _, a, b, c = before
    odd = np.uint64(0x9E3779B97F4A7C15)
    b2, c2 = b * odd, c * odd
    kinds = (a, a ^ (b2 << np.uint64(1)), b2, a ^ (c2 >> np.uint64(1)))
    return np.stack([T.mix(x + np.uint64(k + 1)) for k, x in enumerate(kinds)], axis=1)


def rows_of(keys: np.ndarray, label, classes: Classes, rows: int) -> np.ndarray:
    """Weight rows (tokens, FEATURES), the bias first: of the class model, or with ``label`` of the parts within these classes."""
    out = np.zeros((len(keys), FEATURES), np.int32)
    if label is not None:
        out[:, 0] = label
        keys = T.mix(keys ^ (label.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None])
    out[:, 1:] = (keys & np.uint64(rows - 1)).astype(np.int32) + (1 if label is None else classes.n)
    return out


def _exponents(weights: np.ndarray, rows: np.ndarray):
    """``(z, exp(z), sums of these)``; z is held within 60 of zero, so that no sum overflows or is zero."""
    z = np.take(weights, rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0)
    np.clip(z, -60, 60, out=z)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], np.float32)


def _factors(keys, label, part, classes: Classes, rows: int):
    """``(factor, which tokens, weight rows, outcomes)`` of both factors; a class of one token has no second one."""
    yield 0, slice(None), rows_of(keys, None, classes, rows), label
    many = np.flatnonzero(label >= classes.singles)
    if len(many):
        yield 1, many, rows_of(keys[many], label[many], classes, rows), part[many]


def log_factors(weights, keys, label, part, classes: Classes) -> np.ndarray:
    """Natural log of P(class | words before) * P(part | class, words before) of every token."""
    out = np.zeros(len(keys))
    rows = len(weights[0]) - 1
    for a in range(0, len(keys), _STEP):
        own, cut = out[a:a + _STEP], slice(a, a + _STEP)
        for factor, which, at, y in _factors(keys[cut], label[cut], part[cut], classes, rows):
            z, _, sums = _exponents(weights[factor], at)
            own[which] += z[np.arange(len(y)), y] - np.log(sums)
    return out


def _descend(weights, squares, fired, at, y, rate: float):
    """One Adagrad step (one rate per row of weights) on the tokens with weight rows ``at`` and outcomes ``y``."""
    _, p, sums = _exponents(weights, at)
    p /= sums[:, None]
    p[np.arange(len(y)), y] -= 1
    flat = at.reshape(-1)
    order = np.argsort(flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat, kind="stable")
    ranked = flat[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    times = np.diff(first, append=len(flat))
    most = np.argsort((len(flat) - times).astype(np.uint16) if len(flat) < 1 << 16 else -times, kind="stable")
    first, times, token = first[most], times[most], order // FEATURES
    own, slope = ranked[first], np.take(p, token[first], axis=0)
    falling = -times
    hot = int(np.searchsorted(falling, -_HOT))  # rows that fire more often than _HOT times are summed by a matrix product
    if hot:
        at_row = np.repeat(np.arange(hot), times[:hot])
        place = np.repeat(first[:hot] - np.cumsum(times[:hot]) + times[:hot], times[:hot]) + np.arange(len(at_row))
        marks = np.zeros((hot, len(p)), np.float32)
        np.add.at(marks.reshape(-1), at_row * len(p) + token[place], np.float32(1))
        slope[:hot] = marks @ p
    for j in range(1, _HOT):
        end = int(np.searchsorted(falling, -j))
        if end <= hot:
            break
        slope[hot:end] += np.take(p, token[first[hot:end] + j], axis=0)
    squares[own] += np.einsum("ij,ij->i", slope, slope)
    fired[own] += times
    slope *= (rate * np.sqrt(weights.shape[1]) / np.sqrt(squares[own] + 1e-6)).astype(np.float32)[:, None]
    weights[own] -= slope


def fit(learn: DataFrame, table, rounds: int, rows: int, rate: float) -> list[np.ndarray]:
    """Weights of both factors after ``rounds`` averaged updates over the texts of ``learn``; ``table``: broadcast Classes."""
    sc = learn.sparkSession.sparkContext
    weights = table.value.start(rows)
    schema = "factor int, block int, sums binary"
    for r in range(rounds):
        now = sc.broadcast(weights)

        def part(batches):
            classes, first = table.value, now.value
            own = [w.copy() for w in first]
            squares, fired = ([np.zeros(len(w), np.float32) for w in own] for _ in range(2))
            for batch in batches:
                for _, tokens, bounds in _streams(batch.column(0)):
                    label, keys, parts = classes.of(tokens)[0], histories(tokens, bounds), _part(tokens)
                    for a in range(0, len(tokens), _STEP):
                        cut = slice(a, a + _STEP)
                        for k, _, at, y in _factors(keys[cut], label[cut], parts[cut], classes, rows):
                            _descend(own[k], squares[k], fired[k], at, y, rate)
            for k, w in enumerate(own):
                w -= first[k]
                w *= fired[k][:, None]
                blocks = [b for b in range(0, len(w), _BLOCK) if fired[k][b:b + _BLOCK].any()]
                sums = [np.hstack((fired[k][b:b + _BLOCK, None], w[b:b + _BLOCK])).tobytes() for b in blocks]
                yield batch_of([pa.array([k] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()),
                                pa.array(sums, pa.binary())], ["factor", "block", "sums"])

        def total(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for k, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    held[k, b] = held.get((k, b), 0) + np.frombuffer(raw, np.float32)
            for (k, b), sums in held.items():
                sums = sums.reshape(-1, now.value[k].shape[1] + 1)
                moved = sums[:, 1:] / np.maximum(sums[:, :1], 1)
                yield batch_of([pa.array([k], pa.int32()), pa.array([b], pa.int32()),
                                pa.array([moved.astype(np.float32).tobytes()], pa.binary())], ["factor", "block", "sums"])
        share = learn.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        # Every task emits a model: a task reads as many rows a round as a partition of the table has.
        tasks = max(1, -(-share.rdd.getNumPartitions() // rounds))
        summed = (share.coalesce(tasks).mapInArrow(bounded(part, lambda b: b.column(0)), schema)
                  .repartition("factor", "block").mapInArrow(total, schema))
        weights = [w.copy() for w in weights]
        for row in summed.collect():  # the size of the model
            w = weights[row["factor"]]
            w[row["block"]:row["block"] + _BLOCK] += np.frombuffer(row["sums"], np.float32).reshape(-1, w.shape[1])
        now.unpersist()
    return weights


def _fold(parts: int):
    return F.crc32(F.col("id").cast("string").cast("binary")) % parts


def _model_rows(distinct: int, max_rows: int) -> int:
    """A quarter of the distinct tokens, as a power of two between MIN_ROWS and ``max_rows``."""
    return min(max(1 << max(distinct // 4, 1).bit_length(), MIN_ROWS), max_rows)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10, rounds: int = 4,
          max_frequent: int = 40_000, max_rows: int = 1 << 15, rate: float = 0.05) -> DataFrame:
    """One row per document: ``held_out, n_tokens, n_known, train_tokens, base_score, score``; ``max_rows`` is a power of two."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(_fold(parts) == 0, F.lit(False))
    learn = narrow.where(~held_out).select("text")
    counts = written(_summed(learn), "token-counts")
    total, distinct = np.zeros(PARTS, np.int64), np.zeros(PARTS, np.int64)
    for row in counts.groupBy(F.shiftrightunsigned("key", 59).alias("part")).agg(
            F.sum("n").alias("n"), F.count("*").alias("m")).collect():  # PARTS rows
        total[row["part"]], distinct[row["part"]] = row["n"], row["m"]
    top = counts.orderBy(F.desc("n"), "key").limit(max_frequent).toPandas()  # at most max_frequent rows
    classes = Classes(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total, distinct)
    total, distinct = classes.total, classes.distinct
    table = spark.sparkContext.broadcast(classes)
    model = spark.sparkContext.broadcast(fit(learn, table, rounds, _model_rows(distinct, max_rows), rate))
    log_all = math.log10(total + 0.1 * (distinct + 1))

    def partial(batches):
        c, w = table.value, model.value
        base_of, in_part = np.log10(c.counts + 0.1), np.log10(np.maximum(c.share, 1e-9))
        for batch in batches:
            out = []
            for _, tokens, bounds in _streams(batch.column(1)):
                label, at = c.of(tokens)
                part = _part(tokens)
                known = np.where(at >= 0, base_of[at], 0.0) if len(base_of) else np.zeros(len(at))
                logs = log_factors(w, histories(tokens, bounds), label, part, c) / math.log(10) - in_part[label, part]
                known, logs = (np.add.reduceat(x, bounds[:-1]) for x in (known, known + logs))
                for r in range(len(bounds) - 1):
                    own, place = tokens[bounds[r]:bounds[r + 1]], at[bounds[r]:bounds[r + 1]]
                    rare = np.sort(own[place < 0])
                    at_first = np.flatnonzero(np.append(True, rare[1:] != rare[:-1])[:len(rare)])
                    rare, n = rare[at_first], np.diff(at_first, append=len(rare))
                    out.append((len(own), int((place >= 0).sum()), float(known[r] - len(own) * log_all), float(logs[r]),
                                rare.view(np.int64), n))
            yield batch_of([batch.column(0), batch.column(2)] + [
                pa.array([o[k] for o in out], kind) for k, kind in enumerate(
                    [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())])],
                ["id", "digest", "n_tokens", "n_frequent", "base_part", "score_part", "rare", "n_rare"])
    kind = narrow.schema["id"].dataType.simpleString()
    parted = written(narrow.withColumn("digest", F.xxhash64("text")).mapInArrow(
        bounded(partial, lambda b: b.column(1)), f"id {kind}, digest bigint, n_tokens bigint, n_frequent bigint, base_part double, score_part double, "
                 "rare array<bigint>, n_rare array<bigint>"), "lm-parts")
    rows = parted.select("id", "digest", F.inline(F.arrays_zip(F.col("rare").alias("key"), F.col("n_rare").alias("m"))))
    found = (rows.join(counts.select("key", "n"), "key", "left").groupBy("id", "digest").agg(
        F.sum("m").alias("emitted"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("known"),
        F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("logs")))
    own = F.col("n_tokens") - F.col("n_frequent")
    copies = F.coalesce(F.col("emitted") / own, F.lit(1.0))  # equal rows were summed together
    logs = F.coalesce(F.col("logs") / copies, F.lit(0.0))
    p, f = parted.alias("p"), found.alias("f")
    joined = p.join(f, F.col("p.id").eqNullSafe(F.col("f.id")) & F.col("p.digest").eqNullSafe(F.col("f.digest")), "left")
    joined = joined.select(F.col("p.id").alias("id"), "n_tokens", "n_frequent", "base_part", "score_part", "emitted", "known", "logs")
    return joined.select(
        F.col("id").alias(id_col), held_out.alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce(F.round(F.col("known") / copies), F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base_part") + logs).alias("base_score"),
        (F.col("score_part") + logs).alias("score"))
