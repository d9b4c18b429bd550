"""Token counts by a two-tier lookup inside the map tasks; no pre-token is shuffled one by one.

Tier one is a broadcast hash table of frequent pre-tokens of at most ``SHORT`` bytes: their bytes and length packed
into two words, which are compared whole, so a hit is exact; slots are probed for all slices of a chunk at once.
It is only a cache filled beforehand, so it is gathered from a bounded sample: rows are drawn with equal
chances so that about ``sample_bytes`` of text are expected (all, if there is less), each task counts its own, and the
driver adds up what at most that much text holds; nothing is shuffled.  The table only decides where a length is
looked up, never which.  Tier two is a cache in each worker, which outlives tasks; what it lacks is encoded by the
library in one batch.  Strings of the file's added tokens inside texts count as one token each, as the library does
by default, and cut the texts.

Edge cases: a null or empty text has no tokens and 0 bytes; a text of any length is cut and
looked up whole; repeated rows and null ids are counted row by row; other columns pass through;
empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import pretokens, textops as T
from .frames import as_struct, batch_of, bounded, field_of, with_fields

_HELD = 400_000
_CACHED = 1_000_000
_LONGEST = 256
SHORT = 15


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tokenizer, regex.compile("|".join(map(regex.escape, added)).encode()) if added else None


def _pieces(column, added):
    """Texts cut at added tokens: ``(pieces, row of each piece, added tokens per row)``."""
    pieces, rows = [], []
    special = np.zeros(len(column), dtype=np.int64)
    for row, raw in enumerate(column.cast(pa.large_binary()).to_pylist()):
        own = added.split(raw) if raw and added else [raw or b""]
        special[row] = len(own) - 1
        pieces += own
        rows += [row] * len(own)
    return pa.array(pieces, pa.large_binary()), np.array(rows, dtype=np.int64), special


def _slices(column):
    """``(first row, bytes, cuts between slices, first slice of each row)`` chunk by chunk."""
    for first, _, buf, bounds in T.text_chunks(column):
        cuts, per_row = pretokens.slices(buf, bounds)
        yield first, buf.tobytes(), cuts, per_row


def sample_counts(narrow: DataFrame, path: str, sample_bytes: int, seed: int = 1) -> Counter:
    """Counts of the short pre-tokens in a sample of about ``sample_bytes`` of a one-column frame's text."""
    total = narrow.agg(F.sum(F.octet_length(narrow.columns[0]))).first()[0] or 0
    share = min(1.0, sample_bytes / total) if total else 0.0

    def held(batches):
        _, added = _library(path)
        counts = Counter()
        for batch in batches:
            for _, raw, cuts, _ in _slices(_pieces(batch.column(0), added)[0]):
                at = cuts.tolist()
                counts.update(raw[a:b] for a, b in zip(at, at[1:]) if b - a <= SHORT)
                if len(counts) > _HELD:
                    counts = Counter(dict(counts.most_common(_HELD // 2)))
        yield batch_of([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])
    own = narrow.sample(False, share, seed).mapInArrow(held, "token binary, n bigint").toArrow()
    sums = own.group_by("token").aggregate([("n", "sum")])
    return Counter(dict(zip(sums["token"].to_pylist(), sums["n_sum"].to_pylist())))


def _packed(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two words that hold each slice of at most ``SHORT`` bytes and its length, and their hash; ``raw`` ends with eight
    bytes that no slice holds."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    low = words[at] & T.LOW_MASK[np.minimum(size, 8)]
    high = size.astype(np.uint64) << np.uint64(56)
    more = np.flatnonzero(size > 8)
    high[more] |= words[at[more] + 8] & T.LOW_MASK[size[more] - 8]
    return low, high, T.mix(low ^ T.mix(high.copy()))


class FrequentTable:
    """Open-addressed hash table of token lengths in three arrays; a slot of length 0 is empty."""

    def __init__(self, tokens: list[bytes], lengths):
        size = np.array([len(t) for t in tokens], dtype=np.int64)
        raw = np.frombuffer(b"".join(tokens) + bytes(8), dtype=np.uint8)
        low, high, place = _packed(raw, np.cumsum(size) - size, size)
        self.bits = max(4, (2 * len(tokens)).bit_length())
        slots = 1 << self.bits
        self.low, self.high, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        lengths, left, self.probes = np.array(lengths, dtype=np.int32), np.arange(len(tokens)), 0
        while len(left):
            slot = self._slot(place[left], self.probes)
            free = np.flatnonzero(self.n[slot] == 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            for own, value in ((self.low, low), (self.high, high), (self.n, lengths)):
                own[slot[first]] = value[left[first]]
            left = np.delete(left, first)
            self.probes += 1

    def _slot(self, place: np.ndarray, probe: int) -> np.ndarray:
        return ((place >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def find(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Token lengths, 0 for what the table lacks."""
        out, left = np.zeros(len(low), np.int64), np.arange(len(low))
        for probe in range(self.probes):
            slot = self._slot(place[left], probe)
            n = self.n[slot]
            same = (self.low[slot] == low[left]) & (self.high[slot] == high[left]) & (n > 0)
            out[left[same]] = n[same]
            left = left[~same & (n > 0)]
            if not len(left):
                break
        return out


def frequent_table(narrow: DataFrame, path: str, max_frequent: int, sample_bytes: int) -> FrequentTable:
    """The table of at most ``max_frequent`` pre-tokens that the sample holds twice or more, most frequent first."""
    top = [t for t, n in sample_counts(narrow, path, sample_bytes).most_common(max_frequent) if n > 1]
    encoded = _library(path)[0].encode_batch_fast([t.decode() for t in top], add_special_tokens=False)
    lengths = list(map(len, encoded))
    known = [k for k, n in enumerate(lengths) if n]
    return FrequentTable([top[k] for k in known], [lengths[k] for k in known])


@lru_cache(maxsize=1)
def _worker_cache(path: str) -> dict[bytes, int]:
    """Lengths that this worker had the library find; lives as long as the worker."""
    return {}


class Lengths:
    """Token lengths of slices: the broadcast table, this worker's cache, then the library."""

    def __init__(self, path: str, table: FrequentTable):
        self.tokenizer, self.added = _library(path)
        self.table, self.cache = table, _worker_cache(path)

    def of(self, raw: bytes, cuts: np.ndarray) -> np.ndarray:
        """Lengths of the slices of ``raw`` (which ends with eight more bytes) between ``cuts``."""
        size = np.diff(cuts)
        out, short = np.zeros(len(size), np.int64), np.flatnonzero(size <= SHORT)
        out[short] = self.table.find(*_packed(np.frombuffer(raw, np.uint8), cuts[short], size[short]))
        missing = np.flatnonzero(out == 0)
        out[missing] = self._cached([raw[a:b] for a, b in zip(cuts[missing].tolist(), cuts[missing + 1].tolist())])
        return out

    def _cached(self, tokens: list[bytes]) -> list[int]:
        cache = self.cache
        if len(cache) > _CACHED:
            cache.clear()
        new = list(set(tokens) - cache.keys())
        # What is long is not kept after this call.
        fresh = dict(zip(new, map(len, self.tokenizer.encode_batch_fast([t.decode() for t in new], add_special_tokens=False))))
        cache.update((t, n) for t, n in fresh.items() if len(t) <= _LONGEST)
        return [fresh[t] if t in fresh else cache[t] for t in tokens]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", max_frequent: int = 200_000,
                 sample_bytes: int = 8 << 20) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with ``n_bytes`` and ``n_tokens`` of its text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs.select(text_col), path, max_frequent, sample_bytes))
    at = docs.columns.index(text_col)

    def count(batches):
        lengths = Lengths(path, table.value)
        for batch in batches:
            text = field_of(batch.column(0), at)
            pieces, rows, n_tokens = _pieces(text, lengths.added)
            for first, raw, cuts, per_row in _slices(pieces):
                sums = np.concatenate(([0], np.cumsum(lengths.of(raw, cuts))))
                np.add.at(n_tokens, rows[first:first + len(per_row) - 1], np.diff(sums[per_row]))
            n_bytes = [len(t) if t else 0 for t in text.cast(pa.large_binary()).to_pylist()]
            yield batch_of([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens)],
                           ["doc", "n_bytes", "n_tokens"])
    return as_struct(docs).mapInArrow(bounded(count, lambda batch: field_of(batch.column(0), at)),
                                      with_fields(docs, "n_bytes bigint, n_tokens bigint"))


def report(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_bytes, n_tokens, over_limit``."""
    out = count_tokens(docs.select(id_col, text_col), path, text_col)
    return out.select(F.col("doc")[id_col].alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
