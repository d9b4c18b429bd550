"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

Slices come from ``pretokens`` (no regex).  A slice that is in the vocabulary is its rank;
any other is merged pair by pair, lowest rank first, leftmost on ties; both are kept in a
cache of bounded size in the worker.  Long slices are merged with a heap, so that their cost
grows as n log n.  The byte offset of every token is kept: ``offsets`` gives each token's end in
the text's UTF-8 bytes.  Decoding joins the vocabulary's bytes.

Edge cases: a null or empty text has no ids and decodes to an empty text (encoding leaves null ids for
a null text, ``report`` treats both as empty); a text of any length is encoded whole; an unknown id
raises in decoding; repeated rows pass one by one; other columns pass through; empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretokens, textops as T
from .frames import as_struct, batch_of, bounded, field_of, give_back, with_fields

_TOKENS = 500_000  # ids that are decoded at a time
_CACHED = 250_000
_LONG = 48


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    with open(path, "rb") as f:  # a library file present on every worker, its path a parameter
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return ranks, {rank: token for token, rank in ranks.items()}


def _merge_short(token: bytes, ranks) -> list[int]:
    none, get = 1 << 40, ranks.get
    parts = [token[k:k + 1] for k in range(len(token))]
    scores = [get(token[k:k + 2], none) for k in range(len(token) - 1)]
    while scores:
        best = min(scores)
        if best == none:
            break
        k = scores.index(best)
        del scores[k]
        parts[k] += parts.pop(k + 1)
        if k:
            scores[k - 1] = get(parts[k - 1] + parts[k], none)
        if k < len(scores):
            scores[k] = get(parts[k] + parts[k + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(token: bytes, ranks) -> list[int]:
    n = len(token)
    end = list(range(1, n + 1))          # end of the part that begins at k; 0 once merged away
    prev = list(range(-1, n - 1))        # start of the part before

    def push(k):
        if k >= 0 and end[k] < n:
            rank = ranks.get(token[k:end[end[k]]])
            if rank is not None:
                heapq.heappush(heap, (rank, k, end[end[k]]))
    heap: list = []
    for k in range(n - 1):
        push(k)
    while heap:
        _, k, stop = heapq.heappop(heap)
        mid = end[k]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[k], end[mid] = stop, 0
        if stop < n:
            prev[stop] = k
        push(prev[k])
        push(k)
    out, k = [], 0
    while k < n:
        out.append(ranks[token[k:end[k]]])
        k = end[k]
    return out


class _Numbers(dict):
    """Number of every known slice; an unknown one is merged, and its ids join one flat array."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks, self.flat, self.starts = ranks, array("i"), array("q", [0])

    def __missing__(self, token: bytes) -> int:
        rank = self.ranks.get(token)
        if rank is not None:
            self.flat.append(rank)
        else:
            self.flat.extend((_merge_long if len(token) > _LONG else _merge_short)(token, self.ranks))
        self.starts.append(len(self.flat))
        self[token] = number = len(self.starts) - 2
        return number


@lru_cache(maxsize=1)
def token_lengths(path: str) -> np.ndarray:
    """Bytes of every token, by rank."""
    tokens = vocabulary(path)[1]
    out = np.zeros(max(tokens) + 1, dtype=np.int64)
    for rank, token in tokens.items():
        out[rank] = len(token)
    return out


class Encoder:
    """Ids of texts, with a cache of slices; between chunks a cache that is full begins anew."""

    def __init__(self, path: str):
        self.ranks, self.tokens = vocabulary(path)
        self.lengths = token_lengths(path)
        self.numbers = _Numbers(self.ranks)

    def chunks(self, column):
        """``(ids, counts)`` chunk by chunk: flat ids and their number in each row (null: 0)."""
        for _, _, buf, bounds in T.text_chunks(column):
            cuts, per_row = pretokens.slices(buf, bounds)
            raw, at = buf.tobytes(), cuts.tolist()
            if len(self.numbers) > _CACHED or len(self.numbers.flat) > 8 * _CACHED:
                self.numbers = _Numbers(self.ranks)
            found = map(self.numbers.__getitem__, map(raw.__getitem__, map(slice, at, at[1:])))
            found = np.fromiter(found, dtype=np.int32, count=len(at) - 1)
            starts, flat = np.array(self.numbers.starts), np.array(self.numbers.flat)
            sizes = (starts[1:] - starts[:-1])[found]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            ids = flat[np.repeat(starts[found] - ends[:-1], sizes) + np.arange(ends[-1])]
            yield ids, np.diff(ends[per_row])

    def encode(self, column) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids and token ends of every row (both null for a null)."""
        parts = list(self.chunks(column))
        ids = np.concatenate([np.zeros(0, np.int32), *(own for own, _ in parts)])
        rows = np.concatenate([[0], *(own for _, own in parts)]).cumsum()
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))
        offsets = ends[1:] - np.repeat(ends[rows[:-1]], np.diff(rows))
        return tuple(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(own), mask=column.is_null())
                     for own in (ids.astype(np.int32), offsets.astype(np.int32)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """This worker's encoder; its cache lives as long as the worker."""
    return Encoder(path)


IDS = "ids array<int>"
ENCODED = f"{IDS}, offsets array<int>"


def encode(docs: DataFrame, path: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with the ``ids`` of its text and, if asked for, each token's end, ``offsets``."""
    at = docs.columns.index(text_col)
    names = ["doc", "ids", "offsets"] if offsets else ["doc", "ids"]

    def run(batches):
        for part in batches:
            ids, ends = encoder(path).encode(field_of(part.column(0), at))
            yield batch_of([part.column(0), ids, ends] if offsets else [part.column(0), ids], names)
    return as_struct(docs).mapInArrow(bounded(run, lambda batch: field_of(batch.column(0), at)), with_fields(docs, ENCODED if offsets else IDS))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """``encoded`` as struct ``doc`` with ``decoded``, the bytes of its ids (null ids: null).

    With ``offsets_col`` the tokens' ends are those of the encoded text: a row whose tokens end elsewhere
    when decoded fails the job."""
    at = encoded.columns.index(ids_col)
    ends_at = encoded.columns.index(offsets_col) if offsets_col else None

    def checked(lists, ends, lengths):
        rows = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[rows[0]:rows[-1]]
        total = np.concatenate(([0], np.cumsum(lengths[ids], dtype=np.int64)))
        rows = rows - rows[0]
        own = total[1:] - np.repeat(total[rows[:-1]], np.diff(rows))
        told = ends.values.to_numpy(zero_copy_only=False)[ends.offsets[0].as_py():ends.offsets[-1].as_py()]
        if not np.array_equal(own, told):
            raise ValueError("tokens end elsewhere than where they were cut")

    def parts(batches):
        """Batches cut into runs of rows with at most ``_TOKENS`` ids, or of one row."""
        for batch in batches:
            ends = field_of(batch.column(0), at).offsets.to_numpy()
            first = 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(ends, ends[first] + _TOKENS, side="right")) - 1, first + 1)
                yield batch.slice(first, last - first)
                first = last

    def run(batches):
        tokens = vocabulary(path)[1]
        lengths = token_lengths(path) if ends_at is not None else None
        for batch in parts(batches):
            lists = field_of(batch.column(0), at)
            if ends_at is not None:
                checked(lists, field_of(batch.column(0), ends_at), lengths)
            rows = [None if not ids.is_valid else b"".join([tokens[i] for i in ids.values.to_numpy(zero_copy_only=False).tolist()])
                    for ids in lists]
            yield batch_of([batch.column(0), pa.array(rows, pa.binary())], ["doc", "decoded"])
        give_back()
    return as_struct(encoded).mapInArrow(run, with_fields(encoded, "decoded binary"))


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``n_tokens, ids_sha256, decoded_sha256``."""
    encoded = encode(docs.select(id_col, text_col), path, text_col)
    empty = F.array().cast("array<int>")
    encoded = encoded.select(F.col("doc")[id_col].alias("id"), F.coalesce("ids", empty).alias("ids"), F.coalesce("offsets", empty).alias("offsets"))
    out = decode(encoded, path, offsets_col="offsets")
    ids = F.col("doc.ids")
    return out.select(F.col("doc")["id"].alias(id_col), F.size(ids).cast("bigint").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
