"""Vectorised byte-text helpers for the operators that run in Arrow batches.

A batch column of strings is one UTF-8 buffer with offsets.  The helpers cut it
into chunks of bounded size, find words by a byte-class table, hash words eight
bytes at a time and hash runs of consecutive words, all in numpy without a
Python loop over bytes or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = [np.uint64((1 << (8 * n)) - 1) for n in range(8)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
LOW_MASK = np.array(_LOW, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# Bytes of words split at [\x20\x09-\x0D].
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; overwrites and returns ``x``."""
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column, limit: int = CHUNK_BYTES):
    """Yield ``(first, last, buf, bounds)`` for rows ``first:last`` of a string column.

    ``buf`` holds their UTF-8 bytes followed by eight zero bytes, ``bounds`` the
    row offsets in it.  Nulls are empty.  A chunk has at most ``limit`` bytes or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        a, b = int(offsets[first]), int(offsets[last])
        buf = np.zeros(b - a + 8, dtype=np.uint8)
        buf[:b - a] = raw[a:b]
        yield first, last, buf, offsets[first:last + 1] - a
        first = last


def word_spans(buf: np.ndarray, bounds: np.ndarray, table: np.ndarray):
    """``(starts, ends, row)`` of the words of every row, in order; a word never crosses rows."""
    size = int(bounds[-1])
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:size + 1] = table[buf[:size]]
    first = inside[1:size + 1] & ~inside[:size]
    last = inside[1:size + 1] & ~inside[2:size + 2]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    joint = cuts[inside[cuts + 1] & inside[cuts]]
    first[joint] = True
    last[joint - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_row = np.searchsorted(starts, bounds)
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), np.diff(per_row)), per_row


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of ``buf`` (which has eight spare bytes at its end)."""
    eight = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf.data, strides=(1,))
    lengths = ends - starts
    out = lengths.astype(np.uint64) * _GOLD
    out ^= np.uint64(seed)
    where, pos, left = None, starts, lengths
    while True:
        part = eight[pos] & LOW_MASK[np.minimum(left, 8)]
        if where is None:
            part ^= out
            part *= _GOLD
            out = mix(part)
        else:
            part ^= out[where]
            part *= _GOLD
            out[where] = mix(part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        where = more if where is None else where[more]
        pos, left = pos[more] + 8, left[more] - 8


def run_hashes(words: np.ndarray, per_row: np.ndarray, width: int, seed: int = 0):
    """Hashes of all runs of ``width`` consecutive words of one row.

    Returns ``(hashes, at)``: ``at`` is the index of each run's first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.zeros(len(words) + 1, dtype=np.int64)
    counts = np.diff(per_row)
    ok = counts >= width
    np.add.at(keep, per_row[:-1][ok], 1)
    np.add.at(keep, per_row[1:][ok] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(keep[:n]))
    acc = words[at] + np.uint64(seed)
    for k in range(1, width):
        acc *= _GOLD
        acc ^= acc >> np.uint64(29)
        acc += words[at + k]
    return mix(acc * _M2), at


def group_starts(per_row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Offsets into ``at`` (run starts) for every row."""
    return np.searchsorted(at, per_row)
