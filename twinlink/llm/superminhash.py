"""Word-shingle sets and SuperMinHash signatures of text batches, in numpy.

An element of a set contributes to every component of the signature: component
``(a + j * b) mod M`` gets the value ``j + r_j``, where ``a``, ``b`` and the fractions
``r_j`` come from the element's hash.  M is prime, so an element's ranks j = 0, 1, ...
visit every component once: the ranks are a permutation, and the components of one
element are negatively correlated, which lowers the variance of the estimate below
that of independent hash functions.  A component is the smallest value over the set;
two sets agree in it with a probability equal to their Jaccard similarity.

Ranks are worked through one after the other for all elements of a batch.  After rank
j a set is finished when all its components are below j + 1: no later rank can win.
Sets much larger than M log M finish after the first rank.
"""

from __future__ import annotations

import numpy as np

from . import textops as T

COMPONENTS = 163  # prime
ROWS, BANDS = 4, 40
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_runs(buf, bounds, width: int = 5):
    """``(hashes, offsets)`` of the word shingles of every row, repeats included.

    A row of fewer words has one shingle, all its words; a row without words none."""
    buf = T.LOWER[buf]
    starts, ends, _, per_row = T.word_spans(buf, bounds, T.NON_SPACE)
    words = T.span_hashes(buf, starts, ends)
    runs, at = T.run_hashes(words, per_row, width)
    offsets = np.searchsorted(at, per_row)
    counts = np.diff(per_row)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for n in range(1, width):
            own = counts[short] == n
            acc = np.full(own.sum(), n, np.uint64)
            for k in range(n):
                acc = T.mix(acc + words[per_row[short[own]] + k])
            whole[own] = acc
        runs = np.insert(runs, offsets[short], whole)
        more = np.zeros(len(counts), np.int64)
        more[short] = 1
        offsets = offsets + np.concatenate(([0], np.cumsum(more)))
    return runs, offsets


def distinct_sets(runs, offsets):
    """Sorted distinct shingle hashes of every row, flat with offsets."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    runs, rows = runs[new], rows[new]
    return runs, np.searchsorted(rows, np.arange(len(offsets)))


def signatures(flat, offsets, m: int = COMPONENTS) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values per set (all ones for an empty set)."""
    n = len(offsets) - 1
    sig = np.full(n * m, _EMPTY, dtype=np.uint64)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(n), sizes)
    seed = T.mix(flat ^ _STEP)
    at = (seed % np.uint64(m)).astype(np.int32)
    hop = (1 + T.mix(seed + _STEP) % np.uint64(m - 1)).astype(np.int32)
    open_rows = sizes > 0
    for j in range(m):
        part = T.mix(seed + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        value = (part >> np.uint64(8)) | (np.uint64(j) << np.uint64(56))
        np.minimum.at(sig, rows * m + at, value)
        live = np.flatnonzero(open_rows)
        tops = sig.reshape(n, m)[live].max(axis=1)
        open_rows[live[tops < (np.uint64(j + 1) << np.uint64(56))]] = False
        if not open_rows.any():
            break
        keep = open_rows[rows]
        if not keep.all():
            rows, seed, at, hop = rows[keep], seed[keep], at[keep], hop[keep]
        at = at + hop
        at[at >= m] -= m
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per set and band."""
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = T.mix(acc * _STEP + sig[:, b * rows + r])
        out[:, b] = acc
    return out
