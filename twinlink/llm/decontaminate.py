"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window
is ``n`` consecutive words of a benchmark item; a shorter item is one window, an
item without words has none.  The windows' hashes go to the workers in blocks of
bounded size; each block is one map-only pass over the documents, which looks up
the hashes of all document windows, verifies a hit word by word (64-bit hash of
each word) and marks the words it covers.  There is no shuffle of documents.

Edge cases: a null or empty text has no words; a null item id still marks words
but is not listed; repeated rows of either table are handled each on its own
(an item id is listed once); an empty benchmark hits nothing; other columns of
the documents, whatever their names, are passed through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .frames import as_struct, batch_of, bounded, field_of, replace_field, with_fields, written

# Windows broadcast at once: at most this many (window, item) rows of about 120 bytes.
BLOCK_WINDOWS = 200_000


def _windows_of(column, n: int):
    """``(row, word-hash tuple)`` of every window of the items in a column."""
    for first, _, buf, bounds in T.text_chunks(column):
        buf = T.LOWER[buf]
        starts, ends, _, per_row = T.word_spans(buf, bounds, T.ALNUM)
        words = T.span_hashes(buf, starts, ends)
        for r in range(len(bounds) - 1):
            own = words[per_row[r]:per_row[r + 1]]
            width = min(n, len(own))
            for i in range(len(own) - width + 1 if width else 0):
                yield first + r, own[i:i + width]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """One row per distinct (window, item): item id as a string, the window's word hashes as bytes."""
    def windows(batches):
        for batch in batches:
            found = {(batch.column(0)[r].as_py(), w.tobytes()) for r, w in _windows_of(batch.column(1), n)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())],
                names=["item", "words"])
    narrow = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    return narrow.mapInArrow(windows, "item string, words binary").distinct()


class _Block:
    """Windows of one broadcast block, by width: sorted run hashes, word hashes and items."""

    def __init__(self, rows):
        by_width: dict[int, dict[bytes, list]] = {}
        for item, words in rows:
            items = by_width.setdefault(len(words) // 8, {}).setdefault(bytes(words), [])
            if item is not None:
                items.append(item)
        self.names = np.array(sorted({i for ws in by_width.values() for items in ws.values() for i in items}), object)
        number = {x: k for k, x in enumerate(self.names)}
        self.widths = {}
        for width, windows in by_width.items():
            words = np.frombuffer(b"".join(windows), dtype=np.uint64).reshape(-1, width)
            per_row = np.arange(0, len(windows) * width + 1, width)
            hashes, _ = T.run_hashes(words.reshape(-1).copy(), per_row, width)
            order = np.argsort(hashes, kind="stable")
            items = [[number[i] for i in own] for own in windows.values()]
            at = np.cumsum([0] + [len(items[o]) for o in order])
            flat = np.array([i for o in order for i in items[o]], dtype=np.int64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.widths[width] = (hashes[order], words[order], at, flat, bits)

    def hits(self, words, per_row):
        """``(first word, width, window's items)`` triples of arrays for each width."""
        for width, (hashes, own, at, flat, bits) in self.widths.items():
            runs, starts = T.run_hashes(words, per_row, width)
            maybe = np.flatnonzero(bits[(runs >> np.uint64(44)).astype(np.int64)])
            runs, starts = runs[maybe], starts[maybe]
            k0 = np.searchsorted(hashes, runs, "left")
            k1 = np.searchsorted(hashes, runs, "right")
            while True:  # more than one round only when run hashes collide
                live = k0 < k1
                if not live.any():
                    break
                starts, k0, k1 = starts[live], k0[live], k1[live]
                same = np.ones(len(starts), dtype=bool)
                for j in range(width):
                    same &= words[starts + j] == own[k0, j]
                yield starts[same], width, at[k0[same]], at[k0[same] + 1], flat
                k0 = k0 + 1


def _mark(text, old_hits, old_items, block):
    """Word counts, hit counts, hit bitmaps and item lists of a text column, merged with the old ones."""
    n_words, n_hits, hits, items = [], [], [], []
    n_items = max(1, len(block.names))
    for first, last, buf, bounds in T.text_chunks(text):
        buf = T.LOWER[buf]
        starts, ends, row, per_row = T.word_spans(buf, bounds, T.ALNUM)
        words = T.span_hashes(buf, starts, ends)
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        pairs = []
        for at, width, i0, i1, flat in block.hits(words, per_row):
            covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + width, minlength=len(covered))
            n = i1 - i0
            which = np.repeat(i0 - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(row[np.repeat(at, n)] * n_items + flat[which])
        hit = np.cumsum(covered[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        by_row = np.searchsorted(pairs, np.arange(last - first + 1) * n_items)
        for r in range(last - first):
            a, b = per_row[r], per_row[r + 1]
            own = hit[a:b] if total[b] > total[a] else None
            old = old_hits[first + r].as_py()
            if old is not None:
                before = np.unpackbits(np.frombuffer(old, np.uint8), count=b - a).astype(bool)
                own = before if own is None else own | before
            n_words.append(b - a)
            n_hits.append(0 if own is None else int(own.sum()))
            hits.append(None if own is None else np.packbits(own).tobytes())
            new = block.names[pairs[by_row[r]:by_row[r + 1]] % n_items].tolist() if by_row[r + 1] > by_row[r] else []
            items.append(sorted({*(old_items[first + r].as_py() or ()), *new}))
    return [pa.array(n_words, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(hits, pa.binary()),
            pa.array(items, pa.list_(pa.string()))]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", n: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with ``n_words``, ``n_hit``, ``hits`` (packed bits, one per
    word; null when none) and ``items`` (string ids of the items with a window in the text, sorted)."""
    spark = docs.sparkSession
    windows = written(benchmark_windows(benchmark, item_col, item_text_col, n), "benchmark-windows")
    blocks = max(1, math.ceil(windows.count() / block_windows))
    part = F.pmod(F.xxhash64("words", "item"), F.lit(blocks))
    added = "n_words bigint, n_hit bigint, hits binary, items array<string>"
    at = docs.columns.index(text_col)
    state = as_struct(docs).select("doc", F.lit(0).cast("bigint").alias("n_words"),
                                   F.lit(0).cast("bigint").alias("n_hit"), F.lit(None).cast("binary").alias("hits"),
                                   F.lit(None).cast("array<string>").alias("items"))
    for k in range(blocks):
        block = spark.sparkContext.broadcast([tuple(r) for r in windows.where(part == k).collect()])

        def one_pass(batches, block=block):
            table = _Block(block.value)
            for batch in batches:
                doc = batch.column(0)
                marked = _mark(field_of(doc, at), batch.column(3), batch.column(4), table)
                yield batch_of([doc, *marked], ["doc", "n_words", "n_hit", "hits", "items"])
        state = state.mapInArrow(bounded(one_pass, lambda batch: field_of(batch.column(0), at)), with_fields(docs, added))
        if k + 1 < blocks:
            state = written(state, "decontaminate-block")
    return state


def _without_hits(text, hits):
    """Texts without their hit words; what stood between two removed neighbours goes too."""
    out = []
    for first, last, buf, bounds in T.text_chunks(text):
        starts, ends, _, per_row = T.word_spans(T.LOWER[buf], bounds, T.ALNUM)
        for r in range(last - first):
            raw = buf[bounds[r]:bounds[r + 1]].tobytes()
            packed = hits[first + r].as_py()
            if packed is not None:
                a, b = per_row[r], per_row[r + 1]
                flag = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(np.int8)
                edge = np.diff(np.concatenate(([0], flag, [0])))
                cut, kept = 0, []
                for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    kept.append(raw[cut:starts[a + i] - bounds[r]])
                    cut = ends[a + j - 1] - bounds[r]
                raw = b"".join([*kept, raw[cut:]])
            out.append(raw.decode("utf-8") if text[first + r].is_valid else None)
    return pa.array(out, text.type)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text",
                  **options) -> DataFrame:
    """``docs`` without its contaminated rows (``remove='documents'``) or without the hit words
    (``remove='spans'``); same columns."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    marked = scan(docs, benchmark, text_col, **options)
    if remove == "documents":
        return marked.where(F.col("n_hit") == 0).select("doc.*")
    at = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            doc = batch.column(0)
            yield batch_of([replace_field(doc, at, _without_hits(field_of(doc, at), batch.column(1)))], ["doc"])
    return marked.select("doc", "hits").mapInArrow(cut, as_struct(docs).schema).select("doc.*")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           **options) -> DataFrame:
    """One row per document: ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    marked = scan(docs.select(id_col, text_col), benchmark, text_col, **options)
    return marked.select(F.col("doc")[id_col].alias(id_col), "n_words", "n_hit",
                         F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))
