"""Line dedup with two Bloom filters and an exact confirmation of suspects.

A text is split at line feeds; a null or empty text is one empty line.  A line's
key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased; the empty key is never a repeat.  A key found in at least
``min_docs`` rows is frequent.  ``keep='none'`` drops all lines of frequent keys,
``keep='first'`` keeps the first such line of the row with the smallest id.

Only keys whose hash is in the twice-seen filter (``bloom``) are shuffled, as
texts with one count per key and flush of a task, and confirmed exactly.  Frequent
keys go to the workers as a broadcast set while they take at most
``broadcast_bytes``; beyond that they are joined to the suspected lines (a
sort-merge join, whose hot keys Spark splits) and then to the documents by id.

Edge cases: every row is a document of its own, repeated ids included (with
``keep='first'``, rows that share the smallest id each keep their first line); a null
id counts as a document, and is no row's smallest id unless all ids are null; a null
text stays null; empty tables give no rows; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import bloom
from .frames import as_struct, batch_of, bounded, field_of, pieces, replace_field, with_fields, written

BROADCAST_BYTES = 64 << 20
SPACE = " \t\n\x0b\x0c\r"
_FLUSH = 200_000


def _keys(raw: bytes) -> list[bytes]:
    """Keys of the lines of a UTF-8 text (bytes.strip() strips exactly the stated white space)."""
    return [line.strip() for line in raw.lower().split(b"\n")]


def _distinct_keys(batch):
    """Distinct non-empty keys of every row of a (id, text) batch."""
    for part in pieces(batch, batch.column(1)):
        for raw in part.column(1).cast(pa.large_binary()).to_pylist():
            own = set(_keys(raw)) if raw else set()
            own.discard(b"")
            yield own


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def _suspects(packed):
    """Function giving the keys of a set that may be in several rows."""
    def pick(keys: set) -> list[bytes]:
        own = list(keys)
        return [own[i] for i in np.flatnonzero(bloom.contains(packed, _hashes(own)))] if own else own
    return pick


def frequent_keys(narrow: DataFrame, packed, min_docs: int) -> DataFrame:
    """``key, n_docs, first_id`` of the keys in at least ``min_docs`` rows, counted exactly."""
    def counts(batches):
        pick, held = _suspects(packed.value), {}

        def out():
            return batch_of([pa.array(held.keys(), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()),
                             pa.array([v[1] for v in held.values()], id_type)], ["key", "n", "first_id"])
        for batch in batches:
            id_type = batch.column(0).type
            for own_id, keys in zip(batch.column(0).to_pylist(), _distinct_keys(batch)):
                for key in pick(keys):
                    n, first = held.get(key, (0, None))
                    held[key] = (n + 1, own_id if first is None or own_id is not None and own_id < first else first)
            if len(held) >= _FLUSH:
                yield out()
                held = {}
        if held:
            yield out()
    id_kind = narrow.schema.fields[0].dataType.simpleString()
    return (narrow.mapInArrow(bounded(counts, lambda batch: batch.column(1)), f"key binary, n bigint, first_id {id_kind}").groupBy("key")
            .agg(F.sum("n").alias("n_docs"), F.min("first_id").alias("first_id")).where(F.col("n_docs") >= min_docs))


def _drop(ids, texts, frequent_of, keep_first: bool):
    """Line counts, dropped counts and texts; ``frequent_of(row)`` maps frequent keys to their first id."""
    n_lines, n_dropped, out = [], [], []
    for row, (own_id, raw) in enumerate(zip(ids.to_pylist(), texts.cast(pa.large_binary()).to_pylist())):
        lines, keys, frequent = (raw or b"").split(b"\n"), _keys(raw or b""), frequent_of(row)
        kept, first_seen = [], set()
        for line, key in zip(lines, keys):
            if key and key in frequent:
                if not (keep_first and frequent[key] == own_id and key not in first_seen):
                    continue
                first_seen.add(key)
            kept.append(line)
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        out.append(None if raw is None else raw if len(kept) == len(lines) else b"\n".join(kept))
    return [pa.array(out, pa.large_binary()).cast(texts.type), pa.array(n_lines, pa.int64()),
            pa.array(n_dropped, pa.int64())]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               keep: str = "none", broadcast_bytes: int = BROADCAST_BYTES, filter_bits: int | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with its text deduplicated, ``n_lines`` and ``n_dropped``."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bits = filter_bits or bloom.filter_bits(16 * docs.count())
    packed = sc.broadcast(bloom.twice_seen(narrow, lambda batch: map(_hashes, _distinct_keys(batch)), bits))
    frequent = written(frequent_keys(narrow, packed, min_docs), "frequent-lines")
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    added, keep_first = "n_lines bigint, n_dropped bigint", keep == "first"
    size = frequent.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0

    def texts_of(batch):
        return field_of(batch.column(0), text_at)

    def dropped(doc, frequent_of):
        text, n_lines, n_dropped = _drop(field_of(doc, id_at), field_of(doc, text_at), frequent_of, keep_first)
        return batch_of([replace_field(doc, text_at, text), n_lines, n_dropped], ["doc", "n_lines", "n_dropped"])

    if size <= broadcast_bytes:
        table = sc.broadcast({bytes(r[0]): r[1] for r in frequent.select("key", "first_id").collect()})

        def by_set(batches):
            known = table.value
            for batch in batches:
                yield dropped(batch.column(0), lambda _: known)
        return as_struct(docs).mapInArrow(bounded(by_set, texts_of), with_fields(docs, added))

    def suspected(batches):
        pick = _suspects(packed.value)
        for batch in batches:
            found = [(i, k) for i, keys in zip(batch.column(0).to_pylist(), _distinct_keys(batch)) for k in pick(keys)]
            yield batch_of([pa.array([f[0] for f in found], batch.column(0).type),
                            pa.array([f[1] for f in found], pa.binary())], ["id", "key"])

    lines = narrow.mapInArrow(suspected, f"id {narrow.schema.fields[0].dataType.simpleString()}, key binary")
    own = (lines.join(frequent, "key").groupBy("id").agg(F.collect_set(F.struct("key", "first_id")).alias("keys")))
    joined = as_struct(docs).join(own, F.col("doc")[id_col].eqNullSafe(F.col("id")), "left").select("doc", "keys")

    def by_join(batches):
        for batch in batches:
            keys = batch.column(1).to_pylist()
            yield dropped(batch.column(0), lambda row: {k["key"]: k["first_id"] for k in keys[row] or ()})
    return joined.mapInArrow(bounded(by_join, texts_of), with_fields(docs, added))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``n_lines, n_dropped, kept_sha256``."""
    out = line_dedup(docs.select(id_col, text_col), id_col, text_col, **options)
    return out.select(F.col("doc")[id_col].alias(id_col), "n_lines", "n_dropped",
                      F.sha2(F.coalesce(F.col("doc")[text_col], F.lit("")), 256).alias("kept_sha256"))
