"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its
distinct 5-word shingles (all its words as one with fewer, empty without words).
Documents link when their sets' Jaccard similarity is at least ``percent`` / 100.

1. One scan gives every document its set's size and 128-bit digest, its band keys and
   one byte per signature component (``superminhash``).
2. Documents with equal sets are one class; only the one with the smallest id goes on.
3. Band keys are counted; members of a shared bucket are paired with the bucket's
   smallest id only, the pairs verified on the full sets, and linked by ``components``.
   A bucket of thousands of near copies so costs one pair per member.
4. Buckets that still hold several components are searched for further links (bands of the same
   members once): members meet in tiles of about ``TILE`` with their full sets, all intersections of a tile are
   counted exactly by matrix products, and a union-find within the tile emits a spanning forest
   of the components that link, so a tile gives fewer links than it has members.
5. The verified links give the final components.

A pair at the similarity 0.75 shares no band with a probability of 2e-7.

Edge cases: a document without words has an empty set and links with nothing; so
does a null id (its component is null, and it is kept); rows that repeat an id are each
grouped by their own text, and count as one node where both represent their set; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import superminhash as S, textops as T
from .components import components
from .frames import batch_of, bounded, small, written

TILE = 512
_COLUMNS = 4096
_SKETCH_BYTES = 1 << 20


def _sets_of(column):
    for _, _, buf, bounds in T.text_chunks(column, _SKETCH_BYTES):
        yield S.distinct_sets(*S.shingle_runs(buf, bounds))


def sketches(narrow: DataFrame) -> DataFrame:
    """``id, n_shingles, digest, sig, bands`` of every row of (id, text); nulls for an empty set."""
    def sketch(batches):
        for batch in batches:
            sizes, digests, sigs, bands = [], [], [], []
            for flat, offsets in _sets_of(batch.column(1)):
                sig = S.signatures(flat, offsets)
                low, keys = (sig & np.uint64(0xFF)).astype(np.uint8), S.band_keys(sig).view(np.int64)
                for r in range(len(offsets) - 1):
                    own = flat[offsets[r]:offsets[r + 1]]
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sigs.append(low[r].tobytes() if len(own) else None)
                    bands.append(keys[r] if len(own) else None)
            yield batch_of([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                            pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                           ["id", "n_shingles", "digest", "sig", "bands"])
    kind = narrow.schema.fields[0].dataType.simpleString()
    return narrow.mapInArrow(bounded(sketch, lambda batch: batch.column(1)), f"id {kind}, n_shingles bigint, digest binary, sig binary, bands array<bigint>")


def shingle_sets(narrow: DataFrame) -> DataFrame:
    """``id, shingles``: the set of every row of (id, text) as an array of hashes."""
    def sets(batches):
        for batch in batches:
            rows = [flat[o[r]:o[r + 1]].view(np.int64) for flat, o in _sets_of(batch.column(1))
                    for r in range(len(o) - 1)]
            yield batch_of([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "shingles"])
    kind = narrow.schema.fields[0].dataType.simpleString()
    return narrow.mapInArrow(bounded(sets, lambda batch: batch.column(1)), f"id {kind}, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "u").join(right, "v")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("u", "v").distinct())


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` and ``b``, exact: products of membership matrices over
    the hashes that both sides hold, a bounded number of columns at a time."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def cells(flat, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, flat)
        known = np.flatnonzero(at < len(both))
        known = known[both[at[known]] == flat[known]]
        order = known[np.argsort(at[known], kind="stable")]
        return row[order], at[order]
    if not len(both):
        return out.astype(np.int64)
    (row_a, at_a), (row_b, at_b) = cells(flat_a, a), cells(flat_b, b)
    for first in range(0, len(both), _COLUMNS):
        sides = []
        for row, at, n in ((row_a, at_a, len(a)), (row_b, at_b, len(b))):
            own = slice(np.searchsorted(at, first), np.searchsorted(at, first + _COLUMNS))
            side = np.zeros((n, min(_COLUMNS, len(both) - first)), np.float32)
            side[row[own], at[own] - first] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _forest(rows: list[tuple], percent: int):
    """Links (u > v) between members of one (key, t0, t1) tile whose sets reach the similarity, as a
    spanning forest over their components: fewer links than members, whatever the number of pairs."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    sides = [rows, rows] if rows[0][1] == rows[0][2] else [[r for r in rows if r[4] == t] for t in rows[0][1:3]]
    if not all(sides):
        return
    sets = [[r[5] for r in side] for side in sides]
    sizes = [np.array([len(x) for x in own]) for own in sets]
    common = _common(*sets)
    near = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    groups = np.unique([r[6] for side in sides for r in side], return_inverse=True)[1]
    near &= groups[:len(sides[0]), None] != groups[None, len(sides[0]):]
    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        left, right = sides[0][i], sides[1][j]
        x, y = root(left[6]), root(right[6])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield max(left[3], right[3]), min(left[3], right[3])


def _tile_links(percent: int):
    def links(batches):
        held, kind = [], None

        def batch(found):
            return batch_of([pa.array([p[k] for p in found], kind) for k in (0, 1)], ["u", "v"])
        for part in batches:
            kind = part.column(3).type
            sets = part.column(5)
            flat, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
            rows = zip(*(part.column(k).to_pylist() for k in (0, 1, 2, 3, 4)), part.column(6).to_pylist())
            found = []
            for n, row in enumerate(rows):
                if held and held[-1][:3] != row[:3]:
                    found += _forest(held, percent)
                    held = []
                held.append((*row[:5], flat[ends[n]:ends[n + 1]].copy(), row[5]))
            if found:
                yield batch(found)
        if held:
            yield batch(list(_forest(held, percent)))
    return links


def _further_links(buckets: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within the buckets that hold several components, verified on the full sets."""
    kind = buckets.schema["id"].dataType.simpleString()
    member = (buckets.join(small(known), buckets["id"] == known["node"], "left")
              .select("key", "id", F.coalesce("component", "id").alias("component")))
    member = written(member, "near-members")
    # Bands that hold the same members are one bucket.
    mixed = (member.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"),
                                       F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s0"),
                                       F.sum(F.xxhash64(F.lit(1), "id").cast("decimal(20,0)")).alias("s1"))
             .where("c0 <> c1").groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key", "n"))
    tiles = F.ceil(F.col("n") / TILE)
    t = F.pmod(F.xxhash64("id"), "tiles")
    rows = (member.join(mixed, "key").withColumn("tiles", tiles).withColumn("t", t)
            .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
            .select("key", F.least("t", "o").alias("t0"), F.greatest("t", "o").alias("t1"), "id", "t", "component")
            .join(sets, "id").select("key", "t0", "t1", "id", "t", "shingles", "component"))
    return (rows.repartition("key", "t0", "t1").sortWithinPartitions("key", "t0", "t1")
            .mapInArrow(_tile_links(percent), f"u {kind}, v {kind}").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row: the smallest id of its group, and whether it is that one."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = written(sketches(narrow), "near-sketches")
    classes = written(sketch.where("digest is not null and id is not null").groupBy("digest")
                      .agg(F.min("id").alias("rep")), "near-classes")
    reps = sketch.join(classes, (sketch["digest"] == classes["digest"]) & (sketch["id"] == classes["rep"]), "left_semi")
    keys = written(reps.select("id", "bands"), "near-reps").select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center <> last")
    buckets = written(keys.join(shared.select("key", "center"), "key"), "near-buckets")
    involved = written(buckets.select("id").distinct(), "near-involved")
    sets = written(shingle_sets(narrow.join(small(involved), "id", "left_semi")), "near-sets")
    star = buckets.where("id <> center").select(F.col("id").alias("u"), F.col("center").alias("v")).distinct()
    links = written(verified(star, sets, percent), "near-links")
    known = components(links)
    more = written(_further_links(buckets, known, sets, percent), "near-links")
    if not more.isEmpty():
        known = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    own = (sketch.select("id", "n_shingles", "digest").join(classes, "digest", "left")
           .join(known, F.col("rep") == F.col("node"), "left"))
    component = F.coalesce("component", "rep", "id")
    return own.select("id", "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"),
                      (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with one document of every near-duplicate group; same columns."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("id").alias("_gone_id"))
    gone = small(written(gone.distinct(), "near-gone"))
    return docs.join(gone, docs[id_col] == gone["_gone_id"], "left_anti")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``n_shingles, component_id, kept``."""
    out = near_duplicates(docs, id_col, text_col, **options)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")
