"""Two Bloom filters over the hashes of all documents: seen once, and seen twice.

Tasks send the bit positions of their hashes, not the hashes; positions of a
filter block meet in one streaming task, which keeps two bitmaps per block: a bit
that arrives from a second document sets the twice-seen bit.  A hash of two or
more documents has all its bits in the twice-seen filter, so the filter gives no
false negatives; false positives only cost their caller an exact check.

The twice-seen filter has a fixed number of bits (at most ``MAX_BITS``), so what
reaches the driver and every worker is bounded; when the input is so large that the
filter fills up, it suspects more, and callers shuffle up to all their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import batch_of, give_back

BLOCK_BITS = 1 << 20
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
PROBES = 2
_FLUSH = 1 << 20


def filter_bits(keys: int) -> int:
    """A power of two with about 16 bits per key, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (16 * max(1, keys) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of the hashes, one row per probe."""
    shift, mask = np.uint64(64 // PROBES), np.uint64(bits - 1)
    return np.stack([(hashes >> (shift * np.uint64(k))) & mask for k in range(PROBES)]).astype(np.int64)


def _partial(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """Once- and twice-seen positions of the hashes (one per document and key), by filter block."""
    own, counts = np.unique(hashes, return_counts=True)
    once = np.unique(positions(own, bits))
    twice = np.unique(positions(own[counts > 1], bits))
    blocks = np.unique(once // BLOCK_BITS)
    rows = [[np.sort(p[a:b] % BLOCK_BITS).astype(np.uint32).tobytes() for a, b in
             zip(np.searchsorted(p, blocks * BLOCK_BITS), np.searchsorted(p, (blocks + 1) * BLOCK_BITS))]
            for p in (once, twice)]
    return batch_of([pa.array(blocks, pa.int32()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())],
                    ["block", "once", "twice"])


def twice_seen(docs: DataFrame, hashes_of, bits: int) -> np.ndarray:
    """Packed bits of the twice-seen filter.

    ``hashes_of(batch)`` yields uint64 arrays with every hash once per document."""
    def partial(batches):
        held, n = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                n += len(hashes)
                if n >= _FLUSH:
                    yield _partial(np.concatenate(held), bits)
                    held, n = [], 0
        if n:
            yield _partial(np.concatenate(held), bits)
        give_back()

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                if block not in seen:
                    seen[block] = (np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool))
                first, second = seen[block]
                at = np.frombuffer(once, np.uint32)
                second[at] |= first[at]
                first[at] = True
                second[np.frombuffer(twice, np.uint32)] = True
        packed = {b: np.packbits(s[1]).tobytes() for b, s in seen.items()}
        yield batch_of([pa.array(packed.keys(), pa.int32()), pa.array(packed.values(), pa.binary())], ["block", "bits"])

    spark = docs.sparkSession
    parts = max(1, min(bits // BLOCK_BITS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = (docs.mapInArrow(partial, "block int, once binary, twice binary").repartition(parts, "block")
              .mapInArrow(merge, "block int, bits binary"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for block, own in blocks.toLocalIterator():
        out[block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8] = np.frombuffer(own, np.uint8)
    return out


def contains(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have been seen twice."""
    out = np.ones(len(hashes), dtype=bool)
    for at in positions(hashes, len(packed) * 8):
        out &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out
