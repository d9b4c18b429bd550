"""How the sources of each language differ in their terms.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.  A language keeps
the terms of at least ``min_docs`` of its documents; V is their number.  A (language, source)
group, and each language as a whole, gives a kept term p = 1 + floor(10**9 (count + 1) / (N + V)),
N its occurrences of kept terms.  f(p, q) = floor((p - q)**2 / q) is exact everywhere.

1. Tasks count terms per group in numpy.  Terms of up to eight bytes become one uint64
   word, of up to sixteen two; they are sorted by 16-bit digits (stable counting passes, the
   least digit first, then the group) and equal runs are counted; digits that all terms
   share, as the empty ends of short terms, cost no pass.  Longer terms go to buckets by the
   power of two above their length and are sorted there as bytes.  A run gives the term's
   occurrences and, as rows stay in order within it, its documents.
2. Partial counts, not terms, are shuffled by (language, term); one exchange serves the sums by source
   and by language, and the documents' bound.
3. ``pair``: the counts of a block of terms of one language meet that language's sources
   (a cogroup; terms are dealt into blocks by their hash, so a block is bounded however large a language is)
   and fill a dense matrix, from which numpy sums f over the block's terms for all
   ordered pairs of sources in tiles.  A block emits one partial sum a pair.
   ``term``: DataFrame expressions and a ranking that keeps ``top`` rows a group before its shuffle.

Sums fit 64 bits: |p - q| is at most 10**9 and the differences of a pair add up to less than
2 * 10**9 + 2 V, so a sum stays below 4 * 10**18 up to V = 10**9; counts are multiplied as decimals.

Edge cases: null texts, languages and sources count as ''; a language without kept terms has pairs
of value 0 and no terms; a language of one source has no pairs; equal values rank by the
item's bytes; repeated rows are documents of their own; ids are not read; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textops as T
from .frames import batch_of, small, written

SCALE = 1_000_000_000
FLUSH_BYTES = 16 << 20
BLOCK_ROWS = 200_000
TILE = 32
WIDEST = 8  # terms of up to 2 ** WIDEST bytes are sorted as padded arrays, longer ones as bytes objects
_CELLS = 1 << 21

# Bytes of terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ (after lower-casing).
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by uint64 ``words`` (the first is the least): 16 bits a pass, constant digits skipped."""
    order = np.arange(len(words[0]))
    for word in words:
        differ = np.bitwise_or.reduce(word ^ word[0]) if len(word) else 0
        for shift in range(0, 64, 16):
            if (int(differ) >> shift) & 0xFFFF:
                digit = (word >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(order, group, row, changes):
    """``(first, count, docs)`` of the runs of equal (group, term) in ``order``; ``changes`` tells where the term differs."""
    g, r = group[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = changes | (g[1:] != g[:-1])
    other = new.copy()
    other[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order))), np.add.reduceat(other.astype(np.int64), at)


def _counted(buf, starts, lengths, row, group):
    """Runs of the terms given by spans, by length bucket: lists of (first span, occurrences, documents)."""
    eight = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf.data, strides=(1,))
    bucket = np.where(lengths <= 8, 0, np.where(lengths <= 16, 1, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)))
    bucket = np.minimum(bucket, WIDEST + 1)
    for b in np.unique(bucket):
        own = np.flatnonzero(bucket == b)
        s, n, r = starts[own], lengths[own], row[own]
        g = group[r]
        if b <= 1:
            words = [eight[s] & T.LOW_MASK[np.minimum(n, 8)]]
            if b == 1:
                words.append(eight[s + 8] & T.LOW_MASK[n - 8])
            order = radix_order([*words, g.astype(np.uint64)])
            changes = np.zeros(max(len(order) - 1, 0), bool)
            for word in words:
                word = word[order]
                changes |= word[1:] != word[:-1]
        elif b <= WIDEST:
            width, a = 1 << int(b), 0
            while a < len(own):  # slices of whole rows, so that a row's occurrences of a term meet
                z = min(a + max(1, _CELLS // width), len(own))
                if z < len(own):
                    z = cut if (cut := np.searchsorted(r, r[z])) > a else np.searchsorted(r, r[z], side="right")
                part, a = slice(a, z), z
                at = np.minimum(s[part, None] + np.arange(width), len(buf) - 1)
                padded = np.where(np.arange(width) < n[part, None], buf[at], 0).astype(np.uint8).view(f"S{width}").ravel()
                order = np.lexsort((padded, g[part]))
                padded = padded[order]
                first, count, docs = _runs(order, g[part], r[part], padded[1:] != padded[:-1])
                yield own[part][first], count, docs
            continue
        else:
            terms = [buf[x:x + k].tobytes() for x, k in zip(s.tolist(), n.tolist())]
            order = np.array(sorted(range(len(terms)), key=lambda k: (g[k], terms[k])))
            changes = np.array([terms[x] != terms[y] for x, y in zip(order[1:], order)], dtype=bool)
        first, count, docs = _runs(order, g, r, changes)
        yield own[first], count, docs


def _gather(buf, starts, lengths) -> pa.Array:
    """The spans as a string array."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(starts, lengths)
    data = pa.py_buffer(buf[at].tobytes())
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), data).cast(pa.string())


def _term_counts(batches):
    """Partial counts of (lang, source, text) rows: lang, source, term, occurrences, documents."""
    names = ["lang", "source", "term", "c", "d"]
    for batch in batches:
        pairs = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
        keys = pairs.to_pylist()
        code: dict = {}
        group = np.array([code.setdefault((k["lang"], k["source"]), len(code)) for k in keys], dtype=np.int64)
        lang, source = (np.array([k[i] for k in code], dtype=object) for i in (0, 1))
        for first, last, buf, bounds in T.text_chunks(batch.column(2), FLUSH_BYTES):
            buf = T.LOWER[buf]
            starts, ends, row, _ = T.word_spans(buf, bounds, LETTERS)
            own = group[first:last]
            for at, count, docs in _counted(buf, starts, ends - starts, row, own):
                g = own[row[at]]
                yield batch_of([pa.array(lang[g], pa.string()), pa.array(source[g], pa.string()),
                                _gather(buf, starts[at], (ends - starts)[at]), pa.array(count, pa.int64()), pa.array(docs, pa.int64())], names)


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a term with ``count`` occurrences among ``total`` of ``terms`` kept terms; exact."""
    top = count.cast("decimal(20,0)") + 1
    return (F.lit(1) + F.call_function("div", (top * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)"),
                                       (total + terms).cast("decimal(20,0)")).cast("long")).cast("long")


def _block_sums(lang_block, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of f over the terms of one block, for all ordered pairs of the language's sources."""
    names = sources.column("source").to_pylist()
    base = np.array(sources.column("p0").to_pylist(), np.int64)
    code = {s: k for k, s in enumerate(names)}
    column = np.array([code[s] for s in terms.column("source").to_pylist()], np.int64)
    p = terms.column("p").to_numpy().astype(np.int64)
    row = np.unique(np.array(terms.column("term").to_pylist(), dtype=object), return_inverse=True)[1] if len(p) else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, column, p = row[order], column[order], p[order]
    n, s = int(row[-1]) + 1 if len(row) else 0, len(names)
    sums = np.zeros((s, s), np.int64)
    step = max(1, _CELLS // max(s, TILE * TILE))
    for a in range(0, n, step):
        b = min(n, a + step)
        own = slice(np.searchsorted(row, a), np.searchsorted(row, b))
        matrix = np.repeat(base[None, :], b - a, axis=0)
        matrix[row[own] - a, column[own]] = p[own]
        for i in range(0, s, TILE):
            for j in range(0, s, TILE):
                q = matrix[:, None, j:j + TILE]
                gap = matrix[:, i:i + TILE, None] - q
                gap *= gap
                gap //= q
                sums[i:i + TILE, j:j + TILE] += gap.sum(axis=0)
    left, right = np.divmod(np.arange(s * s), max(s, 1))
    pairs = left != right
    lang = sources.column("lang")[0].as_py() if s else None
    names = np.array(names, dtype=object)
    return pa.table({"lang": pa.array([lang] * int(pairs.sum()), pa.string()), "source": pa.array(names[left[pairs]], pa.string()),
                     "item": pa.array(names[right[pairs]], pa.string()), "value": pa.array(sums.ravel()[pairs], pa.int64())})


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each group from the other sources
    (part ``pair``) and its most over-used terms (part ``term``, ranks to ``top``)."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = written(rows.select("lang", "source").distinct(), "divergence-groups")
    partial = rows.mapInArrow(_term_counts, "lang string, source string, term string, c long, d long")
    # One exchange by (lang, term): the sums by source, by language, and their join need no other.
    # Both branches read all its columns, so that it runs once.
    by_source = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    vocabulary = by_source.groupBy("lang", "term").agg(F.sum("c").alias("lang_c"), F.sum("d").alias("lang_d"))
    kept = written(by_source.join(vocabulary.where(F.col("lang_d") >= min_docs), ["lang", "term"]), "divergence-kept")

    # N and V of the groups and languages; groups without kept terms have N = 0.
    totals = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_c").alias("lang_c")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("lang_c").alias("lang_n"))
    groups = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["n", "v", "lang_n"]))
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1).cast("long"))
    groups = written(groups.withColumn("p0", zero), "divergence-totals")
    terms = kept.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("v")))

    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    dealt = terms.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    beside = groups.select("lang", "source", "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    sums = dealt.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block")).applyInArrow(
        _block_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.desc("value"), F.asc("item")]
    group = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))

    q = share(F.col("lang_c"), F.col("lang_n"), F.col("v"))
    over = terms.withColumn("q", q).where(F.col("p") > F.col("q"))
    gap = F.col("p") - F.col("q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                       F.call_function("div", gap * gap, F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    return pairs.unionByName(over)
