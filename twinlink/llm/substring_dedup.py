"""Repeated passages across documents, located by sharded Aho-Corasick automata.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window is ``window`` consecutive words
of one document.  A word is removed when it lies in a window whose word sequence
also starts in a document with a smaller id; all windows are judged on the input.

1. Phrases.  Among the ``PHRASE``-word phrases of every window the one with the smallest
   hash is selected, so equal windows select equal phrases, and a document about one
   phrase in 22 words.  Two Bloom filters drop phrases of a single document; the rest are
   grouped, which confirms the phrases that recur in several documents.
2. Automata.  Documents get their recurring phrases.  Every shard (a slice of an Arrow
   batch with at most ``SHARD_PHRASES`` phrases) compiles one automaton with pyahocorasick and
   streams its documents through it, which locates all occurrences.  A phrase that a third
   of all documents share is one pattern of each shard and a hot spot of none.  Only a
   window that holds a located phrase can recur.
3. Exact check.  Windows next to each other with the same smallest located phrase make a
   segment.  A segment whose words also are a segment of a smaller document is removed whole;
   windows of the other segments (the first of their kind) are compared one by one, by
   a 128-bit hash; two Bloom filters keep those of a single segment out of the shuffle.  Both take
   one minimum per hash, pre-aggregated by task, and join it map-side while it is small, so that a
   window of a third of all documents meets in no task.

Edge cases: a null or empty text has no words; a text shorter than the window keeps all
its words; a null id is no smaller id and loses nothing; rows that repeat an id do not
remove each other's words; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bloom, textops as T
from .frames import as_struct, batch_of, field_of, replace_field, small, with_fields, written

PHRASE = 8
SHARD_PHRASES = 20_000
_CHUNK = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
# A word is three letters of five bits in the strings that the automata read.
_LETTERS, _BITS = 3, 5


def _words(buf, bounds):
    starts, ends, _, per_row = T.word_spans(buf, bounds, T.NON_SPACE)
    return starts, ends, per_row, T.span_hashes(buf, starts, ends)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _window_minima(values, per_row, window, phrase=PHRASE):
    """``(minimum over the phrases of each window, first words)``; ``values`` has one per word."""
    _, at = T.run_hashes(np.zeros(len(values), np.uint64), per_row, window)
    if not len(at):
        return np.zeros(0, np.uint64), at
    return _smallest(values, window - phrase + 1)[at], at


def _phrase_values(words, per_row):
    """Hash of the phrase that starts at each word; all ones where the row ends before."""
    values = np.full(len(words), _NONE)
    runs, at = T.run_hashes(words, per_row, PHRASE)
    values[at] = runs
    return values


def _letters(words: np.ndarray) -> np.ndarray:
    """The letters of the words, ``_LETTERS`` bytes each."""
    shifts = (np.uint64(7) + np.arange(_LETTERS, dtype=np.uint64) * np.uint64(_BITS))
    return (((words[:, None] >> shifts) & np.uint64((1 << _BITS) - 1)).astype(np.uint8) + ord("A")).reshape(-1)


def _selected(column, window):
    """Per chunk: first row, words, word offsets, and the words where selected phrases start."""
    for first, _, buf, bounds in T.text_chunks(column, _CHUNK):
        _, _, per_row, words = _words(buf, bounds)
        values = _phrase_values(words, per_row)
        minima, at = _window_minima(values, per_row, window)
        if len(at):
            row_of = np.searchsorted(per_row, at, side="right") - 1
            new = np.ones(len(at), bool)
            new[1:] = (minima[1:] != minima[:-1]) | (row_of[1:] != row_of[:-1])
            yield first, words, values, minima[new], at[new], row_of[new]


def _recurring_phrases(narrow: DataFrame, window: int) -> DataFrame:
    """``id, th, phrase`` of every phrase that was selected in documents of different ids."""
    def hashes(batch):
        for _, _, _, minima, _, row in _selected(batch.column(2), window):
            order = np.lexsort((minima, row))
            minima, row = minima[order], row[order]
            new = np.ones(len(row), bool)
            new[1:] = (minima[1:] != minima[:-1]) | (row[1:] != row[:-1])
            yield minima[new]

    sc = narrow.sparkSession.sparkContext
    packed = sc.broadcast(bloom.twice_seen(narrow, hashes, bloom.filter_bits(32 * narrow.count())))

    def suspects(batches):
        for batch in batches:
            rows, phrases = [], []
            for first, words, values, minima, at, row in _selected(batch.column(2), window):
                ok = np.flatnonzero(bloom.contains(packed.value, minima))
                letters = _letters(words).tobytes()
                # the leftmost place of the smallest phrase in its window
                place = {}
                for k in ok.tolist():
                    own = values[at[k]:at[k] + window - PHRASE + 1]
                    p = int(at[k]) + int(np.argmax(own == minima[k]))
                    place[(int(row[k]), letters[p * _LETTERS:(p + PHRASE) * _LETTERS])] = None
                rows += [first + r for r, _ in place]
                phrases += [p for _, p in place]
            at = pa.array(rows, pa.int64())
            yield batch_of([batch.column(0).take(at), batch.column(1).take(at),
                            pa.array(phrases, pa.binary()).cast(pa.string())], ["id", "th", "phrase"])
    kind = narrow.schema["id"].dataType.simpleString()
    found = written(narrow.where("id is not null").mapInArrow(suspects, f"id {kind}, th bigint, phrase string"),
                    "passage-phrases")
    several = found.groupBy("phrase").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).where("i0 < i1")
    return found.join(several.select("phrase"), "phrase")


def _located(automaton, words, per_row, rows):
    """Flag per word: a phrase of the automaton starts here."""
    flags = np.zeros(len(words), bool)
    letters = _letters(words).tobytes().decode("ascii")
    back = PHRASE - 1
    for r in rows:
        a, b = int(per_row[r]), int(per_row[r + 1])
        ends = [e for e, _ in automaton.iter(letters[a * _LETTERS:b * _LETTERS])]
        if ends:
            ends = np.array(ends)
            ends = ends[ends % _LETTERS == _LETTERS - 1] // _LETTERS
            flags[a + ends - back] = True
    return flags


def _shards(phrases, limit):
    """Row ranges with at most ``limit`` phrases (or one row)."""
    first, n = 0, 0
    for row, own in enumerate(phrases):
        if n and n + len(own) > limit:
            yield first, row
            first, n = row, 0
        n += len(own)
    if first < len(phrases):
        yield first, len(phrases)


def _segments(joined: DataFrame, window: int) -> DataFrame:
    """``id, th, start, s1, s2, h1[], h2[]``: the segments of candidate windows of (id, th, text, phrases)."""
    def locate(batches):
        for batch in batches:
            phrases = batch.column(3).to_pylist()
            for first, last in _shards(phrases, SHARD_PHRASES):
                automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                for own in phrases[first:last]:
                    for p in own:
                        automaton.add_word(p)
                automaton.make_automaton()
                part = batch.slice(first, last - first)
                rows, cols = [], [[], [], [], [], []]
                for row0, _, buf, bounds in T.text_chunks(part.column(2), _CHUNK):
                    _, _, per_row, words = _words(buf, bounds)
                    flags = _located(automaton, words, per_row, range(len(bounds) - 1))
                    values = np.where(flags, _phrase_values(words, per_row), _NONE)
                    minima, at = _window_minima(values, per_row, window)
                    h1, _ = T.run_hashes(words, per_row, window)
                    h2, _ = T.run_hashes(words, per_row, window, seed=0x5BD1E995)
                    ok = minima != _NONE
                    minima, at, h1, h2 = minima[ok], at[ok], h1[ok], h2[ok]
                    if not len(at):
                        continue
                    row = np.searchsorted(per_row, at, side="right") - 1
                    new = np.ones(len(at), bool)
                    new[1:] = (minima[1:] != minima[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                    cut = np.flatnonzero(new)
                    ends = np.append(cut[1:], len(at))
                    size = (ends - cut).astype(np.uint64)
                    place = np.arange(1, len(at) + 1, dtype=np.uint64) - np.repeat(cut.astype(np.uint64), ends - cut)
                    sums = [np.add.reduceat(T.mix(h + place * T._GOLD), cut) + size for h in (h1, h2)]
                    rows += (row0 + row[cut]).tolist()
                    cols[0] += (at[cut] - per_row[row[cut]]).tolist()
                    for k, v in ((1, sums[0]), (2, sums[1])):
                        cols[k] += v.view(np.int64).tolist()
                    for k, v in ((3, h1.view(np.int64)), (4, h2.view(np.int64))):
                        cols[k] += [v[a:b] for a, b in zip(cut, ends)]
                at = pa.array(rows, pa.int64())
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
                yield batch_of([part.column(0).take(at), part.column(1).take(at),
                                *(pa.array(c, k) for c, k in zip(cols, kinds))],
                               ["id", "th", "start", "s1", "s2", "h1", "h2"])
    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(locate, f"id {kind}, th bigint, start bigint, s1 bigint, s2 bigint, "
                                     "h1 array<bigint>, h2 array<bigint>")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, first``: keys of several ids with their smallest id."""
    return (rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last"))
            .where("first < last").select(*keys, "first"))


def _suspect_windows(segments: DataFrame) -> DataFrame:
    """``id, th, start, h1, h2`` of the windows in ``segments`` whose hash may occur in a second segment; two
    Bloom filters drop the others before any shuffle."""
    def flat(batch, at):
        column = batch.column(at)
        return column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())

    def hashes(batch):
        h1, sizes = flat(batch, 3)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((h1, row))
        h1, row = h1[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (row[1:] != row[:-1])
        yield h1[new]

    sc = segments.sparkSession.sparkContext
    n = segments.agg(F.sum(F.size("h1"))).first()[0] or 0
    narrow = segments.select("id", "th", "start", "h1", "h2")
    packed = sc.broadcast(bloom.twice_seen(narrow, hashes, bloom.filter_bits(n)))

    def suspects(batches):
        for batch in batches:
            (h1, sizes), (h2, _) = flat(batch, 3), flat(batch, 4)
            ok = np.flatnonzero(bloom.contains(packed.value, h1))
            row = np.repeat(np.arange(len(sizes)), sizes)[ok]
            place = ok - (np.cumsum(sizes) - sizes)[row]
            at = pa.array(row)
            start = batch.column(2).to_numpy()[row] + place
            yield batch_of([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()),
                            pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64))], ["id", "th", "start", "h1", "h2"])
    kind = segments.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(suspects, f"id {kind}, th bigint, start bigint, h1 bigint, h2 bigint")


def removed_ranges(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``id, th, starts[], ends[]``: word ranges to remove of documents (id, hash of the text)."""
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = _recurring_phrases(narrow, window)
    own = written(found.groupBy("id", "th").agg(F.collect_set("phrase").alias("phrases")), "passage-own")
    some = narrow.join(small(own.select("id", "th")), ["id", "th"], "left_semi")
    segments = written(_segments(some.dropDuplicates(["id", "th"]).join(own, ["id", "th"])
                                 .select("id", "th", "text", "phrases"), window), "passage-segments")
    first = small(written(_later(segments.select("id", "s1", "s2"), ["s1", "s2"]), "passage-first"))
    judged = segments.join(first, ["s1", "s2"], "left").withColumn("later", F.col("id") > F.coalesce("first", "id"))
    whole = judged.where("later").select("id", "th", "start", F.size("h1").alias("n"))
    fresh = judged.where("not later")
    windows = written(_suspect_windows(fresh), "passage-windows")
    first = small(written(_later(windows, ["h1", "h2"]), "passage-first"))
    single = (windows.join(first, ["h1", "h2"]).where("id > first")
              .select("id", "th", "start", F.lit(1).alias("n")))
    ranges = whole.union(single)
    by_doc = ranges.groupBy("id", "th").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + window - 1)
                                                                    .alias("end"))).alias("r"))
    kind = narrow.schema["id"].dataType.simpleString()
    return by_doc.mapInArrow(_merged, f"id {kind}, th bigint, starts array<bigint>, ends array<bigint>")


def _merged(batches):
    """Overlapping ranges of each row put together."""
    for batch in batches:
        starts, ends = [], []
        for own in batch.column(2).to_pylist():
            out = []
            for a, b in sorted((r["start"], r["end"]) for r in own):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(b, out[-1][1])
                else:
                    out.append([a, b])
            starts.append([a for a, _ in out])
            ends.append([b for _, b in out])
        kind = pa.list_(pa.int64())
        yield batch_of([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)],
                       ["id", "th", "starts", "ends"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Every row of ``docs`` as struct ``doc``, its text the kept words joined by one space (a null text
    stays null), with ``n_words`` and ``n_removed``."""
    if window <= PHRASE:
        raise ValueError(f"a window has more than {PHRASE} words")
    ranges = small(written(removed_ranges(docs, id_col, text_col, window), "passage-ranges"))
    at = docs.columns.index(text_col)
    doc = as_struct(docs)
    key = (F.col("doc")[id_col] == F.col("id")) & (F.xxhash64(F.col("doc")[text_col]) == F.col("th"))
    joined = doc.join(ranges, key, "left").select("doc", "starts", "ends")

    def remove(batches):
        for batch in batches:
            whole = batch.column(0)
            texts = field_of(whole, at)
            out, n_words, n_removed = [], [], []
            for raw, starts, ends in zip(texts.cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(),
                                         batch.column(2).to_pylist()):
                words, kept = (raw or b"").split(), []
                cut = 0
                for a, b in zip(starts or (), ends or ()):
                    kept += words[cut:a]
                    cut = b
                kept += words[cut:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                out.append(None if raw is None else b" ".join(kept))
            text = pa.array(out, pa.large_binary()).cast(texts.type)
            yield batch_of([replace_field(whole, at, text), pa.array(n_words, pa.int64()),
                            pa.array(n_removed, pa.int64())], ["doc", "n_words", "n_removed"])
    return joined.mapInArrow(remove, with_fields(docs, "n_words bigint, n_removed bigint"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``n_words, n_removed, kept_sha256``."""
    out = substring_dedup(docs.select(id_col, text_col), id_col, text_col, **options)
    return out.select(F.col("doc")[id_col].alias(id_col), "n_words", "n_removed",
                      F.sha2(F.coalesce(F.col("doc")[text_col], F.lit("")), 256).alias("kept_sha256"))
