"""Secret scans by one combined deterministic automaton.

All rules are compiled into one minimised automaton (``automata``) that reads every byte once,
from the end of a text to its beginning, so that after a byte its state holds which rules have a
match that starts there.  Bytes that no rule holds (found from the automaton itself) cut the texts
into segments; the segments of a batch are read in step, one byte of each at a time, with the
transition array.  From a marked start the rule's own automaton walks to the longest end, and the next
start at or after that end is taken: leftmost and longest, without overlap within a kind.  A walk
ends with its match, so the work is linear in the text, however often a rule begins in it.  A ``min``
on the matched part drops a match after it was found.

The kinds ``assign``, ``access`` and ``hex`` are the base rules; the others are added by the
method.  Positions are code points, the end exclusive.

Edge cases: a null or empty text has no spans; a span may be listed by several kinds; a
text of one very long segment is read by a scalar loop once few segments are left;
repeated rows, null ids and other columns pass through; empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textops as T
from .automata import compile_rules, longest
from .frames import as_struct, batch_of, field_of, with_fields

_KEY = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""
# Fixed rules: kind -> (rule up to its last part, repeats of that part, prefix not counted, least counted length).
BASE = {
    "assign": (_KEY + "[A-Za-z0-9+/_.=-]", "+", _KEY, 6),
    "access": ("AKIA[A-Z0-9]", "+", "", 20),
    "hex": ("[0-9a-f]", "+", "", 24),
}
MORE = {
    "private_key": ("-----BEGIN\\x20([A-Z0-9]+\\x20)*PRIVATE\\x20KEY-----", "", "", 0),
    "github": ("gh[pousr]_[A-Za-z0-9]", "{36,}", "", 0),
    "slack": ("xox[abeprs]-[A-Za-z0-9-]", "{12,}", "", 0),
    "google": ("AIza[A-Za-z0-9_-]", "{35}", "", 0),
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]", "{8,}", "", 0),
}
RULES = {**BASE, **MORE}
# Starts that the combined automaton marks.  Long counted tails inside each other's classes would multiply
# its states, so these are marked from their first byte on: a walk that falls short has read at most their count.
STARTS = {kind: rule for kind, (rule, _, _, _) in RULES.items()}
STARTS |= {"hex": "[0-9a-f]{24,}", "jwt": "".join(RULES["jwt"][:2])}
_FEW = 64


@lru_cache(maxsize=1)
def _scanner():
    """The combined automaton, its moves for the scalar loop, flags of the bytes in any rule, its shortest
    match, and (match, prefix match, least length) of every rule."""
    dfa = compile_rules(list(STARTS.values()), backward=True)
    kinds = [(longest(compile_rules([rule + last])), longest(compile_rules([prefix])) if prefix else None, least)
             for rule, last, prefix, least in RULES.values()]
    return dfa, dfa.next.tolist(), ~dfa.synchronising(), dfa.shortest(), kinds


def _marked(dfa, table, read, starts, ends):
    """Places in the segments (longest first) where a match starts, and the rule bits of each; ``read`` has the byte
    classes."""
    width = dfa.next.shape[1]
    moves = (dfa.next * width).reshape(-1)
    marks = np.repeat(dfa.accepts > 0, width)
    state = np.full(len(starts), dfa.start * width, dtype=np.int32)
    at, shortest_first = ends.copy(), (ends - starts)[::-1]
    places, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    n, step = len(starts), 0
    while n > _FEW:
        own = state[:n]
        at[:n] -= 1
        own += read[at[:n]]
        own[:] = moves[own]
        hit = np.flatnonzero(marks[own])
        if len(hit):
            places.append(at[hit])
            states.append(own[hit])
        step += 1
        n = len(starts) - int(np.searchsorted(shortest_first, step, side="right"))
    accepts = (dfa.accepts > 0).tolist() if n else []
    for k in range(n):
        s, place, found = int(state[k]) // width, int(at[k]), []
        for c in read[starts[k]:place][::-1].tobytes():
            s = table[s][c]
            place -= 1
            if accepts[s]:
                found.append((place, s * width))
        if found:
            own = np.array(found, dtype=np.int64)
            places.append(own[:, 0])
            states.append(own[:, 1].astype(np.int32))
    return np.concatenate(places), dfa.accepts[np.concatenate(states) // width]


def find_secrets(column):
    """For every row of a string column: list of (start, kind number, end), sorted, in code points."""
    dfa, table, inside, least_bytes, kinds = _scanner()
    out = []
    for first, last, buf, bounds in T.text_chunks(column):
        rows = [[] for _ in range(last - first)]
        starts, ends, _, _ = T.word_spans(buf, bounds, inside)
        order = np.argsort(starts - ends, kind="stable")
        order = order[:int(np.searchsorted((starts - ends)[order], -least_bytes, side="right"))]
        places, bits = _marked(dfa, table, dfa.classes[buf], starts[order], ends[order])
        raw = buf.tobytes() if len(places) else b""
        for k, (match, prefix, least) in enumerate(kinds):
            own = np.sort(places[(bits >> k) & 1 > 0])
            i = 0
            while i < len(own):
                start = int(own[i])
                row = int(np.searchsorted(bounds, start, side="right")) - 1
                end = match(raw, start, int(bounds[row + 1]))
                if end < 0:  # a counted tail falls short
                    i += 1
                    continue
                if end - (prefix(raw, start, end) if prefix else start) >= least:
                    rows[row].append((start, k, end))
                i = int(np.searchsorted(own, end))
        for r, spans in enumerate(rows):
            if spans:
                a, b = int(bounds[r]), int(bounds[r + 1])
                points = np.concatenate(([0], np.cumsum((buf[a:b] & 0xC0) != 0x80)))
                rows[r] = sorted((int(points[s - a]), k, int(points[e - a])) for s, k, e in spans)
        out += rows
    return out


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``doc`` with ``spans``, sorted by start and then by kind as listed in RULES."""
    at, names = docs.columns.index(text_col), list(RULES)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            found = find_secrets(field_of(batch.column(0), at))
            rows = [[{"kind": names[k], "start": s, "end": e} for s, k, e in own] for own in found]
            yield batch_of([batch.column(0), pa.array(rows, kind)], ["doc", "spans"])
    return as_struct(docs).mapInArrow(scan, with_fields(docs, f"spans {SPAN}"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one mark); same columns."""
    spans = F.col("spans")
    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    text = F.col("doc")[text_col]
    pieces = F.aggregate("merged", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), lambda acc, s: F.struct(
        F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")),
                 F.lit(mark)).alias("out"), s["end"].alias("at")))
    clean = F.concat(F.col("p.out"), F.substr(text, F.col("p.at").cast("int") + 1))
    out = scan_secrets(docs, text_col).withColumn("merged", merged).withColumn("p", pieces)
    return out.withColumn("doc", F.col("doc").withField(text_col, clean)).select("doc.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, ``base_sha256`` and all ``spans`` as kind:start:end."""
    out = scan_secrets(docs.select(id_col, text_col), text_col)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return out.select(F.col("doc")[id_col].alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"),
                      joined(F.col("spans")).alias("spans"))
