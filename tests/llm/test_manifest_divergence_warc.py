"""Merkle manifest, source divergence and WARC archives against brute force, with odd inputs."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinlink.llm import divergence, merkle, warc


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest

def _leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k:k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def _siblings(levels, at):
    out = []
    for own in levels[:-1]:
        run = own[at // 16 * 16:at // 16 * 16 + 16]
        out.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        at //= 16
    return out


def _manifest(rows):
    """For each row (doc_id, source, lang, n_chars, text): leaf, subroot, root, siblings."""
    groups = defaultdict(list)
    for k, (i, source, lang, n, text) in enumerate(rows):
        groups[source].append(((i is not None, i or 0), _leaf(i, source, lang, n, text), k))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([leaf for _, leaf, _ in sorted(groups[s])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = {}
    for j, s in enumerate(names):
        for at, (_, leaf, k) in enumerate(sorted(groups[s])):
            out[k] = (leaf, trees[s][-1][0], top[-1][0], _siblings(trees[s], at) + _siblings(top, j))
    return out


def _check_manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, path string, idx int").repartition(7)
    want = Counter()
    for k, (leaf, subroot, root, siblings) in _manifest(rows).items():
        i, source, lang, n, text = rows[k]
        h = leaf
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            h = _leaf(i, source, lang, n, None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text))
        for left, right in siblings:
            h = sha(left + h + right)
        want[(i, leaf, subroot, root, sha("".join(a + b for a, b in siblings)), h, h == root)] += 1
    assert Counter(tuple(r) for r in merkle.report(docs).collect()) == want


def test_manifest_with_nulls_repeats_and_several_layers(spark):
    rows = [(k, "big", "en", k % 7, f"Text {k}") for k in range(4700)]  # more than one block of 4096
    rows += [(k, f"s{k % 37}", None if k % 3 else "dé", None, "" if k % 5 else None) for k in range(5000, 5300)]
    rows += [(9000, None, "en", 1, "Ab"), (9001, "", "en", 1, "Ab"), (9002, "only", "fr", 3, "É"), (None, "big", "en", 1, "No id")]
    rows += [(7, "rep", "en", 4, "Same")] * 20
    random.Random(1).shuffle(rows)
    _check_manifest(spark, rows)


def test_manifest_of_one_row_and_of_none(spark):
    _check_manifest(spark, [(5, "a", "en", 1, "Text")])
    _check_manifest(spark, [])


def test_manifest_proofs_are_paths(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    rows = merkle.manifest(docs, fields=("doc_id", "text")).collect()
    assert len(rows) == 40 and {len(r.path) for r in rows} == {2}
    for r in rows:
        h = r.leaf
        for s in r.path:
            h = sha(s.left + h + s.right)
        assert h == r.root == r.subroot


# Source divergence

def _divergence(rows, min_docs=3, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def p(count, n):
            return 1 + 10 ** 9 * (count + 1) // (n + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p(counts[lang, s][t], total[s]), p(counts[lang, o][t], total[o])) for t in kept)) for o in sources - {s}]
            own = [(t, p(counts[lang, s][t], total[s]), p(whole[t], sum(whole.values()))) for t in kept if counts[lang, s][t]]
            terms = [(t, f(a, b)) for t, a, b in own if a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top}
    return out


def _divergence_rows():
    rnd = random.Random(3)
    words = ["a", "Ab", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "x" * 300, "x" * 299 + "y", "é" * 9, "Ж", "日本語" * 8]
    words += ["".join(rnd.choice("abcDEé") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rows = [(rnd.choice(["en", "de", None]), f"s{rnd.randrange(40)}" if k % 9 else None, " 1,".join(rnd.choices(words, k=rnd.randint(0, 60)))) for k in range(400)]
    rows += [("en", "s0", "Ab " * 5000)] * 3 + [("one", "alone", "a a a")] * 3 + [("few", "x", "rare"), ("few", "y", None), ("", "", "")]
    return rows


def test_divergence_against_brute_force_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 500)
    rows = _divergence_rows()
    docs = spark.createDataFrame([(*r, "t", 1.0) for r in rows], "lang string, source string, text string, term string, p double").repartition(5)
    got = [tuple(r) for r in divergence.divergence(docs, top=25).collect()]
    assert len(got) == len(set(got)) and set(got) == _divergence(rows, top=25)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_long_terms_of_one_row_meet_across_slices():
    import numpy as np
    from twinlink.llm import textops as T
    import pyarrow as pa
    text = " ".join(["abcdefghijklmnopqrstuvw"] * 200_000)
    for first, last, buf, bounds in T.text_chunks(pa.array(["zz abcdefghijklmnopqrstuvw", text, text]), 1 << 30):
        starts, ends, row, _ = T.word_spans(buf, bounds, divergence.LETTERS)
        parts = list(divergence._counted(buf, starts, ends - starts, row, np.zeros(3, np.int64)))
    assert sum(int(d.sum()) for at, c, d in parts) == 4 and sum(int(c.sum()) for at, c, d in parts) == 400_002


# WARC

def _digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


HOSTILE = "<html>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\r\n"


def _pages():
    rows = [(k, f"https://a.example/{k}", f"<p>{k % 6}</p>é") for k in range(60)]
    rows += [(100, "https://a.example/\r\nWARC-Type: x", HOSTILE), (101, None, None), (102, "u", ""), (103, "https://b.example/ü", HOSTILE)]
    return rows + [(104, "u", "only"), (None, "u", "only"), (None, "u", "nobody"), (105, "r", "rep"), (105, "r", "rep"), (90, "q", "rep"), (106, "big", "ab" * 3_000_000)]


def test_warc_report(spark):
    rows = _pages()
    last = defaultdict(list)
    for i, _, html in rows:
        last[html or ""].append(i)
    want = Counter()
    for i, _, html in rows:
        html = html or ""
        most = max((x for x in last[html] if x is not None), default=None)
        want[(i, len(html.encode()), _digest(html), "response" if i == most else "revisit", None if i == most else most)] += 1
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, bytes int, digest string").repartition(3)
    out = warc.report(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r) for r in out.collect()) == want


def test_warc_round_trip_and_captures(spark, tmp_path):
    pages = spark.createDataFrame(_pages(), "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), min_bytes=5)
    records = warc.read_records(spark, str(tmp_path / "w"))
    rows = warc.captures(records).collect()
    assert len(rows) == len(_pages()) and all(r.n_requests == r.n_metadata == 1 for r in rows)
    ids = [r.record_id for r in rows]
    assert len(set(ids)) == len(ids)
    stored = {r.metadata.fields.get("page-id"): bytes(r.http.payload) for r in rows if r.type == "response"}
    for i, _, html in _pages():
        if str(i) in stored:
            assert stored[str(i)] == (html or "").encode()
    assert {r.type for r in rows if r.metadata.fields.get("page-id") in ("101", "102")} == {"response"}  # under min_bytes
    again = [r for r in rows if r.type == "revisit"]
    assert all(r.http.payload_bytes == 0 and r.http.told_bytes >= 5 and r.http.payload_digest for r in again)
    assert any("%0D%0A" in (r.target_uri or "") for r in rows)


def test_warc_of_other_writers(spark, tmp_path):
    def record(kind, name, block, *fields):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: <{name}>", f"Content-Length: {len(block)}", *fields])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    one = record("response", "r1", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfebody", "Content-Type: application/http;msgtype=response")
    two = record("metadata", "m2", b"page-id: 9\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <r1>")
    three = record("metadata", "m1", b"page-id: 8\r\n", "Content-Type: application/warc-fields", "WARC-Concurrent-To: <r1>")
    four = record("response", "r2", b"HTTP/1.1 204 No Content", "Content-Type: application/http;msgtype=response")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (one, two, three)))
    (tmp_path / "b.warc").write_bytes(four)
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = {r.record_id: r for r in warc.captures(warc.read_records(spark, str(tmp_path))).collect()}
    assert bytes(rows["<r1>"].http.payload) == b"\xff\xfebody" and rows["<r1>"].request is None
    assert rows["<r1>"].metadata.fields == {"page-id": "8"} and rows["<r1>"].n_metadata == 2
    assert rows["<r2>"].http.payload_bytes == 0 and rows["<r2>"].metadata is None


def test_warc_malformed_and_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        list(warc.parsed(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))
    with pytest.raises(ValueError):
        list(warc.parsed(b"no record"))
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
