"""Token counts and BPE against the libraries themselves."""

import pytest
import base64
import hashlib
import random

import public_tokenizers as P
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from twinlink.llm import bpe, pretokens, textops, token_counts

PIECES = ["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "'re", "中",
          "\x1c", "\x85", "​", "😀", "<|endoftext|>", "S", "hello", " the"]


def _texts(n=300):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    return texts + ["", None, "'r", "'", " ", "x" * 5000, "ab" * 3000, "the " * 3000]


def test_slices_equal_the_pattern():
    texts, pattern = _texts(2000), regex.compile(P.PATTERN)
    for first, last, buf, bounds in textops.text_chunks(pa.array(texts), 20_000):
        cuts, per_row = pretokens.slices(buf, bounds)
        raw = buf.tobytes()
        for r in range(last - first):
            own = [raw[cuts[k]:cuts[k + 1]].decode() for k in range(per_row[r], per_row[r + 1])]
            assert own == pattern.findall(texts[first + r] or "")


def test_token_counts_equal_the_library(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.report(docs, P.path("byte_bpe_50k.json"), 1024).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((text or "").encode()), n > 1024)


def test_frequent_table_finds_what_it_holds_and_nothing_else():
    rng = random.Random(3)
    tokens = sorted({bytes(rng.choices(b"abc\x00", k=rng.randrange(1, 16))) for _ in range(5000)})
    held, rest = tokens[::2], tokens[1::2] + [b"a" * 15, b"zz"]
    rest = [t for t in rest if t not in set(held)]
    table = token_counts.FrequentTable(held, [k + 1 for k in range(len(held))])

    def find(own):
        size = np.array([len(t) for t in own])
        return table.find(*token_counts._packed(np.frombuffer(b"".join(own) + bytes(8), np.uint8), np.cumsum(size) - size, size)).tolist()
    assert find(held) == [k + 1 for k in range(len(held))] and not any(find(rest))
    empty = token_counts.FrequentTable([], [])
    assert empty.find(*token_counts._packed(np.frombuffer(b"ab" + bytes(8), np.uint8), np.array([0]), np.array([2]))).tolist() == [0]


def test_token_counts_do_not_depend_on_the_table(spark):
    texts = _texts() * 2
    docs = spark.createDataFrame([(None, t, 5) for t in texts], "doc_id long, text string, n_tokens long")
    path = P.path("byte_bpe_50k.json")
    counts = [sorted((str(r.doc.text), r.doc.n_tokens, r.n_tokens) for r in token_counts.count_tokens(docs, path, **o).collect())
              for o in ({}, {"max_frequent": 0}, {"max_frequent": 3, "sample_bytes": 500})]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == len(texts)


def test_bpe_equals_tiktoken_and_decodes(spark):
    texts = _texts()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(path)[0], special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.report(docs, path).collect()}
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_offsets_nulls_extra_columns_and_empty_tables(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(None, "a bc", 7), (1, None, None)], "doc long, text string, ids long")
    rows = {r.doc.doc: r for r in bpe.encode(docs, path).collect()}
    assert rows[None].doc.ids == 7 and rows[None].offsets[-1] == 4 and rows[1].ids is None
    assert bpe.report(docs.limit(0).withColumnRenamed("doc", "doc_id"), path).count() == 0
    assert token_counts.report(docs.limit(0).withColumnRenamed("doc", "doc_id"), P.path("byte_bpe_50k.json"), 1).count() == 0


def test_decode_checks_the_token_ends(spark):
    import public_tokenizers
    from pyspark.sql import functions as F
    from twinlink.llm import bpe
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello wörld 日本"), (2, ""), (3, "x y  z")], "doc_id long, text string")
    encoded = bpe.encode(docs, path).select(F.col("doc")["doc_id"].alias("id"), F.col("doc")["text"].alias("t"), "ids", "offsets")
    for r in bpe.decode(encoded, path, offsets_col="offsets").collect():
        assert bytes(r.decoded) == r.doc.t.encode() and (r.doc.offsets or [0])[-1] == len(r.decoded)
    wrong = encoded.withColumn("offsets", F.transform("offsets", lambda x: x + 1))
    with pytest.raises(Exception, match="end elsewhere"):
        bpe.decode(wrong, path, offsets_col="offsets").collect()
