"""Byte-level BPE against the published library's encoder; odd texts; ranges by offset."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from watchpanel.llm import byte_bpe, pretokens, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.default_ranks(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


ODD = [
    "", " ", "\n", "a", "'s", " 's", "''s", "don't we'll I'd 'S", "x\u0085y", "\x1c\x1d a", "a  b \n c  ", "١٢3", "  ",
    "a" * 500, "ab" * 300 + " 1" * 300, " " * 700 + "a", "漢字かな交じり文" * 80, "<|endoftext|>", "\U000105c0\U000323b0",
    "x".join(chr(i) for i in range(1, 800)),
]


def test_encoder_equals_the_library(library):
    known = byte_bpe.vocabulary(None)
    draw = random.Random(7)
    parts = [*"'stm dl\n\t 　aZé1٣!#😀漢́᠎", "re", "ve", "ll", "'ll", " '", "  "]
    texts = ODD + ["".join(draw.choices(parts, k=draw.randint(0, 90))) for _ in range(1500)]
    for text, found in zip(texts, known.encode(texts)):
        assert ids(found) == library.encode_ordinary(text), text
        assert known.decode(np.frombuffer(found, "<u4"), known.offsets(np.frombuffer(found, "<u4"))) == text.encode()


def test_every_codepoint_has_the_class_of_the_library(library):
    known = byte_bpe.vocabulary(None)
    texts = [f"a{chr(c)}a1{chr(c)}1  {chr(c)}.{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 1 << 17):
        part = texts[at : at + (1 << 17)]
        wrong = [t for t, x in zip(part, known.encode(part)) if ids(x) != library.encode_ordinary(t)]
        assert not wrong


def test_scan_over_many_columns_equals_the_automaton():
    draw = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        symbols = draw.integers(0, pretokens.N_SYMBOLS, n).astype(np.uint8)
        state, want = pretokens.CLEAR, []
        for x in symbols.tolist():
            want.append(state)
            state = pretokens._step(state, x)[0]
        assert pretokens._states_before(symbols).tolist() == want


def test_short_and_long_merging_agree():
    known = byte_bpe.vocabulary(None)
    draw = random.Random(5)
    words = list({bytes(draw.choices(b"abcdeth ing\xc3\xa9", k=draw.randint(1, 60))) for _ in range(500)})
    assert known.merged(words) == {w: known.merged_long(w) for w in words}


def test_pre_tokens_that_are_not_kept(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 3)
    few, many = byte_bpe.Ranks(byte_bpe.default_ranks()), byte_bpe.vocabulary(None)
    for texts in (["a b c d e f"], ["b a g h"], ODD):
        assert few.encode(texts) == many.encode(texts)
        assert len(few.kept) <= 3


def test_tables(spark, library):
    rows = [(1, t, "x", "y") for t in ODD] + [(None, "a b", "x", "y"), (2, None, None, None), (3, "a b", "x", "y"), (3, "a b", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, k string")
    made = byte_bpe.encode(docs)
    assert made.columns == ["doc_id", "n_tokens", "ids", "offsets"]
    found = byte_bpe.decode(made).collect()
    want = [(k, library.encode_ordinary(t or ""), (t or "").encode()) for k, t, _, _ in rows]
    assert sorted(map(repr, ((r.doc_id, ids(r.ids), bytes(r.decoded)) for r in found))) == sorted(map(repr, want))
    assert all(r.n_tokens == len(ids(r.ids)) == len(ids(r.offsets)) for r in found)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).collect() == []
    # a range of tokens, from the fourth on
    part = made.where("n_tokens > 8").withColumn("ids", F.expr("substring(ids, 13, 16)")).withColumn("offsets", F.expr("substring(offsets, 13, 16)"))
    known = byte_bpe.vocabulary(None)
    for r in byte_bpe.decode(part, out="k").collect():
        assert bytes(r.k) == b"".join(known.tokens[i] for i in ids(r.ids))
    nulls = made.withColumn("offsets", F.lit(None).cast("binary"))
    assert {r.decoded for r in byte_bpe.decode(nulls).collect()} == {None}


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op12_byte_bpe"](spark, SF).collect():
        want = library.encode_ordinary(docs[r.doc_id])
        packed = np.array(want, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
