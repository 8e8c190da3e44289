"""Alignment against plain loops over the libraries' encodings; odd texts; small blocks."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from watchpanel.llm import queries, token_alignment
from watchpanel.llm.byte_bpe import letters

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(libraries, texts):
    """Rows of COLUMNS, one for each text."""
    left, right = libraries
    byte_of = letters()
    every = []
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = [(i, bytes(byte_of[c] for c in left.id_to_token(i))) for i in left.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = []
        for i in right.encode(t) if t else []:
            p = right.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode()))
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = []
        j = 0
        for i, x, y in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < y:
                links.append((i, spans[1][k][0]))
                k += 1
        common = {y for *_, y in spans[0]} & {y for *_, y in spans[1]}
        groups, at = [], 0
        for end in sorted(common):
            groups.append("|".join(",".join(str(i) for i, x, y in side if at <= x and y <= end) for side in spans)) if len(t) < 20_000 else None
            at = end
        every.append((spans, links, common, ";".join(groups) if len(t or "") < 20_000 else None))
    docs = Counter(pair for _, links, _, _ in every for pair in set(links))
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    return [
        (
            len(spans[0]), len(spans[1]), len(common), len(links), sum(docs[p] == highest[p[0]] for p in links),
            sum(docs[p] for p in links), groups,
        )
        for spans, links, common, groups in every
    ]


ODD = [
    None, "", " ", "  a  b ", "\n", "a\n\nb", "don't", "<|endoftext|></s><s><unk>", "▁", "a▁b", "x y", "é é",
    "漢字かな", "😀😀 x", "\x00a", "\t 　 z", "antidisestablishmentarianism" * 40, "same text", "same text", "0" * 300,
]


def test_against_loops(spark, libraries):
    draw = random.Random(4)
    parts = ["foo", " bar", "tion", " the", " The", "é", "ü", " ", "\n", "1", "23", ".", ",", "'s", "漢", "▁", "😀", "http://", "ing", " a"]
    texts = ODD + ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(400)]
    rows = [(i % 300 if i % 50 else None, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, k string").repartition(3)
    want = [(k, *w) for (k, *_), w in zip(rows, brute(libraries, texts))]
    for block_tokens in (50, 1 << 20):
        found = token_alignment.align(docs, block_tokens=block_tokens)
        assert found.columns == ["doc_id", *COLUMNS]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(docs).collect() == []
    blank = spark.createDataFrame([("a", None), (None, "")], "doc_id string, text string")
    found = token_alignment.align(blank).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [("a", 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]))


def test_pointers_reach_the_end_of_long_components():
    """Tokens of two and of three bytes, shifted by one: one component, whatever its length."""
    import numpy as np

    class Known:
        a_sizes = b_sizes = np.array([0, 1, 2, 3])

    a, b = [1, *[2] * 999, 1], [2] * 1000
    found = token_alignment.Aligned(Known, np.array(a), np.array(b), np.array([len(a)]), np.array([len(b)]))
    assert found.closes.sum() == 1 and set(found.a_group.tolist()) == set(found.b_group.tolist()) == {0}
    assert len(found.links()[0]) == 2000
    assert found.groups_per_text().tolist() == [1]


def test_query(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {k: w for (k, _), w in zip(docs, brute(libraries, [t for _, t in docs]))}
    found = queries.QUERIES["op11_pointer_jumping"](spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        *numbers, groups = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == tuple(numbers)
        if groups is not None:
            assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if r.n_a else "")
